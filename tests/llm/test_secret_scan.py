"""Trigram queries, postings and spans against plain regular expressions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragscope.llm.secret_scan import RULES, Rule, answer, find_spans, postings_of, scan, spans_text, trigram_query, trigrams_of

code = lambda s: int.from_bytes(s.encode(), "big")


def test_queries():
    assert trigram_query(Rule("a", "AKIA[A-Z0-9]+")) == ("and", [code("aki"), code("kia")])
    assert trigram_query(Rule("h", "[0-9a-f]+")) is True
    assert trigram_query(Rule("x", "ab?")) is True
    q = trigram_query(Rule("k", "(?:api_?key|tok)x+"))
    assert q[0] == "or" and code("tok") in trigrams_of(q) and code("i_k") in trigrams_of(q)
    assert trigram_query(Rule("r", "(abc)+d*")) == code("abc")


def brute(text, rules=RULES):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if m.end() > m.start() and len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(7)
    bits = ["password", "PassWd", "toKen", "api_key", "APIKEY", "=", ": ", "'", '"', " ", "é", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "abc", "\n",
            "-----BEGIN RSA PRIVATE KEY-----", "xoxb-", "ghp_" + "a" * 36, "://u:pass1@", "toKen=abcdefghij", "日本"]
    return [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]]


def test_spans_and_candidates():
    queries = [trigram_query(r) for r in RULES]
    wanted = np.zeros(1 << 24, dtype=bool)
    wanted[sorted(set().union(*[trigrams_of(q) for q in queries]))] = True
    col = pa.array(texts())
    assert find_spans(col, RULES, queries, wanted) == [brute(t) for t in texts()]
    postings = postings_of(col, wanted)
    for r, q in zip(RULES, queries, strict=True):
        hit = {i for i, t in enumerate(texts()) if re.search(r.pattern, t or "", re.ASCII)}
        assert hit <= set(answer(q, postings, len(col)).tolist())


def test_frame(spark):
    rows = [(i, t, "spans") for i, t in enumerate(texts())] + [(None, "token=abcdefgh", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    out = scan(docs).select("doc_id", "spans", spans_text(F.col("spans"), ["hex"]).alias("hex")).collect()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in out}
    kinds = [r.kind for r in RULES]
    assert all(r.hex == ",".join(f"hex:{s.start}:{s.end}" for s in r.spans if s.kind == "hex") for r in out)
    assert got == {**{i: [(a, kinds[k], b) for a, k, b in brute(t)] for i, t in enumerate(texts())}, None: [(0, "assign", 14)]}
    assert scan(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2(cast('' as binary), 256) h").first().h
