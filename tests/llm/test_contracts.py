"""The registered queries on the smallest tables, every contract column restated by brute force."""

import hashlib
import re

import pytest

from ragscope.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name, columns):
    df = QUERIES[name](spark, SF_SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_op13(spark, docs):
    from tests.llm.test_periodic import brute

    columns = {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
               "runs_sha256": "string", "collapsed_sha256": "string"}
    got, want = result(spark, "op13_periodic_runs", columns), {}
    for d, t in docs:
        _, runs, kept = brute(d, t)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        want[d] = (d, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5


def test_op11(spark, docs):
    from tests.llm.test_hamming_join import brute

    columns = {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = result(spark, "op11_hamming_join", columns)
    assert got == {d: (d, n, c, d == c) for d, n, c in brute(docs)} and sum(not r[3] for r in got.values()) > 5


def test_op4(spark, docs):
    from tests.llm.test_decontaminate import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    columns = {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    got = result(spark, "op4_benchmark_decontamination", columns)
    assert got == {d: (d, n, hit, len(own), sha(",".join(own)), hit > 0) for d, n, hit, own in brute(docs, items)}
    assert any(r[5] for r in got.values())


def test_op10(spark, docs):
    from tests.llm.test_ngram_join import brute

    got = result(spark, "op10_ngram_jaccard_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert got == {d: (d, n, c) for d, n, c in brute(docs)}
