"""Secret scans with a trigram inverted index.

For each rule's pattern a Boolean trigram query is derived from the parsed
regular expression: every match contains the trigrams the query asks for.  Each
segment (a slice of a partition's documents) gets postings from trigram to
documents; a rule's query is answered by intersecting and uniting postings, and
only the documents it returns are searched with the pattern.  A rule without
mandatory trigrams searches all documents of the segment.

Trigrams are over UTF-8 bytes with A-Z in lower case, so one index serves rules
in either case.  Segments are independent: nothing is shuffled, and a lost
executor costs its own partitions only.

Edge cases: a null text is empty and has no spans; an empty text likewise; a
match of length zero is no span; a very long text is a segment of its own;
repeated rows are scanned alike; other columns of ``docs`` are not touched.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.words import LOWER, slices, text_column


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# The base rules' patterns and least lengths.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds of credentials by their public formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"://[^\s:/@]+:([^\s:/@]+)@", 1, 4),
)
RULES = (*BASE_RULES, *MORE_RULES)

# -- Boolean trigram queries ----------------------------------------------------
# A query is True (no condition), an int (a trigram), or ("and" | "or", [queries]).

_MOST = 64  # strings a finite part of a pattern may stand for before it counts as any


def _lower(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _join(kind: str, parts: list) -> object:
    stop, skip = (None, True) if kind == "and" else (True, None)
    flat = []
    for p in parts:
        if stop is not None and p is stop:
            return True
        if skip is not None and p is skip:
            continue
        if p not in flat:
            flat.append(p)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, flat)


def _of_string(s: str) -> object:
    b = s.encode()
    return _join("and", [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)])


def _strings(tokens) -> set[str] | None:
    """All strings (lower case) that the tokens match, or None if too many or unknown."""
    out = {""}
    for op, arg in tokens:
        if op is sre.LITERAL:
            own = {_lower(arg)}
        elif op is sre.IN:
            own = set()
            for kind, a in arg:
                if kind is sre.LITERAL:
                    own.add(_lower(a))
                elif kind is sre.RANGE and a[1] - a[0] < _MOST:
                    own |= {_lower(c) for c in range(a[0], a[1] + 1)}
                else:
                    return None
        elif op is sre.SUBPATTERN:
            own = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(p) for p in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            own = _strings(arg[2])
            own = own | {""} if own is not None and arg[0] == 0 else own
        elif op is sre.AT:
            own = {""}
        else:
            return None
        if own is None or len(out) * len(own) > _MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def _query(tokens) -> object:
    """What any match of the tokens must contain."""
    needs, run = [], {""}

    def flush():
        needs.append(_join("or", [_of_string(s) for s in run]))

    for token in tokens:
        op, arg = token
        own = _strings([token])
        if own is not None and len(run) * len(own) <= _MOST:
            run = {a + b for a in run for b in own}
            continue
        flush()
        run = {""}
        if op is sre.SUBPATTERN:
            needs.append(_query(arg[3]))
        elif op is sre.BRANCH:
            needs.append(_join("or", [_query(p) for p in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            needs.append(_query(arg[2]))
        elif own is not None:
            run = own
    flush()
    return _join("and", needs)


def trigram_query(rule: Rule) -> object:
    return _query(sre_parse.parse(rule.pattern, re.ASCII))


def trigrams_of(query: object) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*[trigrams_of(q) for q in query[1]])


def answer(query: object, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Documents (of n) that satisfy the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, int):
        return postings.get(query, np.zeros(0, np.int64))
    parts = [answer(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def postings_of(texts: pa.Array, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Postings (trigram -> documents) of a segment, for trigrams flagged in ``wanted`` (by code)."""
    arr = text_column(texts)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset:]
    data = LOWER[np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]]]
    offsets = offsets - offsets[0]
    if len(data) < 3:
        return {}
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    at = np.flatnonzero(wanted[code])
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[doc + 1]
    key = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
    codes, docs = key >> 32, key & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(codes)) + 1
    return {int(c[0]): d for c, d in zip(np.split(codes, cuts), np.split(docs, cuts), strict=True) if len(c)}


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_spans(texts: pa.Array, rules, queries, wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule number, end) of each text, in order."""
    postings, found = postings_of(texts, wanted), [[] for _ in range(len(texts))]
    decoded: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        search = rule.regex().finditer
        for i in answer(query, postings, len(texts)).tolist():
            if i not in decoded:
                decoded[i] = texts[i].as_py() or ""
            for m in search(decoded[i]):
                if m.end() > m.start() and m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans) of every row; spans are sorted by start, then by the rules' order,
    in characters with an exclusive end."""
    queries = [trigram_query(r) for r in rules]
    codes = sorted(set().union(*[trigrams_of(q) for q in queries]))
    kinds = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        wanted = np.zeros(1 << 24, dtype=bool)
        wanted[codes] = True
        for batch in batches:
            for part in slices(batch, "_text"):
                found = find_spans(part.column("_text"), rules, queries, wanted)
                spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in one] for one in found]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(spans, kind)], names=["_key", "spans"])

    out = rows.mapInArrow(run, T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("spans", SPANS)]))
    return out.withColumnRenamed("_key", key)


def spans_text(spans: Column, kinds: list[str] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; of the given kinds only."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
