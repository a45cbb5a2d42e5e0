"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of ``WINDOW`` lines marks places in a document:
some start a chunk, some end one.  A chunk runs from the first line of a start to
the last line of the nearest end at or after it, with no other start between, so what
is a chunk depends on its own lines alone: a passage that moves, or sits in another
document, has the same chunks whatever stands around it.  ``SEEDS`` independent markings are laid over
each other.  Chunks that occur more than once anywhere are repeats of their first
occurrence (by document id, then position) once their bytes have been compared.
Each repeat is then extended line by line over equal lines on both sides, as far
as the next chunk of the marking: beyond it that chunk decides.  All lines of
extended repeats are cut.  A repeat that overlaps its first occurrence stays.
Every line that is cut equals one at an earlier place, so the first of all
copies of a line is never lost.

Jobs: (1) count chunk hashes - small rows, combined before the shuffle; (2) the
bytes of chunks with a repeated hash and the lines around them up to the next
chunks, joined by hash (a Bloom filter of fixed size keeps most others from being
shuffled); (3) first occurrence of each distinct byte string, and a join on the
bytes themselves; (4) documents joined with their removed lines.  Joins are plain
equi-joins, so a hash that a third of all documents share is split by the
optimiser's skew handling.  A line is in at most two chunks of a marking and around
two, whatever the text, so what is sent grows with the text.

Edge cases: null and empty texts have no chunk and stay; a chunk without a word
(blank lines) is no repeat; rows equal in id and text are one document and
get the same result; a document with a null id counts as the last; other
columns of ``docs`` are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.bloom import bloom_of
from ragscope.llm.jobs import row_id, saved
from ragscope.llm.memory import after_task
from ragscope.llm.words import mix, slices

#: Lines the rolling hash looks at; markings laid over each other; share of places that are
#: a start, and that are an end, of one marking (a two-line passage is a chunk with 1 - (1 - MARKED**2)**SEEDS).
WINDOW, SEEDS, MARKED = 2, 3, 7 / 8
P = "_l_"
_BASE = 0x9E3779B97F4A7C15
_BLANK = b" \t\n\v\f\r"


def _rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n neighbouring lines."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = out * np.uint64(_BASE) + hashes[j: j + len(out)]
    return out


def find_chunks(lines: list[bytes], first: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of documents; document i has the lines ``first[i]:first[i + 1]``.  ``at`` and ``end`` are a
    chunk's lines, ``before`` and ``after`` how many lines there are up to the
    next chunks of the marking, ``doc`` the document."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rolling = _rolling(hashes, WINDOW)
    inside = doc[: len(rolling)] == doc[WINDOW - 1:] if len(rolling) else np.zeros(0, bool)
    parts, bound = [], np.uint64(int(MARKED * (1 << 32)))
    for seed in range(SEEDS):
        value = mix(rolling + np.uint64((seed + 1) * _BASE % (1 << 64)))
        starts = np.flatnonzero(inside & (value >> np.uint64(32) < bound))
        ends = np.flatnonzero(inside & (value & np.uint64(0xFFFFFFFF) < bound))
        nearest = np.searchsorted(ends, starts)
        ok = nearest < len(ends)
        place = ends[nearest[ok]]
        ok[ok] = (doc[place] == doc[starts[ok]]) & (np.concatenate([starts[1:], [len(lines)]])[ok] > place)
        at, end = starts[ok], ends[nearest[ok]] + WINDOW
        own = doc[at]
        left = np.maximum(np.concatenate([[-1], at[:-1]])[: len(at)], first[own] - 1)
        right = np.minimum(np.concatenate([end[1:] - 1, [len(lines)]])[: len(at)], first[own + 1])
        parts.append((at, end, at - left - 1, right - end))
    at, end, before, after = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    order = np.lexsort((end, at))
    at, end, before, after = (x[order] for x in (at, end, before, after))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (end[1:] != end[:-1])])) if len(at) else np.zeros(0, np.int64)
    if len(at):
        before, after = np.maximum.reduceat(before, new), np.maximum.reduceat(after, new)
        at, end = at[new], end[new]
    words = np.concatenate([[0], np.cumsum([bool(x.strip(_BLANK)) for x in lines])])
    has = words[end] > words[at]
    at, end, before, after = (x[has] for x in (at, end, before, after))
    return {"at": at, "end": end, "before": before, "after": after, "doc": doc[at], "hash": _span_hashes(hashes, at, end)}


def _span_hashes(hashes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lines of each span, from running sums of line hashes times powers of an odd number."""
    back = pow(_BASE, -1, 1 << 64)
    power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), b, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power(_BASE)[:-1], dtype=np.uint64)])
    return mix((total[end] - total[at]) * power(back)[at] + (end - at).astype(np.uint64)).view(np.int64)


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, dict[str, np.ndarray]]]:
    """Slices of a batch with their lines and chunks."""
    for part in slices(batch, "_text"):
        texts = [(t or "").encode().split(b"\n") for t in part.column("_text").to_pylist()]
        first = np.cumsum([0, *map(len, texts)])
        lines = [x for t in texts for x in t]
        yield part, lines, first, find_chunks(lines, first)


def _hash_rows(docs: DataFrame) -> DataFrame:
    """(hash) of every chunk."""
    def run(batches):
        for batch in batches:
            for *_, c in _chunked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c["hash"], pa.int64())], names=["hash"])

    return docs.select("_text").mapInArrow(after_task(run), "hash long")


def _body_rows(docs: DataFrame, wanted) -> DataFrame:
    """The chunks that pass the filter ``wanted`` of hashes, with their bytes and the lines around them
    (``before``: nearest first)."""
    lists = T.ArrayType(T.BinaryType())
    schema = T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("_key", docs.schema["_key"].dataType),
        T.StructField("at", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("hash", T.LongType()),
        T.StructField("bytes", T.BinaryType()), T.StructField("before", lists), T.StructField("after", lists)])
    names = [f.name for f in schema.fields]

    def out(part, c, pick, bodies, before, after, first):
        own, kind = pa.array(c["doc"][pick]), pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([
            part.column("_row").take(own), part.column("_key").take(own),
            pa.array(c["at"][pick] - first[c["doc"][pick]], pa.int32()), pa.array((c["end"] - c["at"])[pick], pa.int32()),
            pa.array(c["hash"][pick], pa.int64()), pa.array(bodies, pa.binary()), pa.array(before, kind), pa.array(after, kind)], names=names)

    def run(batches):
        for batch in batches:
            for part, lines, first, c in _chunked(batch):
                may = np.flatnonzero(wanted.value.may_have(c["hash"]))
                bodies, before, after, size, done = [], [], [], 0, 0
                for n, i in enumerate(may.tolist()):
                    at, end = int(c["at"][i]), int(c["end"][i])
                    bodies.append(b"\n".join(lines[at:end]))
                    before.append(lines[at - int(c["before"][i]): at][::-1])
                    after.append(lines[end: end + int(c["after"][i])])
                    size += len(bodies[-1]) + sum(map(len, before[-1])) + sum(map(len, after[-1]))
                    if size > 4 << 20:
                        yield out(part, c, may[done: n + 1], bodies, before, after, first)
                        bodies, before, after, size, done = [], [], [], 0, n + 1
                if bodies:
                    yield out(part, c, may[done:], bodies, before, after, first)

    return docs.mapInArrow(after_task(run), schema)


def _common(a: Column, b: Column) -> Column:
    """How many lines two lists have in common from their start on."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, spans) for documents with lines to remove; a span is (at, lines)."""
    rows = docs.select(row_id(F.col(key), F.col(text)).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    # both small sides are written first: next to an aggregate the optimiser cannot split a hot hash
    often = saved(_hash_rows(rows).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(often))
    bodies = saved(_body_rows(rows, wanted).join(often, "hash", "left_semi"), "chunks")
    place = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("_row").alias("row"), F.col("at"), "before", "after")
    first = saved(bodies.groupBy("hash", "bytes").agg(F.min(place).alias("first")), "first")
    gone = bodies.join(first, ["hash", "bytes"]).where(
        ~(F.col("_row").eqNullSafe(F.col("first.row")) & (F.col("at") < F.col("first.at") + F.col("lines"))))
    spans = gone.withColumn("_left", _common(F.col("before"), F.col("first.before"))).withColumn("_right", _common(F.col("after"), F.col("first.after")))
    span = F.struct((F.col("at") - F.col("_left")).alias("at"), (F.col("lines") + F.col("_left") + F.col("_right")).alias("lines"))
    return spans.select("_row", span.alias("span")).distinct().groupBy("_row").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with extended repeats cut from the text, and ``_l_lines`` (lines before)
    and ``_l_removed`` (lines cut)."""
    spans = repeated_chunks(docs, key, text).select(F.col("_row").alias("_l_row"), F.col("spans").alias("_l_spans"))
    joined = docs.withColumn("_l_own", row_id(F.col(key), F.col(text))).join(spans, F.col("_l_own") == F.col("_l_row"), "left")
    docs_names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(P + "lines", T.LongType()), T.StructField(P + "removed", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(text).to_pylist(), batch.column("_l_spans").to_pylist()
            count, removed = [], []
            for i, own in enumerate(spans):
                value = texts[i]
                count.append(value.count("\n") + 1 if value else 0)
                removed.append(0)
                if own:
                    lines, at, keep = value.split("\n"), 0, []
                    for s in sorted(own, key=lambda s: s["at"]):
                        keep += lines[at: s["at"]]
                        at = max(at, s["at"] + s["lines"])
                    keep += lines[at:]
                    removed[-1] = len(lines) - len(keep)
                    texts[i] = "\n".join(keep)
            columns = [pa.array(texts, batch.schema.field(text).type) if c == text else batch.column(c) for c in docs_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed, pa.int64())],
                                             names=[f.name for f in schema.fields])

    return joined.select(*[F.col(f"`{c}`") for c in docs_names], "_l_spans").mapInArrow(after_task(run), schema)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated chunks; a document of which no word is left goes."""
    out = remove_repeats(docs, key, text)
    return out.where((F.col(P + "removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
