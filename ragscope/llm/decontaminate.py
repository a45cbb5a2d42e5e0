"""Benchmark decontamination with an FM-index per training shard.

Test items become windows of ``n`` consecutive words (a shorter item is one
window).  Each shard of documents (a slice of a partition) is indexed in the
task that reads it; all windows are searched backwards in the index, their
occurrences located, and the words they cover merged into removal spans.
Nothing is shuffled: only the windows travel, as broadcast blocks of at most
``block_bytes`` of item text.  A benchmark of more than one block is searched
block by block, each block's hits are written, and they are joined back by row.

Words no item has cannot be part of an occurrence; a run of them is one
separator in the indexed text.

Edge cases: null and empty texts have no words, on either side; a null item id
marks words but is not listed; items with the same id count once; a document
row given twice gets the same result twice; a null document id is carried on;
with an empty benchmark nothing is hit; other columns of ``docs`` are kept
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.fm_index import FMIndex
from ragscope.llm.jobs import row_id, saved
from ragscope.llm.memory import after_task
from ragscope.llm.words import ALNUM, Words, covered, find_words, slices

WINDOW = 10
#: Item text in one broadcast block.
BLOCK_BYTES = 8 << 20
P = "_d_"

_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
ADDED = [T.StructField(P + "words", T.LongType()), T.StructField(P + "spans", _SPANS), T.StructField(P + "items", T.ArrayType(T.StringType()))]


class Phrases:
    """Windows of a block of items: word hashes in use, windows as symbol rows by length, items of each window."""

    def __init__(self, items: list[tuple[object, str]], n: int = WINDOW):
        w = find_words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        self.words, symbol = np.unique(w.hashes, return_inverse=True)
        symbol = symbol.astype(np.int64) + 1
        windows: dict[tuple[int, ...], set] = {}
        for i, (item, _) in enumerate(items):
            own = symbol[w.first[i]: w.first[i + 1]].tolist()
            for at in range(max(1, len(own) - n + 1) if own else 0):
                windows.setdefault(tuple(own[at: at + n]), set()).add(None if item is None else str(item))
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in sorted({len(k) for k in windows}):
            rows = sorted(k for k in windows if len(k) == length)
            self.by_length[length] = (np.array(rows, dtype=np.int64), [sorted(x for x in windows[r] if x is not None) for r in rows])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word; 0 for words of no item."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def occurrences(w: Words, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[str]]]]:
    """(length, window numbers, word positions, items by window) of what occurs in the shard."""
    symbols = phrases.symbols(w.hashes)
    used = symbols > 0
    # a separator at each document's start and for each run of words that no item has
    opens = np.zeros(len(symbols), dtype=bool)
    opens[w.first[:-1][w.count > 0]] = True
    run = used & (opens | ~np.concatenate([[False], used[:-1]]))
    at = np.flatnonzero(used)
    if not len(at):
        return
    place = np.arange(len(at)) + np.cumsum(run)[at]
    text = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    text[place] = symbols[at]
    source = np.zeros(len(text), dtype=np.int64)
    source[place] = at
    index = FMIndex(text, len(phrases.words))
    for length, (rows, items) in phrases.by_length.items():
        which, found = index.occurrences(rows)
        yield length, which, source[found], items


def _hits(w: Words, phrases: Phrases) -> tuple[list, list]:
    """Merged word spans and items of each document."""
    flags, listed = np.zeros(len(w.start), dtype=bool), [set() for _ in range(w.n_docs)]
    for length, which, at, items in occurrences(w, phrases):
        flags |= covered(at, length, len(w.start))
        seen = np.unique(w.doc[at] * len(items) + which) if len(at) else at
        for pair in seen.tolist():
            listed[pair // len(items)].update(items[pair % len(items)])
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[w.first] = True
    before, after = np.concatenate([[False], flags[:-1]]), np.concatenate([flags[1:], [False]])
    first = np.flatnonzero(flags & (~before | edge[:-1]))
    last = np.flatnonzero(flags & (~after | edge[1:]))
    spans: list[list] = [[] for _ in range(w.n_docs)]
    for a, b, d in zip(first.tolist(), last.tolist(), w.doc[first].tolist(), strict=True):
        spans[d].append({"first": a - int(w.first[d]), "last": b - int(w.first[d])})
    return spans, [sorted(x) for x in listed]


def _search(docs: DataFrame, text: str, block, all_rows: bool) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *ADDED])

    def run(batches):
        phrases = block.value
        for batch in batches:
            for part in slices(batch, text):
                w = find_words(part.column(text), ALNUM, lower=True)
                spans, items = _hits(w, phrases)
                if not all_rows and not any(spans):
                    continue
                out = pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(w.count, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))],
                    names=[*part.schema.names, *[f.name for f in ADDED]])
                yield out if all_rows else out.filter(pa.array([bool(s) for s in spans]))

    return docs.mapInArrow(after_task(run), schema)


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def _merge(spans: list) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1] = {"first": out[-1]["first"], "last": max(out[-1]["last"], s["last"])}
        else:
            out.append({"first": s["first"], "last": s["last"]})
    return out


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_d_words`` (number of words), ``_d_spans`` (merged spans of hit
    words, both ends included) and ``_d_items`` (ids, as sorted strings, of items with
    occurring windows)."""
    spark = docs.sparkSession
    out, extra = None, []
    for block in _blocks(benchmark, item, item_text, block_bytes):
        phrases = spark.sparkContext.broadcast(Phrases(block, n))
        if out is None:
            out = _search(docs, text, phrases, True)
        else:
            rows = docs.select(row_id(F.col(key), F.col(text)).alias("_row"), F.col(text).alias("_text"))
            extra.append(saved(_search(rows, "_text", phrases, False).select("_row", P + "spans", P + "items"), "leaks"))
    if not extra:
        return out
    more = extra[0]
    for e in extra[1:]:
        more = more.unionByName(e)
    more = more.dropDuplicates().groupBy("_row").agg(
        F.flatten(F.collect_list(P + "spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list(P + "items"))).alias("_items"))
    merge = F.udf(_merge, returnType=_SPANS)  # a few spans of the rows that later blocks hit
    joined = out.withColumn("_own", row_id(F.col(key), F.col(text))).join(more, F.col("_own") == F.col("_row"), "left")
    hit = F.col("_row").isNotNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(P + "words"),
        F.when(hit, merge(F.concat(F.col(P + "spans"), F.coalesce("_spans", F.array().cast(_SPANS))))).otherwise(F.col(P + "spans")).alias(P + "spans"),
        F.when(hit, F.array_sort(F.array_union(F.col(P + "items"), F.col("_items")))).otherwise(F.col(P + "items")).alias(P + "items"))


def n_hit() -> object:
    """Number of hit words, from the spans."""
    return F.aggregate(F.col(P + "spans"), F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def cut(found: DataFrame, text: str = "text") -> DataFrame:
    """``find``'s rows with the removal spans cut from the text; rows that have no word left go.
    Clean rows keep their text unchanged."""
    names, schema = [c for c in found.columns if not c.startswith(P)], T.StructType([f for f in found.schema.fields if not f.name.startswith(P)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                spans = part.column(P + "spans").to_pylist()
                w = find_words(part.column(text), ALNUM, lower=True)
                texts, keep = part.column(text).to_pylist(), []
                for i, own in enumerate(spans):
                    left = int(w.count[i]) - sum(s["last"] - s["first"] + 1 for s in own)
                    keep.append(left > 0 or not own)
                    if not own:
                        continue
                    data, base, first = texts[i].encode(), int(w.offsets[i]), int(w.first[i])
                    pieces, at = [], 0
                    for s in own:
                        pieces.append(data[at: int(w.start[first + s["first"]]) - base])
                        at = int(w.end[first + s["last"]]) - base
                    texts[i] = (b"".join(pieces) + data[at:]).decode()
                kind = part.schema.field(text).type
                arrays = [pa.array(texts, kind) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    return found.mapInArrow(after_task(run), schema)
