"""Substring dedup by relative Lempel-Ziv parsing against sharded reference blocks.

The reference holds every ``WINDOW``-word window of the corpus once, at its first
place: the smallest id, there the first word.  Each document is parsed from left to
right: at a word whose window has a place in an earlier document the factor is the
longest stretch of words that runs on from that place (unique, since the reference
has each window once), and parsing goes on behind it; other words are literals.
Windows that begin in a factor but reach over its end are checked at that boundary,
and become factors of their own (``boundary``).  Every factor is one passage of its
reference document, of ``WINDOW`` words at least; the words of factors are duplicates,
which are just the words of all repeated windows.

The reference is indexed in blocks, one per shard of a hash space.  Every window
is filed under its minimizer (the smallest hash of the ``SEED``-word seeds in it):
equal windows have equal minimizers, so a window meets all its equals in one
block, and neighbouring windows mostly share a minimizer, so a block entry is a
run of windows: 8 bytes of seed, its place, and 6 bytes a window (equality is that
of 112 bits: the seed's hash and the window's).

Jobs: (1) index entries as packed arrays, one blob per task slice and block;
(2) each block finds the first place of every window that has several and
answers the later ones with stretches of places; (3) answers join their documents
by row identity, and each document is parsed.
A seed that many documents of one slice have (``HOT`` runs) sends one entry per
distinct window instead of one per document; its documents get their answers in
a second pass that joins them with the blocks' results, so a passage that a
third of all documents share is never gathered in one task.

Edge cases: null and empty texts have no words and come out unchanged; fewer
than ``WINDOW`` words: nothing removed; a null id counts as larger than all ids;
rows with the same id do not remove each other's words (a place is in one of them,
told by the row's hash); rows equal in id and text get the same result each; a
reference text that repeats itself has each window once, so its later repeats are
factors of the first; ids must be integers; other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.blobs import pack_arrays, ranges, split_by, unpack_arrays
from ragscope.llm.jobs import row_id, saved, shard_count
from ragscope.llm.words import SLICE_BYTES, Words, covered, find_words, mix, ngram_hashes, slices

WINDOW, SEED = 13, 5
#: Runs of one seed in one slice from which the seed is sent pre-aggregated.
HOT = 64
P = "_s_"
_LAST = np.iinfo(np.int64).max  # a null id

#: Neighbouring windows and the neighbouring places they have in one earlier row: ``row`` is 32 bits of its hash.
_RUN = np.dtype([("start", "<u4"), ("len", "<u4"), ("at", "<u4"), ("row", "<u4"), ("ref", "<i8")])
#: Hot windows with their first place in a slice or block: seed, window, id, row, word.
_PLACES = ("<u8", "<u8", "<i8", "<i8", "<u4")
_FACTOR = [("start", pa.int64()), ("length", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64()), ("boundary", pa.bool_())]
FACTORS = T.ArrayType(T.StructType([T.StructField(c, T.BooleanType() if c == "boundary" else T.LongType()) for c, _ in _FACTOR]))
_FACTORS_ARROW = pa.list_(pa.struct(_FACTOR))


# -- windows and their minimizers -------------------------------------------------------

def window_runs(w: Words, n: int = WINDOW, k: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one minimizer: (seed hash, first word,
    windows) of each run, and the 48-bit hashes of all windows in order."""
    at = w.room(n)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    seeds = np.zeros(len(w.start), dtype=np.uint64)
    room = w.room(k)
    seeds[room] = ngram_hashes(w.hashes, room, k)
    order = mix(seeds)
    best, where = order[at].copy(), at.copy()
    for d in range(1, n - k + 1):
        other = order[at + d]
        less = other < best
        best[less] = other[less]
        where[less] = at[less] + d
    head = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    count = np.diff(np.append(head, len(at)))
    tails = ngram_hashes(w.hashes, at, n) >> np.uint64(16)
    return seeds[where[head]], at[head], count, tails


def _entries(part: pa.RecordBatch, shards: int, hot: int, details: bool) -> Iterator[tuple[int, bytes]]:
    """(block, blob) of a slice: its index entries, or with ``details`` the runs of its hot seeds."""
    w = find_words(part.column("_text"))
    seed, first, count, tails = window_runs(w)
    if not len(seed):
        return
    ids = part.column("_key").fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = part.column("_row").to_numpy(zero_copy_only=False)
    doc, at = w.doc[first], np.cumsum(count) - count
    start = first - w.first[doc]
    _, which, runs = np.unique(seed, return_inverse=True, return_counts=True)
    is_hot = runs[which] >= hot
    block = (seed >> np.uint64(33)).astype(np.int64) % shards

    def blob(pick: np.ndarray) -> bytes:
        docs, local = np.unique(doc[pick], return_inverse=True)
        own = tails[ranges(at[pick], count[pick])]
        return pack_arrays(
            seed[pick], np.diff(local, prepend=0).astype("<i4"), start[pick].astype("<u4"), count[pick].astype("u1"),
            own.astype("<u4"), (own >> np.uint64(32)).astype("<u2"), np.diff(ids[docs], prepend=0), rows[docs])

    if details:
        for b, pick in split_by(block[is_hot]):
            yield b, blob(np.flatnonzero(is_hot)[pick])
        return
    summary: dict[int, tuple] = {}
    if is_hot.any():
        chosen = np.flatnonzero(is_hot)
        own = np.repeat(chosen, count[chosen])
        place = ranges(at[chosen], count[chosen])
        word = start[own] + place - at[own]
        order = np.lexsort((word, rows[doc[own]], ids[doc[own]], tails[place], seed[own]))
        own, place, word = own[order], place[order], word[order]
        new = np.concatenate([[True], (seed[own][1:] != seed[own][:-1]) | (tails[place][1:] != tails[place][:-1])])
        own, place, word = own[new], place[new], word[new]
        summary = {b: (seed[own[p]], tails[place[p]], ids[doc[own[p]]], rows[doc[own[p]]], word[p].astype("<u4"))
                   for b, p in split_by((seed[own] >> np.uint64(33)).astype(np.int64) % shards)}
    normal = {b: np.flatnonzero(~is_hot)[p] for b, p in split_by(block[~is_hot])}
    none = tuple(np.zeros(0, d) for d in _PLACES)
    for b in normal.keys() | summary.keys():
        yield b, pack_arrays(*[np.frombuffer(blob(normal.get(b, np.zeros(0, np.int64))), "u1")], *summary.get(b, none))


def _index(docs: DataFrame, shards: int, hot: int, details: bool) -> DataFrame:
    """(block, entries) of all slices."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                found = list(_entries(part, shards, hot, details))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([e for _, e in found], pa.binary())],
                                                     names=["block", "entries"])

    return docs.select("_row", "_key", "_text").mapInArrow(run, "block int, entries binary")


class Runs:
    """Runs from several blobs, end to end."""

    def __init__(self, blobs: list[bytes]):
        parts, n = [], 0
        for blob in blobs:
            seed, step, start, count, low, high, ids, rows = unpack_arrays(blob, "<u8", "<i4", "<u4", "u1", "<u4", "<u2", "<i8", "<i8")
            tails = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
            parts.append((seed, np.cumsum(step, dtype=np.int64) + n, start, count, tails, np.cumsum(ids), rows))
            n += len(rows)
        empty = [np.zeros(0, d) for d in ("<u8", "<i8", "<u4", "u1", "<u8", "<i8", "<i8")]
        self.seed, self.doc, self.start, count, self.tails, self.ids, self.rows = (
            [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else empty)
        self.count = count.astype(np.int64)
        self.at = np.cumsum(self.count) - self.count


def _answers(run: np.ndarray, offset: np.ndarray, ref: np.ndarray, row: np.ndarray, at: np.ndarray, r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Document rows, and records of windows (run number, place in the run) whose first
    place is word ``at`` of the row ``row`` with the id ``ref``."""
    start = r.start[run].astype(np.int64) + offset
    head = np.ones(len(run), dtype=bool)
    head[1:] = (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1) | (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(head)
    rec = np.zeros(len(first), _RUN)
    rec["start"], rec["len"], rec["ref"] = start[first], np.diff(np.append(first, len(run))), ref[first]
    rec["at"], rec["row"] = at[first], (row[first] & 0xFFFFFFFF)
    return r.rows[r.doc[run[first]]], rec


def _by_bucket(rows: np.ndarray, records: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Answers packed by bucket of document rows."""
    out = [(k, pack_arrays(rows[at], records[at])) for k, at in split_by(rows % buckets)]
    return [k for k, _ in out], [b for _, b in out]


def _merged(table: pa.Table) -> pa.Table:
    """One row per document of a bucket: all its records, each once."""
    parts = [unpack_arrays(b, "<i8", _RUN) for b in table.column("answer").to_pylist()]
    rows, rec = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((rec["start"], rows))
    rows, rec = rows[order], rec[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (rec[1:] != rec[:-1])
    rows, rec = rows[keep], rec[keep]
    head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    ends = np.append(head[1:], len(rows)).tolist()
    return pa.table([pa.array(rows[head], pa.int64()), pa.array([rec[a:b].tobytes() for a, b in zip(head.tolist(), ends, strict=True)], pa.binary())],
                    names=["row", "records"])


def _solve_block(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes | None]:
    """Answers of a block, and its results for windows of hot seeds."""
    inner, sums = [], []
    for blob in blobs:
        runs, *places = unpack_arrays(blob, "u1", *_PLACES)
        inner.append(runs.tobytes())
        sums.append(places)
    r = Runs(inner)
    hot_seed, hot_tail, hot_id, hot_row, hot_at = (np.concatenate(c) for c in zip(*sums, strict=True))
    # seeds of one entry only have nothing to compare
    seeds = np.concatenate([r.seed, hot_seed])
    _, rank, many = np.unique(seeds, return_inverse=True, return_counts=True)
    keep = many[rank] > 1
    keep[len(r.seed):] = True
    run = np.flatnonzero(keep[: len(r.seed)])
    own = np.repeat(run, r.count[run])
    place = ranges(r.at[run], r.count[run])
    offset = place - r.at[own]
    tail = np.unique(np.concatenate([r.tails[place], hot_tail]), return_inverse=True)[1]
    key = np.concatenate([rank[own], rank[len(r.seed):]]).astype(np.int64) << 32 | tail.astype(np.int64)
    # places in order: rows by id and hash, then words
    ids, rows = np.concatenate([r.ids, hot_id]), np.concatenate([r.rows, hot_row])
    order = np.lexsort((rows, ids))
    rank_of = np.empty(len(order), np.int64)
    rank_of[order] = np.arange(len(order))
    doc = np.concatenate([r.doc[own], np.arange(len(r.ids), len(ids))])
    word = np.concatenate([r.start[own].astype(np.int64) + offset, hot_at.astype(np.int64)])
    windows, which = np.unique(key, return_inverse=True)
    least = np.full(len(windows), _LAST, np.int64)
    np.minimum.at(least, which, rank_of[doc] << 32 | word)
    first = least[which]
    source, at = order[first >> 32], first & 0xFFFFFFFF
    later = np.flatnonzero(ids[doc[: len(own)]] > ids[source[: len(own)]])
    answered, records = _answers(own[later], offset[later], ids[source[later]], rows[source[later]], at[later], r)
    result = None
    if len(hot_seed):
        source, at = source[len(own):], at[len(own):]
        _, one = np.unique(key[len(own):], return_index=True)
        result = pack_arrays(hot_seed[one], hot_tail[one], ids[source[one]], rows[source[one]], at[one].astype("<u4"))
    return answered, records, result


def _solve(index: DataFrame, buckets: int) -> DataFrame:
    """(hot, key, answer): answers by bucket of documents, or results for hot windows by block."""

    def run(table: pa.Table) -> pa.Table:
        rows, records, result = _solve_block(table.column("entries").to_pylist())
        key, answer = _by_bucket(rows, records, buckets)
        hot = [False] * len(key)
        if result is not None:
            hot, key, answer = [*hot, True], [*key, table.column("block")[0].as_py()], [*answer, result]
        return pa.table([pa.array(hot, pa.bool_()), pa.array(key, pa.int64()), pa.array(answer, pa.binary())], names=["hot", "key", "answer"])

    return index.groupBy("block").applyInArrow(run, "hot boolean, key long, answer binary")


def _look_up(details: DataFrame, results: DataFrame, buckets: int) -> DataFrame:
    """Answers for the documents of hot seeds: their runs join the results of their block."""

    def run(batches):
        for batch in batches:
            for entries, result in zip(batch.column("entries").to_pylist(), batch.column("answer").to_pylist(), strict=True):
                r = Runs([entries])
                seed, tail, ref, row, word = unpack_arrays(result, *_PLACES)
                own = np.repeat(np.arange(len(r.seed)), r.count)
                seeds, tails = np.unique(seed), np.unique(tail)
                join = lambda s, t: np.searchsorted(seeds, s) << 32 | np.searchsorted(tails, t)
                key, asked = join(seed, tail), join(r.seed[own], r.tails)
                order = np.argsort(key)
                found = order[np.searchsorted(key[order], asked)]  # every window of a hot seed has a result
                later = np.flatnonzero(r.ids[r.doc[own]] > ref[found])
                found = found[later]
                answered = _answers(own[later], later - r.at[own[later]], ref[found], row[found], word[found].astype(np.int64), r)
                bucket, answer = _by_bucket(*answered, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(answer, pa.binary())], names=["key", "answer"])

    joined = details.join(results.select(F.col("key").cast("int").alias("block"), "answer"), "block")
    return joined.select("entries", "answer").mapInArrow(run, "key long, answer binary")


# -- parsing ---------------------------------------------------------------------------

def factors_of(records: bytes) -> list[tuple[int, int, int, int, bool]]:
    """Factors (start, length in words, id and first word of the passage, boundary) of a
    document, from its windows' places sorted by start: left to right, the longest at each word."""
    rec = np.frombuffer(records, _RUN)
    start, at = rec["start"].astype(np.int64), rec["at"].astype(np.int64)
    end = start + rec["len"]
    same = (start[1:] == end[:-1]) & (at[1:] - at[:-1] == start[1:] - start[:-1])
    same &= (rec["ref"][1:] == rec["ref"][:-1]) & (rec["row"][1:] == rec["row"][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    last = end[np.append(head[1:], len(rec)) - 1]
    out, reached = [], 0
    for a, b, ref, word in zip(start[head].tolist(), last.tolist(), rec["ref"][head].tolist(), at[head].tolist(), strict=True):
        over = min(b, reached) - a
        if over > 0:  # these windows begin in the last factor and reach over its end
            out.append((a, over + WINDOW - 1, ref, word, True))
        at_word = max(a, reached)
        if at_word < b:
            reached = b + WINDOW - 1
            out.append((at_word, reached - at_word, ref, word + at_word - a, False))
    return out


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = None, hot: int = HOT) -> DataFrame:
    """``docs`` with ``_s_words`` (words before), ``_s_removed`` (words that factors
    cover), ``_s_factors`` (start, length, ref, ref_start: first word, number of words, id
    of the earlier document, first word there; boundary: found at a factor's end) and
    ``_s_kept`` (the other words, joined by one space)."""
    spark = docs.sparkSession
    rows = docs.select(row_id(F.col(key), F.col(text)).alias("_row"), F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    shards = shards or shard_count(spark, 1)
    solved = saved(_solve(_index(rows, shards, hot, False), shards), "blocks")
    answers = solved.where("NOT hot").select("key", "answer")
    results = solved.where("hot")
    if not results.isEmpty():
        answers = answers.unionByName(_look_up(_index(rows, shards, hot, True), results, shards))
    by_row = answers.groupBy("key").applyInArrow(_merged, "row long, records binary").select(F.col("row").alias("_s_row"), F.col("records").alias("_s_answers"))
    names = docs.columns
    packed = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in docs.schema.fields] + [T.StructField("_s_own", T.LongType())])

    def compress(batches):
        for batch in batches:
            for part in slices(batch, text):
                small = zstandard.ZstdCompressor(level=1)
                texts = pa.array([None if x is None else small.compress(x.encode()) for x in part.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([texts if c == text else part.column(c) for c in part.schema.names], names=part.schema.names)

    # texts travel compressed: they are most of what the join shuffles
    sent = docs.withColumn("_s_own", row_id(F.col(key), F.col(text))).mapInArrow(compress, packed)
    joined = sent.join(by_row, F.col("_s_own") == F.col("_s_row"), "left")
    text_type, names_of = pa.string(), [c for c, _ in _FACTOR]
    added = [T.StructField(P + "words", T.LongType()), T.StructField(P + "removed", T.LongType()), T.StructField(P + "factors", FACTORS), T.StructField(P + "kept", T.StringType())]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES // 4):
                open_ = zstandard.ZstdDecompressor()
                texts = [None if x is None else open_.decompress(x).decode() for x in part.column(text).to_pylist()]
                answers = part.column("_s_answers").to_pylist()
                count, removed, factors, kept = [], [], [], []
                for value, own in zip(texts, answers, strict=True):
                    words = (value or "").encode().split()
                    found = factors_of(own) if own else []
                    gone = covered(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), len(words))
                    count.append(len(words))
                    removed.append(int(gone.sum()))
                    factors.append([dict(zip(names_of, f, strict=True)) for f in found])
                    kept.append(b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if own else words).decode())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(texts, text_type) if c == text else part.column(c) for c in names], pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, _FACTORS_ARROW), pa.array(kept, pa.string())],
                    names=[*names, *[f.name for f in added]])

    return joined.select(*[F.col(f"`{c}`") for c in names], "_s_answers").mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
