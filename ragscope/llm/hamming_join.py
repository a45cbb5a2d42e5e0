"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set of word shingles gives a signature of ``VALUES`` minima, ``BITS``
bits each; a value of two signatures differs with probability about 1 - J.  The
join finds every pair of signatures that differ in at most ``DISTANCE`` values: the
signature is split into ``CHUNKS`` chunks, so by the pigeonhole principle such a pair
has a chunk with at most one differing value, and entering each chunk once
for every value left out enumerates that error.  Two sets with a Jaccard
similarity of 85 per cent lie beyond the distance with probability under 1e-5;
everything nearer is confirmed on full sets.

Equal sets are one set.  Groups of near copies share most keys, so pairs are not listed:

1. signatures, written; one row for each distinct set;
2. keys with two sets or more (counts combined before the shuffle), and the
   least set of each, its leader;
3. sets that share most keys with the same leader are put in blocks and compared
   with each other on full sets; links make first components;
4. only keys whose sets lie in several components are left.  Where a
   component has many sets of a key, the key's other sets ask all blocks that hold
   some of it; the rest of the key's sets are compared by signature, in cells of fixed size;
5. a set within the distance of sets of another block asks that block once, on full
   sets.  Final components.

Rows are dealt to tasks by counted rows and bytes, never by one key.  Tokens and set
identities are 64-bit hashes.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty
texts have an empty set, link with nothing and are their own component; a null
id is a component's id only if all its ids are null; repeated rows are equal sets; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.blobs import ranges
from ragscope.llm.bloom import bloom_of
from ragscope.llm.components import components
from ragscope.llm.jobs import row_id, saved
from ragscope.llm.ngram_join import set_id, token_sets
from ragscope.llm.words import mix, slices

SHINGLE, THRESHOLD = 5, 85
VALUES, BITS, CHUNKS = 64, 16, 12
#: Differing values of a signature; 2 * CHUNKS - 1 at most, so that one chunk has one or none.
DISTANCE = 23
#: Sets of a block, sets that ask a block in one task, sets of one key in a cell.
BLOCK, QUERIES, TOGETHER = 256, 1024, 1024
#: Sets of one component with the same key from which the key's other sets ask the component.
MANY = 64
#: Rows and bytes of sets in one task.
TASK_ROWS, TASK_BYTES = 100_000, 24 << 20

_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_CUTS = [len(x) for x in np.array_split(np.arange(VALUES), CHUNKS)]


# -- signatures ---------------------------------------------------------------------------

def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit minima of each set (one row a set; zeros for an empty one)."""
    out = np.zeros((len(sets), VALUES), "<u2")
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        tokens = np.concatenate([sets[i] for i in some])
        first = np.cumsum([0, *[len(sets[i]) for i in some[:-1]]])
        for k, seed in enumerate(_SEEDS):
            out[some, k] = (np.minimum.reduceat(tokens * seed, first) >> np.uint64(64 - BITS - 24)).astype("<u2")
    return out


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """For each signature a key for each chunk and each value of it left out."""
    out, at = np.empty(signs.shape, np.uint64), 0
    values = mix(signs.astype(np.uint64) + (np.arange(VALUES, dtype=np.uint64) << np.uint64(BITS)))
    for size in _CUTS:
        whole = values[:, at: at + size].sum(axis=1, dtype=np.uint64)
        for j in range(at, at + size):  # the sum of the others, marked with the place left out
            out[:, j] = mix(whole - values[:, j] + np.uint64(j))
        at += size
    return out


def distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (others != one).sum(axis=1)


def _alike(n, m, t: int):
    """Whether sets of these sizes can reach the threshold."""
    return (100 * np.minimum(n, m)) >= t * np.maximum(n, m)


def _signed(rows: DataFrame, n: int) -> DataFrame:
    """(_key, _row, n, sid, sig) of every document."""
    schema = T.StructType([rows.schema["_key"], *[T.StructField(c, T.LongType()) for c in ("_row", "n", "sid")], T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = token_sets(part.column("_text"), n)
                signs = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column("_key"), part.column("_row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([x.tobytes() for x in signs], pa.binary())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _sign_matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u2").reshape(-1, VALUES)


def _entries(distinct: DataFrame) -> DataFrame:
    """(key, sid): every set under each of its keys."""

    def run(batches):
        for batch in batches:
            keys = chunk_keys(_sign_matrix(batch.column("sig").to_pylist()))
            sid = np.repeat(batch.column("sid").to_numpy(zero_copy_only=False), VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(sid, pa.int64())], names=["key", "sid"])

    return distinct.select("sid", "sig").mapInArrow(run, "key long, sid long")


# -- full sets -------------------------------------------------------------------------------

def _sets(rows: DataFrame, distinct: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, size, set) of the wanted sets, from the texts of one document each."""
    own = saved(distinct.join(wanted.select("sid").distinct(), "sid").select(F.col("_row").alias("_want")), "wanted")
    keep = rows.sparkSession.sparkContext.broadcast(bloom_of(own))

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(keep.value.may_have(batch.column("_row").to_numpy(zero_copy_only=False))))
            for part in slices(some, "_text"):
                sets = token_sets(part.column("_text"), n)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["_row", "sid", "size", "set"])

    made = rows.select("_row", "_text").mapInArrow(run, "_row long, sid long, size long, set binary")
    out = saved(made.join(own, F.col("_row") == F.col("_want"), "left_semi").dropDuplicates(["sid"]).select("sid", "size", "set"), "sets")
    keep.destroy()
    return out


class Block:
    """Sets compared together: their tokens' union with the sets that have each token."""

    def __init__(self, sets: list[np.ndarray], t: int):
        self.t, self.sizes = t, np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.member, self.many = np.repeat(np.arange(len(sets)), self.sizes)[order], np.diff(np.append(self.first, len(tokens)))

    def linked(self, q: np.ndarray) -> np.ndarray:
        """Which of the block's sets link with a set."""
        fits = _alike(len(q), self.sizes, self.t)
        least = -(-self.t * (len(q) + self.sizes) // (100 + self.t))  # 100 i >= t (x + y - i)
        at = np.minimum(np.searchsorted(self.union, q), len(self.union) - 1)
        at = at[self.union[at] == q]
        if not fits.any() or len(at) < least[fits].min():
            return np.zeros(0, np.int64)
        shared = np.bincount(self.member[ranges(self.first[at], self.many[at])], minlength=len(self.sizes))
        return np.flatnonzero(fits & (shared >= least))


def _compare(rows: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Links (a, b) of the sets that ask with the sets of their block; ``rows``: block, part, asks, sid, name.
    Sets with a name are those asked, and a link gives the name, once for each set and name; where no set asks,
    all of a block do, and the links are as many as connect them."""
    rows = saved(rows.join(sets.select("sid", "size"), "sid"), "compared")
    shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) * 8 // TASK_BYTES))
    rows = rows.drop("size").join(sets.select("sid", "set"), "sid").withColumn("shard", F.pmod(F.xxhash64("block", "part"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        block, part, asks, sid, name = (table.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "asks", "sid", "name"))
        order = np.lexsort((part, block))
        blobs, found = table.column("set"), [np.zeros((2, 0), np.int64)]
        for group in np.split(order, np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(part[order]) != 0)) + 1):
            own = [np.frombuffer(blobs[i].as_py(), "<u8") for i in group.tolist()]
            members = np.flatnonzero(~asks[group])
            if not len(members):
                continue
            index, names = Block([own[m] for m in members.tolist()], t), name[group[members]]
            for k in np.flatnonzero(asks[group]).tolist() if asks[group].any() else members.tolist():
                new = np.unique(names[index.linked(own[k])])
                found.append(np.stack([np.full(len(new), sid[group[k]]), new]))
                if not asks[group[k]]:  # connected from now on
                    names[np.isin(names, new)] = new[0]
        a, b = np.concatenate(found, axis=1)
        apart = a != b
        return pa.table([pa.array(a[apart], pa.int64()), pa.array(b[apart], pa.int64())], names=["a", "b"])

    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "a long, b long")


# -- the join ------------------------------------------------------------------------------------

def _homes(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, block) of every set: sets that share most keys with the same leader, in blocks of about
    ``BLOCK``; and (sid, block) of what is compared together: the leader is in each of its blocks."""
    most = saved(shared.groupBy("sid", "leader").agg(F.count_if(F.col("sid") != F.col("leader")).alias("c")).groupBy("sid").agg(
        F.max(F.struct("c", "leader")).alias("best")).select("sid", F.col("best.leader").alias("leader")), "led")
    size = saved(most.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count_if(F.col("sid") != F.col("leader")).alias("others")), "groups")
    placed = saved(most.join(size, "leader").select("sid", "leader", "others", F.xxhash64("leader", F.pmod(F.xxhash64("sid"), "parts").cast("int")).alias("block")), "homes")
    leaders = size.where("others > 0").select(F.col("leader").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "sid", F.xxhash64("sid", "part").alias("block"))
    together = placed.where("others > 0 AND sid <> leader").select("sid", "block").unionByName(leaders)
    return placed.select("sid", "block"), together


def _open_keys(shared: DataFrame, labelled: DataFrame) -> DataFrame:
    """(key, sid, label, weight, block, many): entries of keys whose sets lie in several components;
    ``many``: how many sets of the component the key has."""
    with_label = saved(shared.select("key", "sid").join(labelled, "sid"), "labelled")
    several = saved(with_label.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "open")
    entries = saved(with_label.join(several, "key"), "open-entries")
    counts = saved(entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many")), "open-counts")
    return saved(entries.join(counts, ["key", "label"]), "open-counted")


def _ask_components(entries: DataFrame, labelled: DataFrame) -> DataFrame:
    """(sid, block): sets with a key that many sets of another component have ask that component's blocks."""
    large = saved(entries.where(F.col("many") > MANY).select("key", F.col("label").alias("other")).distinct(), "large")
    asking = entries.join(large, "key").where(
        (F.col("label") != F.col("other")) & ((F.col("many") <= MANY) | (F.col("label") > F.col("other")))).select("sid", F.col("other").alias("label")).distinct()
    blocks = saved(labelled.select("label", "block").distinct(), "component-blocks")
    return saved(asking, "asking").join(blocks, "label").select("sid", "block")


def near_blocks(c: dict[str, np.ndarray], signs: np.ndarray, t: int) -> np.ndarray:
    """(set, block of another) where the sets share a cell, lie in different components and blocks and are within
    the distance; the set of the smaller component (then block) asks.  A cell's ``low`` sets meet its ``high`` ones."""
    out = []
    order = np.argsort(c["cell"], kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(c["cell"][order])) + 1):
        rank = c["weight"][group], c["block"][group]
        group = group[np.lexsort(rank[::-1])]
        found = []
        for k, i in enumerate(group[:-1].tolist()):
            rest = group[k + 1:]
            rest = rest[(c["label"][rest] != c["label"][i]) & (c["block"][rest] != c["block"][i]) & _alike(c["n"][rest], c["n"][i], t)
                        & ((c["low"][i] & c["high"][rest]) | (c["low"][rest] & c["high"][i]))]
            if len(rest):
                found.append(np.unique(c["block"][rest[distances(signs[i], signs[rest]) <= DISTANCE]]))
                out.append(np.stack([np.full(len(found[-1]), c["sid"][i]), found[-1]], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _ask_sets(entries: DataFrame, distinct: DataFrame, t: int) -> DataFrame:
    """(sid, block): sets that share a key with sets of another component and block within the distance."""
    few = entries.where(F.col("many") <= MANY).select("key", "sid", "label", "weight", "block")
    size = saved(few.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")), "key-sizes")
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    placed = few.join(size, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = saved(placed.withColumn("cell", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).withColumn(
        "low", F.col("part") <= F.col("other")).withColumn("high", F.col("part") >= F.col("other")).drop("key", "parts", "part", "other"), "cells")
    shards = max(1, -(-placed.count() // TASK_ROWS))
    placed = placed.join(distinct.select("sid", "n", "sig"), "sid").withColumn("shard", F.pmod("cell", F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        columns = {x: table.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "sid", "label", "weight", "block", "n", "low", "high")}
        found = near_blocks(columns, _sign_matrix(table.column("sig").to_pylist()), t)
        return pa.table([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["sid", "block"])

    return placed.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "sid long, block long")


def _links(rows: DataFrame, distinct: DataFrame, n: int, t: int) -> DataFrame:
    """(node, component) of linked sets."""
    # the least set with a key leads the others; keys of one set go
    leaders = saved(_entries(distinct).groupBy("key").agg(F.min("sid").alias("leader"), F.max("sid").alias("last")).where("leader <> last").select("key", "leader"), "keys")
    shared = saved(_entries(distinct).join(leaders, "key"), "shared")
    homes, together = _homes(shared)
    sets = _sets(rows, distinct, together, n)
    alone = together.select("block", F.lit(0).alias("part"), F.lit(False).alias("asks"), "sid", F.col("sid").alias("name"))
    first = saved(components(_compare(alone, sets, t)), "first")
    # what is still apart though it shares a key
    sized = saved(first.groupBy("component").agg(F.count(F.lit(1)).alias("weight")), "weights")
    member = saved(first.withColumnRenamed("node", "sid").join(sized, "component").withColumnRenamed("component", "label"), "members")
    labelled = saved(homes.join(member, "sid", "left").select(
        "sid", "block", F.coalesce("label", "sid").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight")), "components")
    entries = _open_keys(shared, labelled)
    asked = saved(_ask_components(entries, labelled).unionByName(_ask_sets(entries, distinct, t)).distinct(), "questions")
    many = saved(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")), "asked")
    told = labelled.join(many, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "sid", F.col("label").alias("name"))
    asking = asked.join(many, "block").select(
        "block", F.pmod(F.xxhash64("sid"), "parts").cast("int").alias("part"), F.lit(True).alias("asks"), "sid", F.col("sid").alias("name"))
    both = saved(told.unionByName(asking), "asked-and-told")
    more = _compare(both, _sets(rows, distinct, both, n), t)
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id): one row per row of ``docs``; the component's id is the smallest
    key that links reach.  ``t`` is the similarity in per cent, 85 at least: the distance is made for that."""
    if t < THRESHOLD:
        raise ValueError(f"signatures find pairs from {THRESHOLD} per cent on")
    rows = docs.select(F.col(key).alias("_key"), row_id(F.col(key), F.col(text)).alias("_row"), F.col(text).alias("_text"))
    found = saved(_signed(rows, n), "signed")
    distinct = saved(found.where("n > 0").select("sid", "_row", "n", "sig").dropDuplicates(["sid"]), "distinct")
    comps = _links(rows, distinct, n, t)
    own = found.drop("sig").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("_label", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
    own = saved(own.select("_key", "n", "_label"), "labels")
    least = saved(own.where("n > 0").groupBy("_label").agg(F.min("_key").alias("least")).withColumnRenamed("_label", "l"), "least")
    return own.join(least, F.col("_label") == F.col("l"), "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_key")).alias("component_id"))
