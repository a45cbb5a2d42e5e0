"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity is
at least ``THRESHOLD`` per cent.  Equal sets are one set.  Sets are partitioned
into groups of similar ones (at most about ``GROUP`` sets); each group keeps the
union of its tokens.  A query set meets only groups that share one of its
prefix tokens; the overlap with the group's union bounds the similarity to every
member, and only groups whose bound reaches the threshold are opened and their
members compared.  Links inside a group are found first; after that a set is
a query only to groups with sets it is not connected with yet, so components
come out exact without all pairs of a large group of copies.

Prefix tokens: of a set of n tokens in one global order, the first
p + k with p = n - ceil(t n) + 1 and k = p / 2; two linked sets share at least
k + 1 of them (for the k of the smaller one).  The order puts tokens of
high document frequency last, by a count sketch of fixed size (2**18 counters);
the sketch decides only the order, not the result.

Jobs: (1) set sizes and identities, and the sketch; (2) prefix tokens, by shards
of the hash space, tell sets that share one; (3) token sets of those, in groups,
with the links inside; (4) queries to groups; (5) components.  Tokens are 64-bit
hashes of shingles.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty
texts have an empty set, link with nothing and are their own component; a null
id is never a component's smallest id unless all are null; repeated rows are
links of similarity 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.blobs import pack_arrays, ranges, split_by, unpack_arrays
from ragscope.llm.bloom import bloom_of
from ragscope.llm.components import components
from ragscope.llm.jobs import row_id, saved, shard_count
from ragscope.llm.memory import after_group, after_task
from ragscope.llm.words import find_words, ngram_hashes, slices

SHINGLE, THRESHOLD = 4, 85
#: Sets of a group; sets of one slice with a common prefix token from which the token is answered in the slice.
GROUP, HOT = 256, 64
#: Queries that meet a group in one task.
QUERIES = 1024
_BITS = 18
_SLOTS = 64


def needed(x: np.ndarray | int, y: np.ndarray | int, t: int = THRESHOLD):
    """Least intersection of linked sets of x and y tokens: 100 i >= t (x + y - i)."""
    return -((-t * (x + y)) // (100 + t))


def prefix_length(n, t: int = THRESHOLD):
    return n - -(-t * n // 100) + 1


def extra(n, t: int = THRESHOLD):
    """Prefix tokens beyond the p that must share one; with them k + 1 must be shared."""
    return prefix_length(n, t) // 2


def least_shared(n, t: int = THRESHOLD):
    """Prefix tokens that a set of n tokens shares with any set it links with."""
    return extra(-(-t * n // 100), t) + 1


def token_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = find_words(texts, lower=True)
    at = w.room(n)
    h = ngram_hashes(w.hashes, at, n)
    cut = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
    out = []
    for i in range(w.n_docs):
        if w.count[i] >= n:
            out.append(np.unique(h[cut[i]: cut[i + 1]]))
        elif w.count[i]:
            out.append(ngram_hashes(w.hashes, w.first[i: i + 1], int(w.count[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (h >> 63 << 64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - _BITS)).astype(np.int64)


# -- job 1: identities and the sketch ---------------------------------------------------

def _identities(rows: DataFrame, n: int) -> DataFrame:
    """(_key, _row, n, sid, slot, counts): a row for each document, and the task's token counts by slot."""
    schema = T.StructType([rows.schema["_key"], *[T.StructField(c, T.LongType()) for c in ("_row", "n", "sid")],
                           T.StructField("slot", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        counts, key_type = np.zeros(1 << _BITS, np.int64), None
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = token_sets(part.column("_text"), n)
                if sets:
                    counts += np.bincount(_bucket(np.concatenate(sets)), minlength=1 << _BITS)
                key_type, size = part.schema.field("_key").type, len(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column("_key"), part.column("_row"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) for s in sets], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        if key_type is not None:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(_SLOTS, key_type), *[pa.nulls(_SLOTS, pa.int64())] * 3, pa.array(range(_SLOTS), pa.int32()),
                pa.array([pack_arrays(c) for c in np.split(counts, _SLOTS)], pa.binary())], names=names)

    return rows.mapInArrow(after_task(run), schema)


def _sketch(found: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts (of fixed size)."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack_arrays(b, "<i8")[0] for b in table.column("counts").to_pylist())
        return pa.table([table.column("slot")[:1], pa.array([pack_arrays(total)], pa.binary())], names=["slot", "counts"])

    parts = found.where("slot IS NOT NULL").select("slot", "counts").groupBy("slot").applyInArrow(add, "slot int, counts binary").collect()
    return np.concatenate([unpack_arrays(p.counts, "<i8")[0] for p in sorted(parts)]) if parts else np.zeros(1 << _BITS, np.int64)


# -- job 2: sets that share a prefix token -------------------------------------------------

def prefix_of(tokens: np.ndarray, sketch: np.ndarray, t: int = THRESHOLD) -> np.ndarray:
    n = len(tokens)
    return tokens[np.lexsort((tokens, sketch[_bucket(tokens)]))[: prefix_length(n, t) + extra(n, t)]]


def _shard(tokens: np.ndarray, shards: int) -> np.ndarray:
    return (tokens % np.uint64(shards)).astype(np.int64)


def _prefixes(part: pa.RecordBatch, n: int, t: int, sketch: np.ndarray, shards: int, hot: int) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of a slice: prefix tokens with their sets, and answers for tokens that are frequent in it."""
    sets = {set_id(s): s for s in token_sets(part.column("_text"), n) if len(s)}
    if not sets:
        return
    sid, size = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
    prefixes = [prefix_of(s, sketch, t) for s in sets.values()]
    token, own = np.concatenate(prefixes), np.repeat(np.arange(len(sid)), [len(p) for p in prefixes])
    _, which, many = np.unique(token, return_inverse=True, return_counts=True)
    is_hot = many[which] >= hot
    # a frequent token: its sets are answered here, its smallest set stands for them in the shard
    least = np.full(len(many), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, which, sid[own])
    told = np.flatnonzero(is_hot)
    send = np.flatnonzero(~is_hot | (sid[own] == least[which]))
    told_by = dict(split_by(sid[own[told]] % shards)) if len(told) else {}
    sent_by = dict(split_by(_shard(token[send], shards)))
    none = np.zeros(0, np.int64)
    for s in told_by.keys() | sent_by.keys():
        a, b = send[sent_by.get(s, none)], told[told_by.get(s, none)]
        docs, local = np.unique(own[a], return_inverse=True)
        yield s, pack_arrays(token[a], local.astype("<u4"), sid[docs], size[docs], is_hot[a].astype("u1"),
                             token[b], sid[own[b]], size[own[b]], least[which[b]])


def _meet(blobs: list[bytes], t: int) -> tuple[np.ndarray, ...]:
    """(set, size, leader, token) of every set with a token that another set of linkable size has, or
    that a slice has told of; the leader is the smallest set with the token."""
    parts, at = [], 0
    for blob in blobs:
        p = list(unpack_arrays(blob, "<u8", "<u4", "<i8", "<i8", "u1", "<u8", "<i8", "<i8", "<i8"))
        p[1] = p[1].astype(np.int64) + at
        at += len(p[2])
        parts.append(p)
    token, own, sid, size, flag, token_b, sid_b, size_b, lead_b = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(token):
        return sid_b, size_b, lead_b, token_b
    s, n = sid[own], size[own]
    order = np.lexsort((s, n, token))
    token, s, n, flag = token[order], s[order], n[order], flag[order]
    same = np.concatenate([[False], (token[1:] == token[:-1])])
    copy = same & np.concatenate([[False], (s[1:] == s[:-1])])
    many = np.zeros(len(copy), dtype=bool)
    # copies of a set in several slices are one; neighbours by size are the closest in size
    keep = ~copy
    if copy.any():
        group = np.cumsum(keep) - 1
        flag = np.maximum.reduceat(flag, np.flatnonzero(keep))
        token, s, n, same = token[keep], s[keep], n[keep], same[keep]
        same = np.concatenate([[False], token[1:] == token[:-1]])
        many = np.zeros(len(group[keep]), dtype=bool)
    near = same[1:] & (n[:-1] * 100 >= t * n[1:])
    many[1:] |= near
    many[:-1] |= near
    head = np.flatnonzero(~same)
    count = np.diff(np.append(head, len(s)))
    # a flagged entry stands for sets of any size: all sets with its token stay
    many |= np.repeat(np.maximum.reduceat(flag, head), count).astype(bool)
    least = np.repeat(np.minimum.reduceat(s, head), count)
    return (np.concatenate([s[many], sid_b]), np.concatenate([n[many], size_b]), np.concatenate([least[many], lead_b]), np.concatenate([token[many], token_b]))


def _sharing(rows: DataFrame, sketch, n: int, t: int, shards: int, hot: int) -> DataFrame:
    """(sid, n, leader, tokens) of sets that share enough prefix tokens with others; ``tokens``
    are those, 8 bytes each."""

    def entries(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                found = list(_prefixes(part, n, t, sketch.value, shards, hot))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([e for _, e in found], pa.binary())], names=["shard", "entries"])

    def solve(table: pa.Table) -> pa.Table:
        s, *rest = _meet(table.column("entries").to_pylist(), t)
        out = [(k, pack_arrays(s[at], *[x[at] for x in rest])) for k, at in split_by(s % shards)]
        return pa.table([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["bucket", "found"])

    def gather(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b, "<i8", "<i8", "<i8", "<u8") for b in table.column("found").to_pylist()]
        s, size, lead, token = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((lead, token, s))
        s, size, lead, token = s[order], size[order], lead[order], token[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (token[1:] != token[:-1])])
        s, size, lead, token = s[new], size[new], lead[new], token[new]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        ends = np.append(head[1:], len(s))
        keep = np.array([m >= least_shared(n, t) for m, n in zip((ends - head).tolist(), size[head].tolist(), strict=True)], dtype=bool)
        least = np.minimum.reduceat(lead, head)[keep]
        head, ends = head[keep], ends[keep]
        return pa.table([pa.array(s[head], pa.int64()), pa.array(size[head], pa.int64()), pa.array(least, pa.int64()),
                         pa.array([token[a:b].astype("<u8").tobytes() for a, b in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())],
                        names=["sid", "n", "leader", "tokens"])

    found = rows.select("_text").mapInArrow(after_task(entries), "shard int, entries binary").groupBy("shard").applyInArrow(after_group(solve), "bucket int, found binary")
    return found.groupBy("bucket").applyInArrow(after_group(gather), "sid long, n long, leader long, tokens binary")


# -- job 3: groups -------------------------------------------------------------------------

class Group:
    """Member sets of a group: their tokens' union, the members that have each token, and
    each member's root (a member that links inside the group connect it with)."""

    def __init__(self, sids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, root: np.ndarray | None = None):
        self.sids, self.sizes, self.tokens = sids, sizes, tokens
        self.root = np.arange(len(sids)) if root is None else root
        member = np.repeat(np.arange(len(sids)), sizes)
        order = np.argsort(tokens, kind="stable")
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.members = member[order]
        self.many = np.diff(np.append(self.first, len(tokens)))

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Group:
        sets = {s: np.frombuffer(b, "<u8") for s, b in rows}
        sids = np.array(sorted(sets), np.int64)
        parts = [sets[s] for s in sids.tolist()]
        return Group(sids, np.array([len(p) for p in parts], np.int64), np.concatenate(parts))

    def pack(self) -> bytes:
        return pack_arrays(self.sids, self.sizes, self.tokens, self.root.astype("<i8"))

    @staticmethod
    def unpack(blob: bytes) -> Group:
        return Group(*unpack_arrays(blob, "<i8", "<i8", "<u8", "<i8"))

    def linked(self, tokens: np.ndarray, t: int) -> np.ndarray:
        """Members that link with a query set; the group stays closed if the overlap
        with its union is too small for any member."""
        n = len(tokens)
        fits = (self.sizes * 100 >= t * n) & (self.sizes * t <= 100 * n)
        if not fits.any():
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < needed(n, int(self.sizes[fits].min()), t):
            return np.zeros(0, np.int64)
        shared = np.bincount(self.members[ranges(self.first[at], self.many[at])], minlength=len(self.sids))
        return np.flatnonzero(fits & (shared >= needed(n, self.sizes, t)))

    def sets(self) -> Iterator[tuple[int, np.ndarray]]:
        ends = np.cumsum(self.sizes)
        for i, s in enumerate(self.sids.tolist()):
            yield s, self.tokens[ends[i] - self.sizes[i]: ends[i]]

    def inner_links(self, t: int) -> list[tuple[int, int]]:
        """Links that connect linked members, each to its root; sets the roots."""
        forest = Forest()
        for i, (_, tokens) in enumerate(self.sets()):
            for j in self.linked(tokens, t).tolist():
                forest.unite(i, j)
        self.root = np.array([forest.top(i) for i in range(len(self.sids))], np.int64)
        return [(int(self.sids[i]), int(self.sids[r])) for i, r in enumerate(self.root.tolist()) if i != r]


class Forest:
    """Which of the nodes seen so far are connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        up = self.up
        while (above := up.get(i, i)) != i:
            up[i] = up.get(above, above)
            i = up[i]
        return i

    def unite(self, a: int, b: int) -> bool:
        """Connect two nodes under the smaller root; False if they were connected."""
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _placed(sharing: DataFrame, group: int) -> DataFrame:
    """(sid, n, tokens, block): sets by leader, in blocks of about ``group``; the smallest
    set of a leader with several blocks is in each of them."""
    by_leader = sharing.groupBy("leader").agg(F.min("sid").alias("anchor"), F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    own = F.when(F.col("sid") == F.col("anchor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")))
    return sharing.join(by_leader, "leader").withColumn("part", F.explode(own)).select("sid", "n", "tokens", F.xxhash64("leader", "part").alias("block"))


def _groups(rows: DataFrame, found: DataFrame, placed: DataFrame, n: int, t: int) -> DataFrame:
    """(block, members, a, b): packed groups, and links inside them."""
    blocks = placed.groupBy("sid").agg(F.collect_list("block").alias("blocks"))
    wanted = found.where("slot IS NULL").groupBy("sid").agg(F.min("_row").alias("_want")).join(blocks, "sid")
    wanted = saved(wanted, "wanted")
    filter_ = rows.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("_want")))

    def sets(batches):
        for batch in batches:
            some = batch.filter(pa.array(filter_.value.may_have(batch.column("_row").to_numpy(zero_copy_only=False))))
            for part in slices(some, "_text"):
                own = token_sets(part.column("_text"), n)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([set_id(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                                                 names=["_row", "sid", "set"])

    def pack(table: pa.Table) -> pa.Table:
        g = Group.of(list(zip(table.column("sid").to_pylist(), table.column("set").to_pylist(), strict=True)))
        links = g.inner_links(t)
        block = table.column("block")[0].as_py()
        return pa.table([
            pa.array([block] + [None] * len(links), pa.int64()), pa.array([g.pack()] + [None] * len(links), pa.binary()),
            pa.array([None, *[a for a, _ in links]], pa.int64()), pa.array([None, *[b for _, b in links]], pa.int64())],
            names=["block", "members", "a", "b"])

    members = rows.select("_row", "_text").mapInArrow(after_task(sets), "_row long, sid long, set binary").join(
        wanted.select("_want", "blocks"), F.col("_row") == F.col("_want"))
    return members.select(F.explode("blocks").alias("block"), "sid", "set").groupBy("block").applyInArrow(pack, "block long, members binary, a long, b long")


# -- job 4: queries to groups ---------------------------------------------------------------

def _ask(blobs: list[bytes], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, its size, block, tokens): tokens for which the block has a set of a larger component and a linkable size."""
    token, sid, size, comp, weight, block = (np.concatenate(c) for c in zip(*[
        unpack_arrays(b, "<u8", "<i8", "<i8", "<i8", "<i8", "<i8") for b in blobs], strict=True))
    order = np.lexsort((comp, weight))
    place = np.empty(len(comp), np.int64)  # components by size, then by number
    w, c = weight[order], comp[order]
    place[order] = np.cumsum(np.concatenate([[False], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
    sids, own_sid = np.unique(sid, return_inverse=True)
    blocks, own_block = np.unique(block, return_inverse=True)
    keys, counts, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0  # set number * blocks + block number

    def settle():
        nonlocal keys, counts, fresh, waiting
        new, many = np.unique(np.concatenate(fresh), return_counts=True)
        keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([counts, many])).astype(np.int64)
        fresh, waiting = [], 0

    for _, at in split_by(token.view(np.int64)):
        if place[at].min() == place[at].max():
            continue
        one = at[np.unique(sid[at], return_index=True)[1]]
        for b, own in split_by(own_block[at]):
            own = at[own]
            other = one[~np.isin(sid[one], sid[own]) & (place[one] < place[own].max())
                        & (size[one] * 100 >= t * size[own].min()) & (size[one] * t <= 100 * size[own].max())]
            fresh.append(own_sid[other] * len(blocks) + b)
            waiting += len(other)
        if waiting > 1_000_000:
            settle()
    if fresh:
        settle()
    first = np.unique(own_sid, return_index=True)[1]
    return sids[keys // max(len(blocks), 1)], size[first][keys // max(len(blocks), 1)], blocks[keys % max(len(blocks), 1)], counts


def _questions(placed: DataFrame, comps: DataFrame, t: int, shards: int) -> DataFrame:
    """(sid, block): sets and groups that share enough prefix tokens and are not all connected yet."""
    labelled = placed.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    labelled = labelled.join(sizes, "component").select("sid", "n", "component", "weight", "block", "tokens")

    def entries(batches):
        for batch in batches:
            tokens = [np.frombuffer(b, "<u8") for b in batch.column("tokens").to_pylist()]
            if not tokens:
                continue
            token = np.concatenate(tokens)
            cols = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), [len(x) for x in tokens]) for c in ("sid", "n", "component", "weight", "block")]
            found = [(s, pack_arrays(token[at], *[c[at] for c in cols])) for s, at in split_by(_shard(token, shards))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "entries"])

    def ask(table: pa.Table) -> pa.Table:
        sid, *rest = _ask(table.column("entries").to_pylist(), t)
        out = [(k, pack_arrays(sid[at], *[x[at] for x in rest])) for k, at in split_by(sid % shards)]
        return pa.table([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["bucket", "found"])

    def enough(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(b, "<i8", "<i8", "<i8", "<i8") for b in table.column("found").to_pylist()]
        sid, n, block, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((block, sid))
        sid, n, block, count = sid[order], n[order], block[order], count[order]
        head = np.flatnonzero(np.concatenate([[True], (sid[1:] != sid[:-1]) | (block[1:] != block[:-1])]))
        keep = np.add.reduceat(count, head) >= least_shared(n[head], t)
        return pa.table([pa.array(sid[head][keep], pa.int64()), pa.array(block[head][keep], pa.int64())], names=["sid", "block"])

    # few bytes but much work: a task for each shard, not as few as the bytes would fill
    asked = labelled.mapInArrow(after_task(entries), "shard int, entries binary").repartition(shards, "shard").groupBy("shard").applyInArrow(after_group(ask), "bucket int, found binary")
    return asked.groupBy("bucket").applyInArrow(after_group(enough), "sid long, block long")


def _answers(questions: DataFrame, groups: DataFrame, comps: DataFrame, t: int) -> DataFrame:
    """Links (a, b) between query sets and roots of the members they link with, in the groups
    they were sent to; as many as connect them, not one for every pair."""
    questions = saved(questions, "questions")
    share = questions.sparkSession.sparkContext.broadcast
    asking, asked_of = share(bloom_of(questions.select("sid"))), share(bloom_of(questions.select("block")))
    all_blocks = groups.where("block IS NOT NULL").select("block", "members")

    def sets(batches):
        for batch in batches:
            for blob in batch.column("members").to_pylist():
                g = Group.unpack(blob)
                may = asking.value.may_have(g.sids)
                own = [x for x, m in zip(g.sets(), may.tolist(), strict=True) if m]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([x.tobytes() for _, x in own], pa.binary())], names=["sid", "set"])

    def targeted(batches):
        for batch in batches:
            yield batch.filter(pa.array(asked_of.value.may_have(batch.column("block").to_numpy(zero_copy_only=False))))

    blocks = all_blocks.mapInArrow(after_task(targeted), "block long, members binary")
    parts = questions.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    asked = questions.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).select("sid", "block", "part")
    tokens = all_blocks.select("members").mapInArrow(after_task(sets), "sid long, set binary").dropDuplicates(["sid"])
    queries = asked.join(tokens, "sid")
    targets = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "members")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            g, forest = Group.unpack(right.column("members")[0].as_py()), Forest()
            for s, tokens in zip(left.column("sid").to_pylist(), left.column("set").to_pylist(), strict=True):
                for r in g.sids[np.unique(g.root[g.linked(np.frombuffer(tokens, "<u8"), t)])].tolist():
                    if forest.unite(s, r):
                        a.append(s)
                        b.append(r)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return queries.groupBy("block", "part").cogroup(targets.groupBy("block", "part")).applyInArrow(compare, "a long, b long")


# -- the operator -------------------------------------------------------------------------------

def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, t: int = THRESHOLD, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(key, n_shingles, component_id, _n_row, _n_label): one row per row of ``docs``; ``_n_row``
    is the row's identity (``row_id``), ``_n_label`` its component's (null: no words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), row_id(F.col(key), F.col(text)).alias("_row"), F.col(text).alias("_text"))
    shards = shard_count(spark, 1)
    found = saved(_identities(rows, n), "sets")
    sketch = spark.sparkContext.broadcast(_sketch(found))
    sharing = saved(_sharing(rows, sketch, n, t, shards, hot), "sharing")
    placed = saved(_placed(sharing, group), "placed")
    groups = saved(_groups(rows, found, placed, n, t), "groups")
    links = groups.where("a IS NOT NULL").select("a", "b")
    first = components(links)
    more = _answers(_questions(placed, first, t, shards), groups, first, t)
    comps = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    own = found.where("slot IS NULL").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "_n_label", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
    # written first: next to an aggregate the optimiser cannot split a hot label
    least = saved(own.where("n > 0").groupBy("_n_label").agg(F.min("_key").alias("least")).withColumnRenamed("_n_label", "l"), "least")
    out = own.join(least, F.col("_n_label") == F.col("l"), "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_key")).alias("component_id"),
                      F.col("_row").alias("_n_row"), "_n_label")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, and all rows without a word."""
    found = join(docs, key, text, **options).where(F.col("_n_label").isNotNull())
    chosen = found.groupBy("_n_label").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col("_n_row").alias("row"))).alias("first"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    has_word = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(has_word).withColumn("_n_own", row_id(F.col(key), F.col(text))).join(
        chosen.select(F.col("first.row").alias("_n_row")), F.col("_n_own") == F.col("_n_row"), "left_semi").dropDuplicates(["_n_own"])
    return kept.select(*names).unionByName(docs.where(~has_word).select(*names))
