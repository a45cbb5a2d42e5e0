"""LM scoring with a hidden Markov model.

Training documents fit a model with ``states`` latent states by Baum-Welch:
every task runs scaled forward-backward over its blocks of documents and adds
up expected counts; the counts of all tasks are summed by Spark and give the
next parameters.  Any document then gets the exact log10 likelihood of its
token sequence from the scaled forward recursion.

Symbols: a word that makes up at least ``SHARE`` of the training tokens (so at
most 1 / SHARE of them) is a symbol of its own.  Other words, seen or not, emit
the symbol of their ending (one of ``ENDINGS``) and, given that, their own
smoothed relative frequency within the ending.  So parameters have a size that
does not depend on the input and are broadcast; counts of all words are not,
they meet the documents by a shuffle on blocks.

Jobs: (1) documents become blocks of word numbers (a written table); (2) shards
of the word hash space add up the blocks' training counts and answer every block
with its words' totals; (3) the first states come from clusters of the most
frequent words by their co-occurrence in documents; (4) ``ROUNDS`` passes of
Baum-Welch; (5) blocks meet their answers and documents are scored.

Edge cases: null and empty texts are one end token; without training documents
every word is unknown and states are uniform; a null id is held out (its text is
''); rows equal in id and text are scored alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.blobs import pack_arrays, split_by, unpack_arrays
from ragscope.llm.jobs import saved, shard_count
from ragscope.llm.words import Words, find_words, mix, slices

STATES, ROUNDS = 6, 3
SHARE, ENDINGS = 2e-6, 1024
SMOOTH = 0.1
#: Text of a block; most frequent words used for the first states; counters sent as one row.
BLOCK_BYTES, SEEDS, SLOT = 6 << 20, 256, 8192
END = np.uint64(1)  # the end token's hash


def held_out(key: Column) -> Column:
    """True for documents that are kept from training."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 10 == 0


# -- blocks -----------------------------------------------------------------------------

def _endings(w: Words) -> np.ndarray:
    """Ending class (from 1) of each word: its last two bytes before closing punctuation, and that."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    last = w.end - 1
    tail = w.data[last].astype(np.int64)
    closed = np.isin(tail, np.frombuffer(b".,;:!?", "u1")) & (last > w.start)
    last = last - closed
    a, b = w.data[last].astype(np.int64), np.where(last > w.start, w.data[last - 1].astype(np.int64), 0)
    return 1 + (mix(((a << 16) | (b << 8) | np.where(closed, tail, 0)).astype(np.uint64)) % np.uint64(ENDINGS - 1)).astype(np.int64)


@dataclass
class Block:
    """Documents as word numbers; words are numbered by falling frequency in the block."""

    size: np.ndarray  # tokens of each document, the end token included
    token: np.ndarray
    hash: np.ndarray  # of each word
    ending: np.ndarray  # of each word, 0 for the end token
    held: np.ndarray  # documents that are not for training

    @staticmethod
    def of(texts: pa.Array, held: np.ndarray) -> Block:
        w = find_words(texts, lower=True)
        size = w.count + 1
        h, e = np.empty(int(size.sum()), np.uint64), np.zeros(int(size.sum()), np.int64)
        own = np.arange(len(w.start)) + w.doc
        h[own], e[own] = w.hashes, _endings(w)
        h[np.cumsum(size) - 1] = END
        words, first, token, many = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        return Block(size, number[token], words[order], e[first[order]], held)

    def pack(self) -> bytes:
        planes = np.ascontiguousarray(self.token.astype("<u4").view("u1").reshape(-1, 4).T).ravel()
        return pack_arrays(self.size.astype("<i8"), planes, self.hash, self.ending.astype("<u2"), self.held.astype("u1"))

    @staticmethod
    def unpack(blob: bytes) -> Block:
        size, planes, words, ending, held = unpack_arrays(blob, "<i8", "u1", "<u8", "<u2", "u1")
        token = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        return Block(size, token, words, ending.astype(np.int64), held.astype(bool))

    def training_counts(self) -> np.ndarray:
        train = ~np.repeat(self.held, self.size)
        return np.bincount(self.token[train], minlength=len(self.hash))

    def shards(self, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """Word numbers by shard of the hash space, always in the same order."""
        yield from split_by((mix(self.hash) % np.uint64(count)).astype(np.int64))


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), held_out(F.col(key)).alias("_held"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["_key"].dataType)),
                           T.StructField("train_tokens", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(batch, "_text", BLOCK_BYTES):
                b = Block.of(part.column("_text"), part.column("_held").to_numpy(zero_copy_only=False).astype(bool))
                kind = part.schema.field("_key").type
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([part.column("_key").to_pylist()], pa.list_(kind)),
                    pa.array([int(b.size[~b.held].sum())], pa.int64()), pa.array([b.pack()], pa.binary())], names=["block", "keys", "train_tokens", "data"])
                number += 1

    return rows.mapInArrow(run, schema)


# -- counts -------------------------------------------------------------------------------

def _counts(blocks: DataFrame, shards: int, least: int) -> DataFrame:
    """(block, shard, answer): totals of a block's words in a shard; and one row a shard with
    block -1: its number of words, its frequent words and what the others add to their endings."""

    def ask(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                b = Block.unpack(data)
                count, rows = b.training_counts(), []
                for s, at in b.shards(shards):
                    rows.append((number, s, pack_arrays(b.hash[at], b.ending[at].astype("<u2"), count[at].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                                 names=["block", "shard", "asked"])

    def solve(table: pa.Table) -> pa.Table:
        blocks_, parts = table.column("block").to_pylist(), [unpack_arrays(x, "<u8", "<u2", "<u4") for x in table.column("asked").to_pylist()]
        h, e, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, first, which = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=c.astype(np.float64), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        answers = [pack_arrays(x.astype("<i8")) for x in np.split(total[which], ends[:-1])]
        seen = total > 0
        often = (total >= least) | (words == END)
        rare = seen & ~often
        ending = e[first].astype(np.int64)
        by_ending = [np.bincount(ending[rare], weights=x[rare], minlength=ENDINGS) for x in (total.astype(np.float64), np.ones(len(total)))]
        result = pack_arrays(np.array([seen.sum()], "<i8"), words[often & seen], total[often & seen], *[x.astype("<i8") for x in by_ending])
        shard = table.column("shard")[0].as_py()
        return pa.table([pa.array([*blocks_, -1], pa.int64()), pa.array([shard] * (len(blocks_) + 1), pa.int32()), pa.array([*answers, result], pa.binary())],
                        names=["block", "shard", "answer"])

    asked = blocks.select("block", "data").mapInArrow(ask, "block long, shard int, asked binary")
    return asked.groupBy("shard").applyInArrow(solve, "block long, shard int, answer binary")


# -- model ----------------------------------------------------------------------------------

@dataclass
class Model:
    """Symbols are numbered: endings 0..ENDINGS - 1 (0 is not used), then the frequent words by hash."""

    words: np.ndarray  # hashes of frequent words, sorted
    count: np.ndarray  # their training counts
    ending_tokens: np.ndarray
    ending_words: np.ndarray
    start: np.ndarray
    move: np.ndarray  # move[i, j]: from state i to state j
    emit: np.ndarray  # emit[symbol, state]

    @property
    def symbols(self) -> int:
        return ENDINGS + len(self.words)

    def symbol(self, b: Block) -> np.ndarray:
        """Symbol of each word of a block."""
        if not len(self.words):
            return b.ending
        at = np.minimum(np.searchsorted(self.words, b.hash), len(self.words) - 1)
        return np.where(self.words[at] == b.hash, ENDINGS + at, b.ending)

    def log_share(self, b: Block, count: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its ending; 0 for frequent words."""
        e = b.ending
        share = np.log10((count + SMOOTH) / (self.ending_tokens[e] + SMOOTH * (self.ending_words[e] + 1)))
        return np.where(self.symbol(b) >= ENDINGS, 0.0, share)

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """The model that expected counts give."""
        norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
        return Model(self.words, self.count, self.ending_tokens, self.ending_words,
                     norm(start + SMOOTH, 0), norm(move + SMOOTH, 1), norm(emit + SMOOTH, 0))


@dataclass
class Steps:
    """Tokens of documents, first tokens first: step t holds token t of every document that has one."""

    where: np.ndarray  # token positions in step order
    at: list[int]  # step t is at[t]:at[t + 1]
    order: np.ndarray  # documents by falling length

    @staticmethod
    def of(size: np.ndarray) -> Steps:
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        active = len(size) - np.cumsum(np.bincount(size, minlength=size.max() + 1))[:-1] if len(size) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(active)])
        where = np.empty(len(rank), np.int64)
        where[at[rank] + np.repeat(place, size)] = np.arange(len(rank))
        return Steps(where, at.tolist(), order)


def forward(model: Model, symbol: np.ndarray, steps: Steps, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scale factors of every token in step order, and the scaled forward variables."""
    emit, move, at = model.emit, model.move, steps.at
    scale = np.empty(len(symbol))
    alpha = np.empty((len(symbol), emit.shape[1]), np.float32) if keep else None  # for counts; half the memory
    now = None
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        now = (model.start if now is None else now[: b - a] @ move) * emit[symbol[a:b]]
        c = now.sum(axis=1)
        now /= c[:, None]
        scale[a:b] = c
        if keep:
            alpha[a:b] = now
    return scale, alpha


def expected_counts(model: Model, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log10 likelihood, of documents of the given sizes."""
    k, n = len(model.start), model.symbols
    if not len(size):
        return np.zeros(k), np.zeros((k, k)), np.zeros((n, k)), 0.0
    steps = Steps.of(size)
    s, at = symbol[steps.where], steps.at
    scale, alpha = forward(model, s, steps, True)
    pairs, back = np.zeros((k, k)), model.move.T.copy()
    later = None  # emission times backward variable over scale, of the next step
    for t in range(len(at) - 2, -1, -1):
        a, b = at[t], at[t + 1]
        beta = np.ones((b - a, k))
        if later is not None:
            pairs += alpha[a: a + len(later)].T @ later
            beta[: len(later)] = later @ back
        later = model.emit[s[a:b]] * beta / scale[a:b, None]
        alpha[a:b] *= beta  # now the state probabilities
    emit = np.stack([np.bincount(s, weights=alpha[:, j], minlength=n) for j in range(k)], axis=1)
    return alpha[: at[1]].sum(axis=0), pairs * model.move, emit, float(np.log10(scale).sum())


def _summed(frame: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' counters, sent as (slot, part) rows; of a size that the model fixes."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack_arrays(x, "<f8")[0] for x in table.column("part").to_pylist())
        return pa.table([table.column("slot")[:1], pa.array([pack_arrays(total)], pa.binary())], names=["slot", "part"])

    out = np.zeros(size)
    for row in frame.groupBy("slot").applyInArrow(add, "slot int, part binary").collect():
        part = unpack_arrays(row.part, "<f8")[0]
        out[row.slot * SLOT: row.slot * SLOT + len(part)] = part
    return out


def _slots(counters: np.ndarray) -> pa.RecordBatch:
    parts = [(i, counters[a: a + SLOT]) for i, a in enumerate(range(0, len(counters), SLOT))]
    parts = [(i, pack_arrays(p)) for i, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["slot", "part"])


def _first_model(blocks: DataFrame, words, count, ending_tokens, ending_words, states: int) -> Model:
    """States from clusters of the most frequent words: words that keep to the same documents."""
    top = np.sort(words[np.argsort(-count, kind="stable")[:SEEDS]])
    k = len(top)

    def together(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                b = Block.unpack(data)
                at = np.searchsorted(top, b.hash)
                seed = np.where(top[np.minimum(at, k - 1)] == b.hash, at, -1)[b.token]
                doc = np.repeat(np.arange(len(b.size)), b.size)
                use = (seed >= 0) & ~b.held[doc]
                has = np.zeros((len(b.size), k), np.float32)
                has[doc[use], seed[use]] = 1
                total += has.T @ has
        yield _slots(total.ravel())

    joint = _summed(blocks.select("data").mapInArrow(together, "slot int, part binary"), k * k).reshape(k, k) if k else np.zeros((0, 0))
    number = np.searchsorted(words, top)
    emit = np.zeros((ENDINGS + len(words), states)) + np.concatenate([ending_tokens, count]).astype(float)[:, None] / max(states, 1)
    if k >= states:
        own = np.maximum(np.diag(joint), 1)
        like = joint / np.sqrt(own[:, None] * own[None, :])
        like /= np.linalg.norm(like, axis=1, keepdims=True)
        centre = [int(np.argmax(own))]  # the farthest words first
        while len(centre) < states:
            centre.append(int(np.argmin((like @ like[centre].T).max(axis=1))))
        mean = like[centre]
        for _ in range(20):
            side = np.argmax(like @ mean.T, axis=1)
            mean = np.stack([like[side == j].mean(axis=0) if (side == j).any() else mean[j] for j in range(states)])
            mean /= np.linalg.norm(mean, axis=1, keepdims=True)
        favour = np.where(np.arange(states)[None, :] == side[:, None], 20.0, 1.0)
        emit[ENDINGS + number] *= states * favour / favour.sum(axis=1, keepdims=True)
    blank = Model(words, count, ending_tokens, ending_words, np.zeros(0), np.zeros((0, 0)), emit)
    return blank.updated(np.ones(states), np.eye(states) * 19 * states + 1, emit)


def train(blocks: DataFrame, counts: DataFrame, states: int, rounds: int) -> tuple[Model, int, list[float]]:
    """The model, the number of distinct training tokens, and the training log10 likelihood of each round."""
    distinct, words, count = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ending_tokens, ending_words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for row in counts.where("block = -1").toLocalIterator():
        n, w, c, et, ew = unpack_arrays(row.answer, "<i8", "<u8", "<i8", "<i8", "<i8")
        distinct += int(n[0])
        words.append(w)
        count.append(c)
        ending_tokens, ending_words = ending_tokens + et, ending_words + ew
    words, count = np.concatenate(words), np.concatenate(count)
    order = np.argsort(words)
    model, seen = _first_model(blocks, words[order], count[order], ending_tokens, ending_words, states), []
    n, k = model.symbols, states
    for _ in range(rounds if len(words) else 0):
        shared = blocks.sparkSession.sparkContext.broadcast(model)

        def step(batches, shared=shared):
            total, like = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))], 0.0
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    b = Block.unpack(data)
                    use = ~np.repeat(b.held, b.size)
                    *got, one = expected_counts(shared.value, b.size[~b.held], shared.value.symbol(b)[b.token[use]])
                    like += one
                    for x, y in zip(total, got, strict=True):
                        x += y
            yield _slots(np.concatenate([[like], *[x.ravel() for x in total]]))

        flat = _summed(blocks.select("data").mapInArrow(step, "slot int, part binary"), 1 + k + k * k + n * k)
        seen.append(float(flat[0]))
        model = model.updated(flat[1: 1 + k], flat[1 + k: 1 + k + k * k].reshape(k, k), flat[1 + k + k * k:].reshape(n, k))
        shared.unpersist()
    return model, distinct, seen


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row:
    ``base_score`` is a smoothed unigram's log10 probability, ``score`` the model's."""
    spark = docs.sparkSession
    blocks = saved(_blocks(docs, key, text), "blocks")
    tokens = int(blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n")).first()["n"])
    shards = shard_count(spark, 1)
    counts = saved(_counts(blocks, shards, max(2, int(np.ceil(tokens * SHARE)))), "counts")
    model, distinct, _ = train(blocks, counts, states, rounds)
    shared = spark.sparkContext.broadcast(model)
    floor = tokens + SMOOTH * (distinct + 1)
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("_key", kind), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        b, m = Block.unpack(left.column("data")[0].as_py()), shared.value
        count = np.zeros(len(b.hash), np.int64)
        answers = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True))
        for s, at in b.shards(shards):
            count[at] = unpack_arrays(answers[s], "<i8")[0]
        first = np.cumsum(b.size) - b.size
        add = lambda per_word: np.add.reduceat(per_word[b.token], first)
        steps = Steps.of(b.size)
        scale, _ = forward(m, m.symbol(b)[b.token[steps.where]], steps, False)
        logs = np.empty(len(scale))
        logs[steps.where] = np.log10(scale)
        keys = left.column("keys").combine_chunks().flatten()
        return pa.table([
            keys, pa.array(b.held), pa.array(b.size, pa.int64()), pa.array(add((count > 0).astype(np.int64)), pa.int64()),
            pa.array(np.full(len(b.size), tokens), pa.int64()), pa.array(add(np.log10((count + SMOOTH) / floor))),
            pa.array(np.add.reduceat(logs, first) + add(m.log_share(b, count)))], names=[f.name for f in schema.fields])

    answers = counts.where("block >= 0")
    out = blocks.select("block", "keys", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(read, schema)
    return out.withColumnRenamed("_key", key)
