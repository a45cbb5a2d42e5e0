"""Packing token sequences by the sum-of-squares rule, online.

Each document (its token ids and one end id) is cut into full windows and a
rest; the rest goes into the open window fill level that keeps the sum over
levels of (number of open windows at the level) squared smallest, an empty
window included.  The packer keeps only a level array of counts and, per
level, the open windows, so one document costs one pass over the array.

Every partition packs its own documents in the order they arrive: nothing is
shuffled, the number of packers grows with the input, and a sequence never
spans partitions.  When a partition ends, or holds more than ``most_open`` open
windows, what is in open windows is laid end to end and cut anew at window
boundaries, so at most one window of a partition stays partly filled; that
one is cut at powers of two, which need no padding.

A sequence id is partition number * 2**40 + number within the partition.  A
partition that is computed again from the same rows gives the same sequences;
read the input from files (not from a shuffle of unstable order) to have that.

Edge cases: a null or empty text has only the end id; a document longer than a
window is cut; repeated rows are packed once each; a null key is carried on;
an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.blobs import ranges
from ragscope.llm.memory import after_task
from ragscope.llm.words import NON_SPACE, Words, find_words, hash_spans, slices

WINDOW = 2048
END_ID = 1
MOST_OPEN = 8192  # open windows a packer may hold, 16M ids at the most

PIECE_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# -- tokens -----------------------------------------------------------------------

class WordTokenizer:
    """Token ids of texts, one word at a time.

    For a lower-casing tokenizer that drops white space and never joins across
    it, the ids of a text are those of its words one after the other (closing
    punctuation after an ASCII letter or digit counts as a word of its own), so
    a word has to be tokenised once.  Up to ``most`` words are kept, by 64-bit
    hash, as sorted arrays.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)  # of the word in ``flat``
        self.count = np.zeros(1, np.int64)
        self.flat = np.zeros(0, "<u4")

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        w = find_words(texts, NON_SPACE, lower=True)
        start, end = self._units(w)
        distinct, first, which = np.unique(hash_spans(w.data, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.hash):
            known = self.hash[np.minimum(place, len(self.hash) - 1)] == distinct
        if not known.all():
            if len(self.hash) > self.most:
                self._forget()
                known[:] = False
            new = first[~known]
            self._learn(distinct[~known], [w.data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            place = np.searchsorted(self.hash, distinct)
        at, count = self.at[place][which], self.count[place][which]
        flat = self.flat[ranges(at, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        cut = total[np.searchsorted(start, w.offsets)].tolist()
        out = [flat[cut[i]: cut[i + 1]] for i in range(w.n_docs)]
        if b"<|" in w.data.tobytes():  # may begin a special token, which is matched before lower-casing
            for i, text in enumerate(texts.to_pylist()):
                if text and "<|" in text:
                    out[i] = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return out

    @staticmethod
    def _units(w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with closing punctuation cut off, and that punctuation, in order."""
        if not len(w.start):
            return w.start, w.end
        core = w.end.copy()
        live = np.arange(len(core))
        while len(live):
            live = live[(core[live] > w.start[live]) & _CLOSING[w.data[core[live] - 1]]]
            core[live] -= 1
        cut = (core < w.end) & (core > w.start)
        cut &= _ASCII_ALNUM[w.data[np.maximum(core, 1) - 1]]
        start = np.concatenate([w.start, core[cut]])
        end = np.concatenate([np.where(cut, core, w.end), w.end[cut]])
        order = np.argsort(start, kind="stable")
        return start[order], end[order]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Tokenise words joined by spaces; a token's offset tells its word."""
        flats, counts = [], []
        for at in range(0, len(words), 1000):
            part = [w.decode() for w in words[at: at + 1000]]
            e = self.model.encode(" ".join(part), add_special_tokens=False)
            offsets = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids))
            cut = np.searchsorted(offsets, np.cumsum([0, *[len(w) + 1 for w in part]]))
            flats.append(np.array(e.ids, dtype="<u4"))
            counts.append(np.diff(cut))
        count = np.concatenate(counts)
        all_hashes = np.concatenate([self.hash, hashes])
        all_counts = np.concatenate([self.count[: len(self.hash)], count])
        all_at = np.concatenate([self.at[: len(self.hash)], len(self.flat) + np.cumsum(count) - count])
        order = np.argsort(all_hashes, kind="stable")
        self.hash, self.count, self.at = all_hashes[order], all_counts[order], all_at[order]
        self.flat = np.concatenate([self.flat, *flats])


_CLOSING, _ASCII_ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CLOSING[list(b".,;:!?")] = True
_ASCII_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so the words it has kept serve all tasks of the worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# -- packing ----------------------------------------------------------------------

@dataclass
class Piece:
    row: int  # number of the document in the packer
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.row, self.start, self.ids[:n], self.doc_tokens),
                Piece(self.row, self.start + n, self.ids[n:], self.doc_tokens))


class Packer:
    """Sum-of-squares packing of one stream of documents."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows by fill
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Fill level (0: a new window) for ``size`` ids: the least growth of the
        sum of squared counts, at a tie the fullest window."""
        w = self.window
        after = self.levels[size: w + 1].copy()  # windows that would share the new level
        after[-1] = 0  # a full window is closed, not counted
        before = self.levels[: w + 1 - size]
        # moving one window from h to h + size adds 2 * (N(h + size) - N(h)) + 2, with -1 if either end is not counted
        growth = 2 * (after - before) + 2
        growth[0] -= 1
        growth[-1] -= 1
        usable = before > 0
        usable[0] = True
        growth[~usable] = np.iinfo(np.int64).max
        return int(len(growth) - 1 - np.argmin(growth[::-1]))

    def add(self, row: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; gives the windows that are complete."""
        w, total = self.window, len(ids)
        whole = total // w * w
        for at in range(0, whole, w):
            yield [Piece(row, at, ids[at: at + w], total)]
        if whole < total:
            yield from self._place(Piece(row, whole, ids[whole:].copy(), total))
        if self.n_open > self.most_open:
            yield from self.flush(last=False)

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        level = self.level_for(len(piece.ids))
        window = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
            self.n_open -= 1
        window.append(piece)
        fill = level + len(piece.ids)
        if fill == self.window:
            yield window
        else:
            self.levels[fill] += 1
            self.n_open += 1
            self.open.setdefault(fill, []).append(window)

    def flush(self, last: bool = True) -> Iterator[list[Piece]]:
        """Lay the open windows end to end and cut them anew."""
        rest = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        window, fill = [], 0
        for piece in rest:
            while len(piece.ids):
                head, piece = piece.cut(self.window - fill)
                window.append(head)
                fill += len(head.ids)
                if fill == self.window:
                    yield window
                    window, fill = [], 0
        if not window:
            return
        if not last:
            self.levels[fill] += 1
            self.n_open = 1
            self.open[fill] = [window]
            return
        while window:  # powers of two, the largest first
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            part = []
            while size:
                head, tail = window[0].cut(size)
                part.append(head)
                size -= len(head.ids)
                window[:1] = [tail] if len(tail.ids) else []
            yield part


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, most_open: int = MOST_OPEN, with_ids: bool = False,
         make: Callable[[str], WordTokenizer] = word_tokenizer) -> DataFrame:
    """One row per piece of a document: (key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset), and the token ids with ``with_ids``.  ``tokenizer`` is the
    path of the tokenizer's file on every executor."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType
    schema = T.StructType([T.StructField("_key", kind), *[T.StructField(c, T.LongType()) for c in PIECE_COLUMNS]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = [f.name for f in schema.fields]

    def run(batches):
        tok, packer = make(tokenizer), Packer(window, most_open)
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 40
        keys: dict[int, object] = {}
        n, key_type = 0, None
        buffer: list[tuple] = []

        def take(windows):
            nonlocal at
            for pieces in windows:
                offset = 0
                for p in pieces:
                    row = (keys[p.row], p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, at, offset)
                    buffer.append((*row, p.ids.tolist()) if with_ids else row)
                    offset += len(p.ids)
                at += 1

        def out():
            cols = list(zip(*buffer, strict=True))
            arrays = [pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            arrays += [pa.array(cols[7], pa.list_(pa.int64()))] if with_ids else []
            buffer.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        end = np.array([end_id], "<u4")
        for part in (p for batch in batches for p in slices(batch, "_text")):
            key_type = part.schema.field("_key").type
            for k, ids in zip(part.column("_key").to_pylist(), tok.ids(part.column("_text")), strict=True):
                keys[n] = k
                take(packer.add(n, np.concatenate([ids, end])))
                n += 1
                if len(buffer) >= (256 if with_ids else 8192):
                    yield out()
            if len(keys) > 4 * most_open:  # forget documents that have left the packer
                held = {p.row for level in packer.open.values() for w in level for p in w}
                keys = {r: k for r, k in keys.items() if r in held}
        take(packer.flush())
        if buffer:
            yield out()

    return rows.mapInArrow(after_task(run), schema).withColumnRenamed("_key", key)
