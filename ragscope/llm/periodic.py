"""Periodic runs of words, by Lyndon arrays from Baier's grouping.

A run is a stretch of words with smallest period q and at least ``max(least,
times * q)`` words that cannot be extended on either side.  Every run holds a
Lyndon root: the longest Lyndon word from some position, under the order of the
words or under the reverse order.  So:

1. Phase one of Baier's suffix sorter groups the suffixes of a text by their
   longest Lyndon prefix: groups are taken in descending order, each suffix of a
   group points to the nearest suffix on its left in a lower group, and the
   suffixes with the most pointers move to a new group right above their own.
   The length of a group's prefix is the Lyndon array; no suffix array is made.
   It runs once under each order.
2. Each (position, Lyndon length) is a root; its longest common extensions (LCE)
   to both sides give the stretch with that period.  LCEs compare names of the
   stretches of 2**k words, so they are exact.

Only stretches of words covered by ``WINDOW``-word windows that occur again in
the same document are sorted: all words of a run of three periods and 24 words
are in such windows, so a document without them has no run.

One pass over the documents, no shuffle; memory is bounded by a slice of a few MB of text
or one document.  Words are 64-bit hashes.

Edge cases: null and empty texts have no words and no runs (their ``_r_kept`` is
empty); texts of any length are read whole; overlapping runs are all listed, and a
word that several cover is dropped once; repeated rows get equal results; a null
key is not rewritten; an empty table gives no rows; other columns are carried
along, whatever their names (added columns begin with ``_r_``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ragscope.llm.blobs import ranges
from ragscope.llm.words import Words, covered, find_words, mix, ngram_hashes, repeats, slices

P = "_r_"
LEAST, TIMES = 24, 3
_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
ADDED = [T.StructField(P + "words", T.LongType()), T.StructField(P + "runs", _RUN), T.StructField(P + "kept", T.StringType())]


def rewrite_rule(key: int | None, n: int) -> tuple[int, int] | None:
    """The contract's rewriting of every tenth document: words from a on repeat p words."""
    if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


# -- Lyndon arrays ------------------------------------------------------------------

def lyndon_lengths(symbols: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word from each position, by Baier's grouping."""
    n = len(symbols)
    size, waiting, left = [1] * n, bytearray(b"\1") * n, list(range(-1, n - 1))
    number = {s: g for g, s in enumerate(sorted(set(symbols)))}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))

    def nearest(i: int) -> int:
        """The nearest position on the left whose group is still to come, so is lower."""
        to = left[i]
        while to >= 0 and not waiting[to]:
            to = left[to]
        while i != to and left[i] != to:
            left[i], i = to, left[i]
        return to

    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            waiting[i] = 0
        pointed: dict[int, int] = {}
        for i in own:
            if (j := nearest(i)) >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            new: dict[int, int] = {}
            longer = times * size[own[0]]
            for j in by_count[times]:
                old = group[j]
                if (to := new.get(old)) is None:
                    to = new[old] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = to
                    if up < len(below):
                        below[up] = to
                group[j] = to
                members[to].append(j)
                size[j] += longer
        members[g] = own
        g = below[g]
    return np.array(size, np.int64)


class Extensions:
    """Longest common extensions in a text whose stretches of 2**k words have names."""

    def __init__(self, text: np.ndarray, longest: int):
        self.names = [text.astype(np.int32)]
        while 1 << len(self.names) <= longest:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a[i] and b[i] on agree."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for names, step in self._levels():
            same = (b < len(names))
            same[same] = names[a[same]] == names[b[same]]
            a += same * step
            b += same * step
        return a - start

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a[i] and b[i] agree."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for names, step in self._levels():
            same = a >= step
            same[same] = names[a[same] - step] == names[b[same] - step]
            a -= same * step
            b -= same * step
        return start - a

    def _levels(self):
        """Every step once, the longest first: twice the longest is more than any stretch."""
        for k in range(len(self.names) - 1, -1, -1):
            yield self.names[k], 1 << k


def runs_of(text: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a text of symbols above 0, by start and period; 0 separates
    stretches of at most ``longest`` words, and no run holds it."""
    found = [np.zeros(0, np.int64)] * 3
    if not len(text):
        return tuple(found)
    most, lce = int(text.max()) + 1, Extensions(text, longest)
    for order in (text, np.where(text > 0, most - text, 0)):
        period = lyndon_lengths(order.tolist())
        at = np.flatnonzero((text > 0) & (np.arange(len(text)) + period < len(text)))
        at = at[text[at] == text[at + period[at]]]
        q = period[at]
        first, end = at - lce.left(at, at + q), at + q + lce.right(at, at + q)
        ok = end - first >= np.maximum(least, times * q)
        found = [np.concatenate(x) for x in zip(found, (first[ok], (end - first)[ok], q[ok]), strict=True)]
    if not len(found[0]):
        return tuple(found)
    start, length, period = np.unique(np.stack(found, axis=1), axis=0).T
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])  # a multiple of the period
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


# -- documents ---------------------------------------------------------------------------

def _sources(w: Words, keys: list, rule: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """The word that stands at each position, and which documents are rewritten."""
    source, changed = np.arange(len(w.start)), np.zeros(w.n_docs, dtype=bool)
    if rule is not None:
        for d, key in enumerate(keys):
            if (found := rule(key, int(w.count[d]))) is not None:
                a, p = found
                first, n = int(w.first[d]), int(w.count[d])
                source[first + a: first + n] = first + a + np.arange(n - a) % p
                changed[d] = True
    return source, changed


def slice_runs(w: Words, hashes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, period) of the runs of all documents of a slice."""
    window = min(least - least // times, (times - 1) * (least // times) + 1)  # words that a run repeats one period on
    at = w.room(window)
    many, _ = repeats(ngram_hashes(hashes, at, window) ^ mix(w.doc[at].astype(np.uint64)))
    inside = covered(at[many], window, len(hashes))
    edge = np.zeros(len(hashes) + 1, dtype=bool)
    edge[w.first] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    first, last = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:]))
    size = last - first + 1
    enough = size >= least
    first, size = first[enough], size[enough]
    if not len(first):
        return tuple([np.zeros(0, np.int64)] * 3)
    words = ranges(first, size)
    place = np.arange(len(words)) + np.repeat(np.arange(1, len(size) + 1), size)
    text, origin = np.zeros(len(words) + len(size) + 1, np.int64), np.zeros(len(words) + len(size) + 1, np.int64)
    text[place] = np.unique(hashes[words], return_inverse=True)[1] + 1
    origin[place] = words
    start, length, period = runs_of(text, int(size.max()), least, times)
    return origin[start], length, period


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES,
              rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """``docs`` with ``_r_words`` (number of words), ``_r_runs`` (start, length and period of each run, by
    start and period) and ``_r_kept`` (the words that no run covers after its first period, joined
    by a space).  ``rewrite(key, n)`` may name (a, p): words from a on repeat the p words there."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    names = [*docs.columns, *[f.name for f in ADDED]]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                w = find_words(part.column(text))
                keys = part.column(key).to_pylist() if rewrite else []
                source, changed = _sources(w, keys, rewrite)
                at, length, period = slice_runs(w, w.hashes[source], least, times)
                doc, dropped = w.doc[at] if len(at) else at, np.zeros(len(source), dtype=bool)
                if len(at):
                    dropped = covered(at + period, length - period, len(source))
                lists: list[list] = [[] for _ in range(w.n_docs)]
                for d, s, n, q in zip(doc.tolist(), at.tolist(), length.tolist(), period.tolist(), strict=True):
                    lists[d].append({"start": s - int(w.first[d]), "length": n, "period": q})
                data, kept = w.data.tobytes(), []
                for d in range(w.n_docs):
                    if not changed[d] and not lists[d]:
                        kept.append(b" ".join(data[int(w.offsets[d]): int(w.offsets[d + 1])].split()).decode())
                        continue
                    own = source[w.first[d]: w.first[d + 1]][~dropped[w.first[d]: w.first[d + 1]]]
                    kept.append(b" ".join(data[a:b] for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)).decode())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(w.count, pa.int64()), pa.array(lists, _RUN_ARROW), pa.array(kept, pa.string())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED]))
