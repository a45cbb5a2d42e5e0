"""Quality rules: learned decision lists.

``learn`` fits an ordered list of threshold conjunctions on labelled documents
by sequential covering: each rule is grown condition by condition on one part
of the labelled rows (FOIL gain), pruned on the other part, and kept while it
is precise enough there.  ``DecisionList.column`` is the list as one Spark
conditional expression; a document that matches a rule is rejected.

Statistics come from whole texts (``with_stats``).  One of them counts words of
a short list learned from the same labelled rows: words frequent in rejected
documents and next to absent in others.

Edge cases: a null or empty text has no words and every statistic 0; with no
labelled rows (or one class only) the list is empty and rejects nothing; null
labels are left out; repeated labels of a document count once each; rows
repeated in ``docs`` are judged alike; columns of ``docs`` other than the id
and text are passed through untouched whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.llm.memory import after_task
from ragscope.llm.words import LINE, LOWER, NON_SPACE, Words, covered, find_words, hash_spans, mix, ngram_hashes, per_doc, repeats, slices

#: Labelled rows the list is learned from (a documented bound; all documents are scored).
SAMPLE_ROWS = 20_000
#: Words the learned word list may hold, and how a word gets there: the least
#: number and share of the rejected documents it is in, and its precision.
LIST_WORDS, LIST_SUPPORT, LIST_SHARE, LIST_PRECISION = 256, 5, 0.02, 0.95

SYMBOLS = b"#*$%&|<>"
#: What listed words are stripped of at both ends, when they are learned and when they are counted.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_listed"]
P = "_q_"  # prefix of columns added to a caller's frame

#: Features a rule may test, from the counts (SQL over prefixed columns; each counts 0 where its divisor is 0).
FEATURES = {
    "words": f"CAST({P}n_words AS DOUBLE)",
    "word_length": f"{P}word_chars / greatest({P}n_words, 1)",
    "symbols_per_word": f"{P}n_symbols / greatest({P}n_words, 1)",
    "dup_line_share": f"{P}n_dup_lines / greatest({P}n_lines, 1)",
    "repeat_share": f"{P}n_repeat_words / greatest({P}n_words, 1)",
    "listed": f"CAST({P}n_listed AS DOUBLE)",
    "listed_share": f"{P}n_listed / greatest({P}n_words, 1)",
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(PUNCTUATION)] = True


def _in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(doc.astype(np.uint64)))


def _bare(w: Words) -> np.ndarray:
    """Hashes of the words in lower case without ASCII punctuation at either end."""
    data = LOWER[w.data]
    punct = _PUNCT[data]
    solid = np.append(np.flatnonzero(~punct), len(data))
    start, end = w.start.copy(), w.end.copy()
    lead = np.flatnonzero(punct[start])
    start[lead] = np.minimum(solid[np.searchsorted(solid, start[lead])], end[lead])
    trail = np.flatnonzero((start < end) & punct[end - 1])
    end[trail] = solid[np.searchsorted(solid, end[trail]) - 1] + 1
    return hash_spans(data, start, end)


def stats_of(texts: pa.Array, listed: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; ``listed`` are sorted hashes of the learned word list."""
    w = find_words(texts)
    inside = NON_SPACE[w.data]
    in_bytes = lambda flags: per_doc(flags, w.offsets)
    out = {
        "n_words": w.count,
        "word_chars": in_bytes(inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": in_bytes(_SYMBOL[w.data]),
    }
    lines = find_words(texts, LINE)
    with_word = np.searchsorted(w.start, lines.start) < np.searchsorted(w.start, lines.end)
    _, later = repeats(_in_doc(lines.hashes, lines.doc))
    # a line without a word never equals one with a word
    out["n_dup_lines"] = per_doc(later & with_word, lines.first)
    out["n_lines"] = per_doc(with_word, lines.first)
    at = w.room(8)
    many, _ = repeats(_in_doc(ngram_hashes(w.hashes, at, 8), w.doc[at]))
    out["n_repeat_words"] = per_doc(covered(at[many], 8, len(w.start)), w.first)
    out["n_listed"] = per_doc(np.isin(_bare(w), listed), w.first) if len(listed) else np.zeros(w.n_docs, np.int64)
    return out


def with_stats(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the counts appended under prefixed names."""
    listed = _list_hashes(words)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(P + c, T.LongType()) for c in COUNTS]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                counts = stats_of(part.column(text), listed)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(counts[c], pa.int64()) for c in COUNTS]],
                    names=[*part.schema.names, *[P + c for c in COUNTS]])

    return docs.mapInArrow(after_task(run), schema)


def _list_hashes(words: list[str]) -> np.ndarray:
    texts = find_words(pa.array([" ".join(words)]))
    return np.sort(texts.hashes)


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (feature, "<=" or ">", threshold)."""

    rules: list[list[tuple[str, str, float]]]
    words: list[str]

    def conditions(self) -> list[str]:
        return [" AND ".join(f"({FEATURES[f]}) {op} {v!r}D" for f, op, v in rule) for rule in self.rules]

    def sql(self) -> str:
        """The list as one ordered SQL conditional: true for a rejected row."""
        if not self.rules:
            return "false"
        return "CASE " + " ".join(f"WHEN {c} THEN true" for c in self.conditions()) + " ELSE false END"

    def column(self) -> Column:
        return F.expr(self.sql())

    def rule_number(self) -> Column:
        """Number of the first matching rule, from 1; 0 for none."""
        if not self.rules:
            return F.lit(0)
        return F.expr("CASE " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(self.conditions(), 1)) + " ELSE 0 END")


def base_failed(prefix: str = P) -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


# -- learning -----------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled documents as (_id, text, _bad), chosen by a hash of
    the id.  The label side is bounded by ``rows``, so it is broadcast."""
    picked = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .select(F.col(key).alias("_id"), ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("_bad"))
        .orderBy(F.xxhash64("_id"), "_id", "_bad").limit(rows)
    )
    return docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")


def _word_list(sample: DataFrame) -> list[str]:
    """Words in enough rejected documents and, where they occur, nearly always in
    rejected ones; the most frequent LIST_WORDS of them."""
    least = max(LIST_SUPPORT, LIST_SHARE * sample.where("_bad").count())

    def run(batches):
        for batch in batches:
            good, bad = Counter(), Counter()
            for part in slices(batch, "text"):
                w, flags = find_words(part.column("text"), lower=True), part.column("_bad").to_pylist()
                for i, is_bad in enumerate(flags):
                    seen = {w.word(j).strip(PUNCTUATION) for j in range(w.first[i], w.first[i + 1])}
                    (bad if is_bad else good).update(seen - {b""})
            rows = list(good.keys() | bad.keys())
            yield pa.RecordBatch.from_arrays([
                pa.array([r.decode("utf-8", "replace") for r in rows], pa.string()),
                pa.array([bad[r] for r in rows], pa.int64()), pa.array([good[r] for r in rows], pa.int64())],
                names=["word", "bad", "good"])

    counts = sample.mapInArrow(after_task(run), "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chosen = counts.where((F.col("bad") >= least) & (F.col("bad") >= LIST_PRECISION * (F.col("bad") + F.col("good"))))
    return sorted(r.word for r in chosen.orderBy(F.desc("bad"), "word").limit(LIST_WORDS).collect())


def _matches(rule, x: dict[str, np.ndarray]) -> np.ndarray:
    ok = np.ones(len(next(iter(x.values()))), dtype=bool)
    for f, op, v in rule:
        ok &= (x[f] <= v) if op == "<=" else (x[f] > v)
    return ok


def _thresholds(values: np.ndarray) -> np.ndarray:
    u = np.unique(values)
    if len(u) > 64:
        u = np.unique(np.quantile(u, np.linspace(0, 1, 64)))
    return (u[1:] + u[:-1]) / 2


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int = 4) -> list[tuple[str, str, float]]:
    rule: list[tuple[str, str, float]] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < most and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        if not p0:
            return []
        best, gain = None, 1e-9
        for f, values in x.items():
            v, t = values[inside], y[inside]
            order = np.argsort(v, kind="stable")
            pos = np.concatenate([[0], np.cumsum(t[order])])
            for cut in _thresholds(v):
                k = int(np.searchsorted(v[order], cut, side="right"))
                for op, p, n in (("<=", pos[k], k - pos[k]), (">", p0 - pos[k], n0 - (k - pos[k]))):
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = (f, op, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= _matches([best], x)
    return rule


def cover(x: dict[str, np.ndarray], y: np.ndarray, part: np.ndarray, precision: float = 0.9, most: int = 16) -> list[list[tuple[str, str, float]]]:
    """Sequential covering: rules for ``y``, grown where ``part`` is false and pruned where it is true."""
    rules, left = [], np.ones(len(y), dtype=bool)
    pick = lambda mask: ({f: v[mask] for f, v in x.items()}, y[mask])
    while len(rules) < most:
        (gx, gy), (px, py) = pick(left & ~part), pick(left & part)
        if gy.sum() < 3:
            break
        rule = _grow(gx, gy)
        if not rule:
            break
        score = []
        for k in range(1, len(rule) + 1):
            m = _matches(rule[:k], px)
            p, n = int(py[m].sum()), int((~py[m]).sum())
            score.append(((p - n) / (p + n) if p + n else -1.0, k, p, n))
        _, k, p, n = max(score, key=lambda s: (s[0], -s[1]))
        if p < 2 or p < precision * (p + n):
            break
        rules.append(rule[:k])
        left &= ~_matches(rule[:k], x)
    return rules


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS,
          precision: float = 0.9) -> DecisionList:
    """Learn which documents to reject: those labelled of low quality or toxic.
    Documents that ``base_failed`` rejects anyway are left to it.  A third of the sample prunes
    the rules; the listed words are learned, like the rules, on the rest."""
    prune = F.xxhash64("_id") % 3 == 0
    sample = labelled_sample(docs, labels, key, text, rows)
    words = _word_list(sample.where(~prune))
    stats = with_stats(sample, words).select(
        "_bad", prune.alias("_part"), base_failed().alias("_base"),
        *[F.expr(e).alias(f) for f, e in FEATURES.items()]).toPandas()
    stats = stats[~stats["_base"].to_numpy(dtype=bool)]
    y, part = stats["_bad"].to_numpy(dtype=bool), stats["_part"].to_numpy(dtype=bool)
    x = {f: stats[f].to_numpy(dtype=float) for f in FEATURES}
    return DecisionList(cover(x, y, part, precision) if len(y) else [], words)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``_q_base_failed``, ``_q_rule`` and ``_q_kept``."""
    out = with_stats(docs, rules.words, text).withColumn(P + "base_failed", base_failed())
    return out.withColumn(P + "rule", rules.rule_number()).withColumn(
        P + "kept", ~F.col(P + "base_failed") & (F.col(P + "rule") == 0))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return judge(docs, rules, text).where(F.col(P + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0) -> dict[str, int]:
    """How a list learned without one fold of the labelled documents does on that fold: counts of documents
    that base rules leave, by verdict (``rejected`` or ``kept``) and label (``bad`` or ``good``)."""
    mine = F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(folds)) == fold
    rules = learn(docs, labels.where(~mine), key, text)
    truth = labelled_sample(docs, labels.where(mine), key, text, SAMPLE_ROWS)
    rows = judge(truth, rules).where(~F.col(P + "base_failed")).groupBy("_bad", P + "kept").count().collect()
    out = {(r[P + "kept"], r["_bad"]): r["count"] for r in rows}
    return {f"{verdict}_{label}": out.get((verdict == "kept", label == "bad"), 0) for verdict in ("rejected", "kept") for label in ("bad", "good")}
