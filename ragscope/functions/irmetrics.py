"""IR metrics as Column expressions over array columns (JVM-side, no UDF).

``retrieved`` is the ranked list of document ids (duplicates allowed: one
per retrieved chunk), ``relevant`` the ground-truth ids.  Semantics:

* recall@k: de-duplicate retrieved keeping first occurrences, keep the
  first k, hits / |distinct relevant|; empty relevant -> 0.0.
* precision@k: same top-k, hits / |top-k|; empty top-k -> 0.0.
* MRR: 1 / position of the first relevant id in the *un-deduplicated,
  uncut* list; none found or either list empty -> 0.0.

``k`` is an int literal (validated) or a Column.  The scoring step turns
all three into null when the relevant set is empty (``score_columns``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _k(k) -> Column:
    if isinstance(k, int):
        if k <= 0:
            raise ValueError("k must be > 0")
        return F.lit(k)
    return F.when(_col(k) > 0, _col(k)).otherwise(F.raise_error(F.lit("k must be > 0")))


def _arr(c) -> Column:
    return F.coalesce(_col(c), F.array().cast("array<string>"))


def top_k_distinct(retrieved, k) -> Column:
    return F.slice(F.array_distinct(_arr(retrieved)), 1, _k(k))


def _hits(top: Column, relevant) -> Column:
    rel = _arr(relevant)
    return F.size(F.filter(top, lambda x: F.array_contains(rel, x)))


def recall_at_k(retrieved, relevant, k) -> Column:
    rel = F.array_distinct(_arr(relevant))
    hits = _hits(top_k_distinct(retrieved, k), relevant)
    return F.when(F.size(rel) == 0, F.lit(0.0)).otherwise(hits / F.size(rel))


def precision_at_k(retrieved, relevant, k) -> Column:
    top = top_k_distinct(retrieved, k)
    return F.when(F.size(top) == 0, F.lit(0.0)).otherwise(_hits(top, relevant) / F.size(top))


def mrr(retrieved, relevant) -> Column:
    ret, rel = _arr(retrieved), _arr(relevant)
    pos = F.array_position(F.transform(ret, lambda x: F.array_contains(rel, x)), True)
    return F.when((F.size(ret) == 0) | (F.size(rel) == 0) | (pos == 0), F.lit(0.0)).otherwise(1.0 / pos)


def score_columns(retrieved, relevant, k) -> dict[str, Column]:
    """Per-evaluation metrics; all null when there is no relevant document."""
    has_rel = F.size(_arr(relevant)) > 0
    return {
        "recall_at_k": F.when(has_rel, recall_at_k(retrieved, relevant, k)),
        "precision_at_k": F.when(has_rel, precision_at_k(retrieved, relevant, k)),
        "mrr": F.when(has_rel, mrr(retrieved, relevant)),
    }
