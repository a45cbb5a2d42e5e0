"""Contract checks as data: a rule table -> a ``violations`` DataFrame.

Each rule is a named boolean Column that must hold; a null result counts
as "holds" (optional fields may be absent).  One projection builds the
array of failed rule names per row and explodes it: no shuffle, and rows
that pass produce nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, id_cols: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """``id_cols..., rule`` for every (row, rule) that fails."""
    failed = F.array(*[F.when(~F.coalesce(pred, F.lit(True)), F.lit(name)) for name, pred in rules.items()])
    return df.select(*id_cols, F.explode(F.array_compact(failed)).alias("rule"))


def non_negative(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_non_negative": F.col(c) >= 0 for c in cols}


def config_rules(k: str = "k", dims: str = "dimensions", strategy: str = "strategy",
                 chunk_size: str = "chunk_size", split_sequence: str = "split_sequence",
                 remote: str | None = None, remote_config: str | None = None) -> dict[str, Column]:
    """Run-configuration rules: k > 0, dimensions > 0, the fields a chunking
    strategy needs, and a remote generator needs its config."""
    rules = {
        "k_positive": F.col(k) > 0,
        "dimensions_positive": F.col(dims) > 0,
        "fixed_needs_chunk_size": F.when(F.col(strategy) == "fixed", F.col(chunk_size).isNotNull()),
        "char_split_needs_sequence": F.when(F.col(strategy) == "char_split", F.col(split_sequence).isNotNull()),
    }
    if remote and remote_config:
        rules["remote_needs_config"] = F.when(F.col(remote), F.col(remote_config).isNotNull())
    return rules


def equal_length(a: str, b: str) -> dict[str, Column]:
    return {f"{a}_{b}_equal_length": F.size(a) == F.size(b)}
