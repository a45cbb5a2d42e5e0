"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(c, digits: int) -> Column:
    """Round on the binary value of ``c * 10^digits`` (half away from zero).

    Spark's ``round`` rounds the shortest decimal string HALF_UP, so
    2.675 -> 2.68, while Python's ``round`` and C's ``round(x * 10^d) / 10^d``
    see the binary value 2.67499999... -> 2.67.  This follows the latter.
    """
    col = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(col * F.lit(m), 0) / F.lit(m)
