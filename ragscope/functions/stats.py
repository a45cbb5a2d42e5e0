"""Statistic names -> aggregate specs (``mean``, ``median``, ``std``, ``pN``)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Stat:
    kind: str  # "mean" | "std" | "quantile"
    p: float | None = None


_NAMED = {"mean": Stat("mean"), "std": Stat("std"), "median": Stat("quantile", 0.5)}


def resolve_stat(stat: str) -> Stat:
    """The spec of a statistic's name; ``pN`` takes whole percentiles from 0 to 100."""
    if stat in _NAMED:
        return _NAMED[stat]
    digits = stat[1:] if stat.startswith("p") else ""
    if not (digits.isascii() and digits.isdigit()):
        raise ValueError(f"no such statistic: {stat!r} (known: {sorted(_NAMED)} and percentiles such as p90)")
    if int(digits) > 100:
        raise ValueError(f"{stat!r} is not a percentile: the number has to lie in 0..100")
    return Stat("quantile", int(digits) / 100)
