"""Memory of Python workers, which Spark keeps for the tasks that follow.

Arrow's pool and the C library keep freed memory for themselves, so an idle
worker goes on holding the peak of its last task.  Functions wrapped here give
it back to the system when they end; results are not touched.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return free memory to the system (the part of the C library's only where it can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def after_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For ``mapInArrow``: gives memory back after the last batch."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def after_group(run: Callable[[pa.Table], pa.Table]):
    """For ``applyInArrow`` over few, large groups: gives memory back after each."""

    @functools.wraps(run)
    def group(table):
        try:
            return run(table)
        finally:
            give_back()

    return group
