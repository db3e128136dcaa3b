"""What Python workers keep between tasks.

Workers are reused, by all operators of a session. Each operator's memory of
words is bounded, but several of them together with what the allocators hold
back add up beside an executor's heap: a task empties the memories of other
operators when it begins and gives freed memory back when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom import runtime

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _trim = None

_memories: dict[str, dict] = {}


def memory(name: str) -> dict:
    """This worker's memory of that name: emptied by tasks that do not name it, never replaced."""
    return _memories.setdefault(name, {})


def forget(*but: str) -> None:
    """Empty all memories but these. They are caches: no result depends on them."""
    others = [m for name, m in _memories.items() if m and name not in but]
    for m in others:
        m.clear()
    if others:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system; else it counts as the worker's as long as that lives."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *memories: str) -> DataFrame:
    """rows.mapInArrow(run, schema) for a run that uses these memories and no others."""
    runtime.ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(*memories)
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(task, schema)
