"""Arrow batches in small slices, and memory given back between tasks that share a Python worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa


_MMAP_THRESHOLD, _ARENA_MAX = -3, -8  # mallopt() parameters


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks, and the next task may be of another operator.

    Arrays of a megabyte or more are mapped by themselves, so they leave no holes when they go.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        libc.mallopt(_ARENA_MAX, 2)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def without_gc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches, made without the collector of cycles: walking many remembered objects again and again would take
    most of the time, and none of them is in a cycle."""
    gc.disable()
    try:
        yield from rows
    finally:
        gc.enable()


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that Python objects exist for one slice at a time."""
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()
