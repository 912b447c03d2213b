"""Memory of Python workers, which Spark uses again for later stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Hand free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, giving its memory back at the end, so that a worker does not keep the most it ever took."""

    @wraps(run)
    def wrapped(it: Iterator) -> Iterator:
        try:
            yield from run(it)
        finally:
            give_back()

    return wrapped


def slices(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
