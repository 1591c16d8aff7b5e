"""Python workers live on between stages; what a task took should not stay with them."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return free memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not glibc: its allocator returns memory by itself, or not at all.
        return


_caches: list[Callable] = []


def let_go_later(cached: Callable) -> Callable:
    """Mark a function with ``lru_cache`` whose results other operators' tasks let go of."""
    _caches.append(cached)
    return cached


def let_go(keep: Callable | None = None) -> None:
    """Drop what earlier operators have cached in this worker, but for ``keep``."""
    held = [c for c in _caches if c is not keep and c.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        give_back()


def giving_back(read: Callable, keep: Callable | None = None) -> Callable:
    """A function over batches that drops what others have cached first, and returns free memory when its task ends."""

    @functools.wraps(read)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keep)
        try:
            yield from read(batches)
        finally:
            give_back()

    return run
