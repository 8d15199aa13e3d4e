"""Helpers for code that runs inside Spark's Python workers."""

from __future__ import annotations

import sys
import types


def once(key, build):
    """``build()`` once per worker process; workers live longer than tasks, pickled functions don't."""
    store = sys.modules.setdefault("_specula_worker_store", types.ModuleType("_specula_worker_store")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def slices(batches, rows: int = 256):
    """The Arrow batches in pieces of few rows, so that Python objects of long texts stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def release():
    """Hand freed memory back to the system: a worker waits for its next task with what the last one left."""
    import ctypes
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Remembering(dict):
    """A cache that computes missing values and empties itself at a fixed number of entries."""

    def __init__(self, compute, most: int = 300_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
