"""What the operators of this subpackage share: written tables, sizes, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, new_folder, shared_root, written

__all__ = ["bottom", "dropped", "freeing", "kept", "new_folder", "parts_for", "release", "shared_root", "text_bytes", "utf8", "written"]


#: What a worker's functions keep from task to task, as long as no other stage's begin (``keep``).
kept: dict = {}
_released = float("-inf")


def release(least: float = 0.5, keep: bool = False) -> None:
    """Give memory that was freed back to the system, unless that was done less than so many seconds ago.

    A worker lives on from stage to stage; what it and its allocators keep adds up to the next stage's needs.
    """
    global _released
    if kept and not keep:
        kept.clear()
        least = 0
    if time.monotonic() - _released < least:
        return
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
    _released = time.monotonic()


def freeing(f, keep: bool = False):
    """A function of batches that gives back what ``f`` and those before it have freed."""

    def g(batches):
        release(keep=keep)
        yield from f(batches)
        release(0, keep)

    return g


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, as a count over all rows."""
    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """How many parts of ``each`` bytes ``total`` needs, at least the session's shuffle partitions."""
    return max(math.ceil(total / each), int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each row's bounds in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def bottom(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each index over the links ``a[i]``-``b[i]``; ``labels`` starts as ``arange``."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], least)
        np.minimum.at(new, labels[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        labels = new
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels
