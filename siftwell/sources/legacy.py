"""Reading manifests that other tools keep as SQLite tables of (key, hash, value).

A value has a type letter before it (S text, B bytes, I integer, F float, N null, X truth value, P pickle); without
one it is a pickle. Pickles are opened only if they hold nothing but lists, tuples, strings and numbers.
"""

from __future__ import annotations

import io
import pickle
import sqlite3
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schemas import FILES
from .manifest import Manifest

#: Rows read from SQLite before they become a DataFrame of their own.
BATCH = 50_000


class _Plain(pickle.Unpickler):
    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is no plain value")

    def persistent_load(self, pid):
        raise pickle.UnpicklingError("no plain value")


def plain(data: bytes):
    return _Plain(io.BytesIO(data)).load()


def value_of(data):
    """The value of a stored cell."""
    if not isinstance(data, bytes):
        return data
    kind, rest = data[:1], data[1:]
    if kind == b"S":
        return rest.decode()
    if kind in (b"I", b"F"):
        return int(rest) if kind == b"I" else float(rest)
    if kind == b"X":
        return rest not in (b"", b"0", b"False")
    simple = {b"B": lambda: rest, b"N": lambda: None, b"P": lambda: plain(rest)}
    return simple.get(kind, lambda: plain(data))()


def _cells(path: str) -> Iterator[tuple]:
    with sqlite3.connect(f"file:{Path(path).absolute()}?mode=ro", uri=True) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        for t in tables:
            quoted = '"' + t.replace('"', '""') + '"'
            names = {r[1] for r in db.execute(f"PRAGMA table_info({quoted})")}
            if {"key", "value"} <= names:
                yield from db.execute(f"SELECT key, value FROM {quoted}")


def _frame(spark: SparkSession, rows: Iterator[tuple], schema) -> DataFrame:
    out = spark.createDataFrame([], schema)
    while batch := list(islice(rows, BATCH)):
        out = out.unionByName(spark.createDataFrame(batch, schema))
    return out


def load_sqlite(spark: SparkSession, path: str, hash_algo: str | None = None) -> Manifest:
    """The manifest at ``path`` and the read paths beside it (``path.read``), read only.

    Without ``hash_algo`` it is told by the length of the first hash: 32 hex digits are md5, 16 are xxh64.
    """
    rows = ((str(value_of(k)), int(e[1]), float(e[2]), str(e[0])) for k, v in _cells(path) for e in value_of(v) or ())
    files = _frame(spark, rows, FILES)
    side = f"{path}.read"
    read = _frame(spark, ((str(value_of(k)),) for k, _ in _cells(side)), "path string") if Path(side).exists() else files.select("path").distinct()
    if hash_algo is None:
        first = files.first()
        hash_algo = "xxh64" if first and len(first["hash"]) == 16 else "md5"
    return Manifest(files, read, hash_algo)
