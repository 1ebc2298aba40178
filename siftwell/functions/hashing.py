"""Content hashes of columns and of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("md5", "xxh64")
_CHUNK = 1 << 20


def check_algorithm(name: str) -> str:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {name!r}; one of {', '.join(ALGORITHMS)}")
    return name


def hash_column(data: Column, algorithm: str = "md5") -> Column:
    """Lower-case hex of a string's UTF-8 bytes or of a binary; xxh64 has seed 0, which Spark's own xxhash64 has not."""
    if check_algorithm(algorithm) == "md5":
        return F.md5(data)

    @F.pandas_udf("string")
    def xxh64(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda x: None if x is None else xxhash.xxh64(x).hexdigest())

    return xxh64(data)


def hash_file(path: str, algorithm: str = "md5") -> str:
    """Lower-case hex of a file's bytes, read in pieces."""
    if check_algorithm(algorithm) == "md5":
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "md5").hexdigest()
    import xxhash

    h = xxhash.xxh64()
    with open(path, "rb") as f:
        while piece := f.read(_CHUNK):
            h.update(piece)
    return h.hexdigest()


def hash_files(found: DataFrame, algorithm: str = "md5", threads: int = 1) -> DataFrame:
    """``found`` (path, size, mtime) with ``hash`` and ``error``; a file that can't be read is a row with an error.

    A task reads ``threads`` files at once. Put filters and anti-joins before it: Spark moves none of them below a Python operator.
    """
    check_algorithm(algorithm)

    def one(path: str) -> tuple[str | None, str | None]:
        try:
            return hash_file(path, algorithm), None
        except OSError as e:
            return None, f"{type(e).__name__}: {e}"

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list((pool.map if threads > 1 else map)(one, b["path"]))
                yield pd.DataFrame({"hash": [h for h, _ in got], "size": b["size"], "mtime": b["mtime"], "path": b["path"], "error": [e for _, e in got]})

    return found.select("path", "size", "mtime").mapInPandas(f, "hash string, size long, mtime double, path string, error string")
