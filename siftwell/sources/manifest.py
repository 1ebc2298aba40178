"""Manifests: versioned tables of what has been scanned.

A manifest is a folder of parts and a pointer file. Each part is two Parquet tables, ``files`` (one row per path) and
``read`` (the paths that count as read). A save writes all rows as a new part, an append only what is new; then the
pointer is replaced, so a reader sees the old state or the new one, and inputs never change. The folder is on a mount
of the driver or, given as a URI, on any file system of Spark's.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import check_algorithm
from ..schemas import FILES

POINTER = "CURRENT.json"


@dataclass(frozen=True)
class Manifest:
    files: DataFrame
    read: DataFrame
    hash_algo: str


#: Parts from which on an append writes all rows anew.
MOST_PARTS = 64


def uri(path: str) -> str:
    return path.rstrip("/") if "://" in path else f"file://{os.path.abspath(path)}"


def same_place(a: str, b: str) -> bool:
    return uri(a) == uri(b)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: its parts in order, the hash algorithm, and the parts of earlier states."""
    fs, at = _file_system(spark, f"{uri(path)}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        now = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    listed = lambda x: [x] if isinstance(x, str) else x
    return {"parts": now.get("parts") or [now["version"]], "hash_algo": now["hash_algo"], "history": [listed(x) for x in now["history"]]}


def _point(spark: SparkSession, path: str, now: dict) -> None:
    fs, new = _file_system(spark, f"{uri(path)}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.hsync() if fs.getScheme() != "file" else out.flush()
    out.close()
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    to = jvm.org.apache.hadoop.fs.Path(f"{uri(path)}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, to, how)


def exists(spark: SparkSession, path: str) -> bool:
    return _pointer(spark, path) is not None


def load(spark: SparkSession, path: str) -> Manifest:
    """The manifest at ``path``: a folder as ``save`` makes it, or an SQLite file of another tool. ValueError if neither."""
    if "://" not in path and os.path.isfile(path):
        with open(path, "rb") as f:
            if f.read(16) != b"SQLite format 3\x00":
                raise ValueError(f"{path} is no manifest")
        from .legacy import load_sqlite

        return load_sqlite(spark, path)
    now = _pointer(spark, path)
    if now is None:
        raise ValueError(f"no manifest at {path}")
    parts = [f"{uri(path)}/{p}" for p in now["parts"]]
    files = spark.read.schema(FILES).parquet(*[f"{p}/files" for p in parts])
    read = spark.read.schema("path string").parquet(*[f"{p}/read" for p in parts])
    return Manifest(files, read, now["hash_algo"])


def load_all(spark: SparkSession, paths: Sequence[str]) -> Manifest:
    """One manifest of all: equal rows once, and every path read by any of them. Mixed algorithms are refused."""
    found = [load(spark, p) for p in paths]
    algorithms = {m.hash_algo for m in found}
    if len(algorithms) > 1:
        raise ValueError(f"manifests of different hash algorithms can't be joined: {', '.join(sorted(algorithms))}")
    files = reduce(DataFrame.unionByName, (m.files for m in found)).dropDuplicates(["hash", "path", "size", "mtime"])
    read = reduce(DataFrame.unionByName, (m.read for m in found)).distinct()
    return Manifest(files, read, found[0].hash_algo)


def empty(spark: SparkSession, hash_algo: str = "md5") -> Manifest:
    return Manifest(spark.createDataFrame([], FILES), spark.createDataFrame([], "path string"), check_algorithm(hash_algo))


def save(manifest: Manifest, path: str, keep: int = 2) -> None:
    """Write all rows as a new part and point to it; parts that none of the last ``keep`` states has are removed."""
    _written(manifest, path, keep, False)


def append(manifest: Manifest, path: str, keep: int = 2) -> None:
    """Add the rows of ``manifest`` to the one at ``path``, if there is one, without writing what it has again.

    From ``MOST_PARTS`` parts on all rows are written anew.
    """
    spark = manifest.files.sparkSession
    now = _pointer(spark, path)
    if now and now["hash_algo"] != manifest.hash_algo:
        raise ValueError(f"the manifest was made with {now['hash_algo']}, not {manifest.hash_algo}")
    if now and len(now["parts"]) >= MOST_PARTS:
        had = load(spark, path)
        whole = Manifest(had.files.unionByName(manifest.files.select(*FILES.names)), had.read.unionByName(manifest.read.select("path")), manifest.hash_algo)
        return _written(whole, path, keep, False)
    return _written(manifest, path, keep, True)


def _written(manifest: Manifest, path: str, keep: int, more: bool) -> None:
    check_algorithm(manifest.hash_algo)
    spark = manifest.files.sparkSession
    part = f"v-{uuid.uuid4().hex}"
    manifest.files.select(*FILES.names).write.parquet(f"{uri(path)}/{part}/files")
    manifest.read.select("path").distinct().write.parquet(f"{uri(path)}/{part}/read")
    before = _pointer(spark, path)
    parts = [*(before["parts"] if before and more else []), part]
    states = [*(before["history"] if before else []), parts]
    _point(spark, path, {"version": part, "parts": parts, "hash_algo": manifest.hash_algo, "history": states[-keep:]})
    kept = {p for state in states[-keep:] for p in state}
    for old in {p for state in states[:-keep] for p in state} - kept:
        fs, at = _file_system(spark, f"{uri(path)}/{old}")
        fs.delete(at, True)


def read_paths(files: DataFrame) -> DataFrame:
    return files.select("path").filter(F.col("path").isNotNull()).distinct()
