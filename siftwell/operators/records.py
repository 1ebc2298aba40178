"""Operations on manifest rows: removing, moving, converting, looking up, verifying."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import moved_prefix, year_month

#: Rows of one hash from which on its nested view has several parts.
MOST_NESTED = 100_000


def union_files(*tables: DataFrame) -> DataFrame:
    """All rows, those that are equal in hash, path, size and mtime once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["hash", "path", "size", "mtime"])


def nested(files: DataFrame, most: int = MOST_NESTED) -> DataFrame:
    """(hash, part, files): each hash with its (path, size, mtime) in order of path; a row of part 0 for most hashes.

    A hash of more than ``most`` rows has several parts of about that many, dealt by path, so no task holds all of it.
    """
    counts = files.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    crowded = counts.select(F.col("hash").alias("_hash"), F.ceil(F.col("_n") / most).alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64("path"), F.col("_parts")), F.lit(0)).alias("part")
    dealt = files.join(crowded, F.col("hash").eqNullSafe(F.col("_hash")), "left").select("hash", part, "path", "size", "mtime")
    return dealt.groupBy("hash", "part").agg(F.array_sort(F.collect_list(F.struct("path", "size", "mtime"))).alias("files"))


def flattened(by_hash: DataFrame) -> DataFrame:
    """The reverse of ``nested``: one row per path."""
    return by_hash.select("hash", F.explode("files").alias("f")).select("hash", "f.size", "f.mtime", "f.path")


def info_rows(files: DataFrame) -> DataFrame:
    """(hash, path, year_month, size) of each row."""
    return files.select("hash", "path", year_month(F.col("mtime")).alias("year_month"), "size")


def remove_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path").distinct(), "path", "left_anti").select(*files.columns)


def move_paths(files: DataFrame, moved: DataFrame) -> DataFrame:
    """``moved`` (path, dest) gives rows a new path; hash, size and mtime stay."""
    to = moved.groupBy("path").agg(F.min("dest").alias("_dest"))
    return files.join(to, "path", "left").withColumn("path", F.coalesce("_dest", "path")).select(*files.columns)


def convert_paths(files: DataFrame, old: str, new: str, anywhere: bool = False) -> DataFrame:
    return files.withColumn("path", moved_prefix(F.col("path"), old, new, anywhere))


def info(files: DataFrame) -> DataFrame:
    """(hashes, files, bytes) of a manifest."""
    return files.agg(F.countDistinct("hash").alias("hashes"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def listed(files: DataFrame, k: int = 10) -> DataFrame:
    """Rows of the first ``k`` hashes."""
    first = files.select("hash").distinct().orderBy("hash").limit(k)
    return files.join(first, "hash", "left_semi").orderBy("hash", "path")


def find(files: DataFrame, query: str) -> DataFrame:
    """Rows of this hash, and those whose path contains the query."""
    return files.filter((F.col("hash") == query) | F.col("path").contains(query))


def common_root(files: DataFrame) -> str | None:
    """The deepest directory that holds all paths: what the least and the greatest have in common."""
    low, high = files.agg(F.min("path"), F.max("path")).first()
    if low is None:
        return None
    root = os.path.commonpath([low, high]) if low.startswith("/") == high.startswith("/") else ""
    return os.path.dirname(root) if root in (low, high) else root


def verified(files: DataFrame, live: DataFrame) -> DataFrame:
    """Each row with ``status``: ok, missing, size or error, against ``live`` (path, size, error) as a walk gives it."""
    now = live.groupBy("path").agg(F.max("size").alias("_size"), F.max("error").alias("_error"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_error").isNotNull(), "error").when(F.col("_size") != F.col("size"), "size").otherwise("ok")
    return files.join(now, "path", "left").withColumn("status", status).select(*files.columns, "status")


def verify_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "ok").alias("verified"), F.count_if(F.col("status") != "ok").alias("errors"))
