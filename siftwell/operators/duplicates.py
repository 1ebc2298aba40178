"""Groups of equal content, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extensions import labelled_extension

#: Hex digits by which groups are numbered in parallel; so many prefixes at most pass through one task.
_PREFIX = 3


def one_per_path(files: DataFrame) -> DataFrame:
    """One row for each hash and path, the one of latest mtime: a path listed twice is no duplicate of itself."""
    latest = F.max_by(F.struct("size", "mtime"), F.coalesce("mtime", F.lit(float("-inf")))).alias("s")
    return files.groupBy("hash", "path").agg(latest).select("hash", "s.size", "s.mtime", "path")


def groups(files: DataFrame) -> DataFrame:
    """(hash, n, bytes, keeper): each hash's number of paths, their bytes, and the least path."""
    return files.groupBy("hash").agg(F.count("path").alias("n"), F.sum("size").alias("bytes"), F.min("path").alias("keeper"))


def collisions(new: DataFrame, old: DataFrame | None = None, dedupe_empty: bool = False, ignore_old: bool = False) -> DataFrame:
    """All rows, old and new, of the hashes that count as duplicated.

    A hash counts if something new came to make it more than one, empty files only with ``dedupe_empty``; or if the
    old rows alone have it more than once, unless ``ignore_old``. Without ``old`` all rows count as new.
    """
    every = new.withColumn("_new", F.lit(True))
    if old is not None:
        every = every.unionByName(old.withColumn("_new", F.lit(False)))
    seen = every.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("n_new"), F.max(F.when(F.col("_new"), F.col("size"))).alias("new_size"))
    fresh = (F.col("n_new") > 0) & (F.col("n") > 1) & (F.lit(dedupe_empty) | (F.col("new_size") > 0))
    before = F.lit(not ignore_old) & (F.col("n") - F.col("n_new") > 1)
    return every.drop("_new").join(seen.filter(fresh | before).select("hash"), "hash", "left_semi")


def known_collisions(files: DataFrame) -> DataFrame:
    """Rows of hashes that a manifest has more than once, empty files among them."""
    many = files.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    return files.join(many, "hash", "left_semi")


def numbered(collided: DataFrame) -> DataFrame:
    """The rows with ``group``: 1, 2, ... in order of hash.

    Hashes are counted by their first digits, and numbered within those: no task sees all of them.
    """
    hashes = collided.select("hash").distinct().withColumn("_prefix", F.substring("hash", 1, _PREFIX))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashes.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_prefix").orderBy("hash"))
    numbers = hashes.withColumn("_within", within).join(base, "_prefix").select("hash", (F.col("_base") + F.col("_within")).cast("long").alias("group"))
    return collided.join(numbers, "hash")


def extension_sizes(files: DataFrame) -> DataFrame:
    """(ext, bytes, n) of all rows by extension."""
    return files.groupBy(labelled_extension(F.col("path")).alias("ext")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def top_extensions(files: DataFrame, by: str = "bytes", k: int = 10) -> DataFrame:
    """The ``k`` extensions of most bytes or (``by="n"``) most files, ties in order of name."""
    return extension_sizes(files).orderBy(F.desc(by), "ext").limit(k)
