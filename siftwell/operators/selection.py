"""Plans: which rows are copied, moved, deleted or left, as DataFrames that can be read before anything is done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extensions import has_extension
from ..functions.globs import ignore_reason, ignored
from ..functions.rules import destination
from ..schemas import ACTIONS
from .duplicates import one_per_path


def unread(found: DataFrame, read: DataFrame) -> DataFrame:
    """What a scan found that has not been read before, by path alone."""
    return found.join(read.select("path").distinct(), "path", "left_anti")


def hashes(*tables: DataFrame) -> DataFrame:
    """The distinct hashes of all tables."""
    out = tables[0].select("hash")
    for t in tables[1:]:
        out = out.unionByName(t.select("hash"))
    return out.filter(F.col("hash").isNotNull()).distinct()


def _claimed(dedupe_empty: bool):
    return F.lit(dedupe_empty) | (F.col("size") != 0)


def copy_selection(files: DataFrame, compare: DataFrame | None = None, extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), roots: Sequence[str] = (), dedupe_empty: bool = False) -> DataFrame:
    """Rows to copy: of each hash that ``compare`` has not, the least path; every empty file unless ``dedupe_empty``.

    Ignored and excluded rows are gone before the choice, so they claim no hash.
    """
    path = F.col("path")
    rows = one_per_path(files).filter(has_extension(path, extensions) & ~ignored(path, ignore, roots))
    if compare is not None:
        rows = rows.join(hashes(compare), "hash", "left_anti")
    first = F.min_by(F.struct("size", "mtime", "path"), "path").alias("s")
    chosen = rows.filter(_claimed(dedupe_empty)).groupBy("hash").agg(first).select("hash", "s.size", "s.mtime", "s.path")
    return chosen if dedupe_empty else chosen.unionByName(rows.filter(~_claimed(dedupe_empty)).select(*chosen.columns))


def transfer_plan(files: DataFrame, target: str, roots: Sequence[str], rules: Sequence[str] = (), compare: DataFrame | None = None, extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), dedupe_empty: bool = False, move: bool = False) -> DataFrame:
    """One row of ACTIONS per file: copy (or move), delete, or skip with a reason.

    With ``move`` those that are neither ignored nor excluded and whose hash is in ``compare``, or is copied from
    another path, are deleted; empty files only with ``dedupe_empty`` or if ``compare`` has the empty hash. A row
    that is itself in ``compare`` (same hash and path) is never deleted.
    """
    rows, path = one_per_path(files), F.col("path")
    wanted = rows.filter(has_extension(path, extensions) & ~ignored(path, ignore, roots))
    first = wanted.filter(_claimed(dedupe_empty)).groupBy("hash").agg(F.min("path").alias("_first"))
    out = rows.join(first, "hash", "left")
    if compare is not None:
        out = out.join(hashes(compare).withColumn("_there", F.lit(True)), "hash", "left")
        out = out.join(compare.select("hash", "path").distinct().withColumn("_itself", F.lit(True)), ["hash", "path"], "left")
    else:
        out = out.withColumns({"_there": F.lit(None).cast("boolean"), "_itself": F.lit(None).cast("boolean")})
    there, itself = F.coalesce("_there", F.lit(False)), F.coalesce("_itself", F.lit(False))
    why = ignore_reason(path, ignore, roots)
    chosen = ~there & (~_claimed(dedupe_empty) | (path == F.col("_first")))
    action = (
        F.when(why.isNotNull(), "skip")
        .when(~has_extension(path, extensions), "skip")
        .when(chosen, "move" if move else "copy")
        .when(F.lit(move) & ~itself, "delete")
        .otherwise("skip")
    )
    reason = (
        F.when(why.isNotNull(), F.concat(F.lit("ignored by "), why))
        .when(~has_extension(path, extensions), "extension")
        .when(chosen, F.lit(None).cast("string"))
        .when(itself, "is the compared file")
        .when(there, "in compare")
        .otherwise("duplicate")
    )
    to = destination(target, roots, rules, path, F.col("mtime"), rows if rules else None)
    return out.select(action.alias("action"), "path", F.when(chosen & (action != "skip"), to).alias("dest"), "hash", "size", reason.alias("reason")).select(*ACTIONS.names)


def with_conflicts(plan: DataFrame, suffix: bool = False) -> DataFrame:
    """Plan rows that go to one destination: all but the least path become errors, or get their hash in the name.

    Of several of one hash, all but the least get a part of their path's md5 as well.
    """
    to = plan.filter(F.col("dest").isNotNull())
    crowded = to.groupBy("dest").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_first")).filter("_n > 1").select("dest", "_first")
    out = plan.join(crowded, "dest", "left").withColumn("_late", F.coalesce(F.col("path") != F.col("_first"), F.lit(False)))
    if suffix:
        ext = F.regexp_extract("dest", r"(?s)\A(?:.*/)?\.*[^/.][^/]*(\.[^./]*)\z", 1)
        alike = out.filter("_late").groupBy("dest", "hash").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_least")).filter("_n > 1").select("dest", "hash", "_least")
        out = out.join(alike, ["dest", "hash"], "left")
        more = F.when(F.col("path") > F.col("_least"), F.concat(F.lit("-"), F.substring(F.md5("path"), 1, 16))).otherwise("")
        named = F.concat(F.substring("dest", F.lit(1), F.length("dest") - F.length(ext)), F.lit("-"), F.col("hash"), more, ext)
        return out.withColumn("dest", F.when(F.col("_late"), named).otherwise(F.col("dest"))).select(*ACTIONS.names)
    late = {"action": F.when(F.col("_late"), "error").otherwise(F.col("action")), "reason": F.when(F.col("_late"), "another file goes to this destination").otherwise(F.col("reason"))}
    return out.withColumns(late).select(*ACTIONS.names)


def delete_plan(files: DataFrame, compare: DataFrame | None = None, min_size: int = 0, dedupe_empty: bool = False, extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), roots: Sequence[str] = ()) -> DataFrame:
    """Rows to delete: with ``compare`` every row whose hash it has, else all but the least path of each hash.

    Sizes below ``min_size`` and, unless ``dedupe_empty``, empty files stay; so do ignored and excluded rows, and
    rows that are themselves in ``compare``.
    """
    rows, path = one_per_path(files), F.col("path")
    if compare is None:
        first = rows.groupBy("hash").agg(F.min("path").alias("_first"))
        marked = rows.join(first, "hash").filter(path != F.col("_first")).withColumn("reason", F.concat(F.lit("same as "), F.col("_first")))
    else:
        marked = rows.join(hashes(compare), "hash", "left_semi").join(compare.select("hash", "path").distinct(), ["hash", "path"], "left_anti").withColumn("reason", F.lit("in compare"))
    keep = (F.col("size") >= min_size) & (F.lit(dedupe_empty) | (F.col("size") > 0)) & has_extension(path, extensions) & ~ignored(path, ignore, roots)
    return marked.filter(keep).select(F.lit("delete").alias("action"), "path", F.lit(None).cast("string").alias("dest"), "hash", "size", "reason")
