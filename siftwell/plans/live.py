"""What works on files as queries: ``documents`` written out as a tree of files, and the same in DuckDB's SQL.

Each query writes a tree of its own in the folder that driver and executors share, which has to be a mount here.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import main
from ..functions.hashing import hash_files
from ..operators import duplicates, selection
from ..schemas import FILES
from ..sources import manifest as store
from ..sources.walk import walk
from ..storage import new_folder
from ..streaming.ingest import first_seen, ingest_stream
from .actions import counters, execute
from .catalogue import _EXT_SQL, _FILE_COLUMNS, _MANY, _NAME, _YM, _old_new, _plain, _sql, documents_as_files
from .engine import run_dedupe, scan
from .report import write_report, write_report_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The rows of a tree: a document without a text is an empty file.
_LIVE = ", live AS (SELECT coalesce(hash, md5('')) AS hash, coalesce(size, 0) AS size, mtime, path, doc_id FROM files)"


def _query(name: str, sql: str, empties: bool = False):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(documents_as_files(spark, sf_dir, empties))
        ORACLE_SQL[name] = _sql(f"{_LIVE} {sql}", empties)
        return f

    return add


def shared_mount(spark: SparkSession, name: str) -> str:
    """A new folder's path on the mount that all share; RuntimeError if they share no mount."""
    folder = new_folder(spark, name)
    if not re.match(r"file:|/", folder):
        raise RuntimeError(f"files can't be written below {folder}: it is on no mount")
    return re.sub(r"\Afile:/+", "/", folder)


def planted(files: DataFrame) -> str:
    """Write each row's text, with its time, to its path below a new folder; the folder. A task may write twice."""
    top = shared_mount(files.sparkSession, "tree")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                os.makedirs(os.path.dirname(top + r.path), exist_ok=True)
                part = f"{os.path.dirname(top)}/.{os.path.basename(top)}{r.path.replace('/', '-')}.{os.getpid()}"
                with open(part, "wb") as out:
                    out.write((r.text or "").encode())
                os.utime(part, (r.mtime, r.mtime))
                os.replace(part, top + r.path)
            yield pd.DataFrame({"n": [len(b)]})

    os.makedirs(top)
    files.select("path", "text", "mtime").mapInPandas(f, "n long").agg(F.sum("n")).collect()
    return top


def _below(files: DataFrame, top: str) -> DataFrame:
    """The rows with paths as they are below ``top``."""
    return files.withColumn("path", F.substring("path", len(top) + 1, 1 << 20))


def _at(files: DataFrame, top: str) -> DataFrame:
    return files.withColumn("path", F.concat(F.lit(top), "path"))


def _contents(spark: SparkSession, top: str) -> DataFrame:
    """path and hash of what lies below ``top`` now."""
    return _below(scan(spark, [top]), top).select("path", "hash")


@_query("walk_files", "SELECT path, size, mtime FROM live", empties=True)
def _(files):
    top = planted(files)
    return _below(walk(files.sparkSession, [top]), top).select("path", "size", "mtime")


@_query("walk_filtered", "SELECT path, size FROM live WHERE (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.gz') AND NOT (starts_with(path, '/corpus/src2/') OR path LIKE '%/fr/%')")
def _(files):
    top = planted(files)
    return _below(walk(files.sparkSession, [top], ["JPG", ".gz"], [f"{top}/corpus/src2", "*/fr"]), top).select("path", "size")


@_query("scan_files", "SELECT path, hash, size, CAST(NULL AS VARCHAR) AS error FROM live", empties=True)
def _(files):
    top = planted(files)
    return _below(scan(files.sparkSession, [top]), top).select("path", "hash", "size", "error")


@_query("scan_gate", "SELECT path, hash FROM live WHERE NOT path GLOB '/corpus/src[0-4]/*' AND lower(path) LIKE '%.jpg' AND NOT path LIKE '%/de/%'")
def _(files):
    top = planted(files)
    read = _at(_old_new(files)[0], top)
    return _below(scan(files.sparkSession, [top], ["jpg"], ["*/de"], read), top).select("path", "hash")


@_query("scan_counters", "SELECT 2 + count(DISTINCT split_part(path, '/', 3)) + count(DISTINCT split_part(path, '/', 3) || '/' || split_part(path, '/', 4)) AS directories, count(*) FILTER (lower(path) LIKE '%.jpg') AS accepted, count(*) FILTER (NOT lower(path) LIKE '%.jpg') AS ignored FROM live")
def _(files):
    spark, met = files.sparkSession, {}
    scan(spark, [planted(files)], ["jpg"], counts=met)
    return spark.createDataFrame([(met["directories"], met["accepted"], met["ignored"])], "directories long, accepted long, ignored long")


_GONE = "'[Errno 2] No such file or directory: ' || chr(39) || path || chr(39)"


@_query("scan_errors", f"SELECT path, CAST(NULL AS VARCHAR) AS hash, 'FileNotFoundError: ' || {_GONE} AS error FROM live")
def _(files):
    return hash_files(files).select("path", "hash", "error")


@_query("failed_copies", f"SELECT path, false AS ok, 'Error processing ' || chr(39) || path || chr(39) || ': [FileNotFoundError] ' || {_GONE} || chr(10) || '  Suggestions: File may have been deleted' AS error FROM live WHERE path LIKE '%.txt'")
def _(files):
    to = F.concat(F.lit(shared_mount(files.sparkSession, "target")), "path").alias("dest")
    plan = files.filter("path LIKE '%.txt'").select(F.lit("copy").alias("action"), "path", to, "hash", "size", F.lit(None).cast("string").alias("reason"))
    return execute(plan).select("path", "ok", F.regexp_extract("error", r"(?s)\A(.*been deleted)", 1).alias("error"))


@_query("dry_run_delete", "SELECT 'delete' AS action, path, hash, CAST(NULL AS BOOLEAN) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM files) WHERE rn > 1 AND size > 0", empties=True)
def _(files):
    return execute(selection.delete_plan(_plain(files)), dry_run=True).select("action", "path", "hash", "ok")


_FIRSTS = "SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM live"


@_query("copy_run", f"SELECT '/' || {_EXT_SQL} || {_YM} || '/' || {_NAME} AS path, hash FROM ({_FIRSTS}) WHERE rn = 1 OR size = 0", empties=True)
def _(files):
    spark, target = files.sparkSession, shared_mount(files.sparkSession, "target")
    run_dedupe(planted(files), copy_to_path=target, path_rules=["*:extension", "*:mtime"], spark=spark)
    return _contents(spark, target)


@_query("copy_counters", f"SELECT count(*) FILTER (rn = 1 OR size = 0) AS copied, count(*) FILTER (rn > 1 AND size > 0) AS skipped FROM ({_FIRSTS})", empties=True)
def _(files):
    spark, target = files.sparkSession, shared_mount(files.sparkSession, "target")
    plan = selection.transfer_plan(_at(_plain(files), planted(files)), target, ["/"])
    done = counters(execute(plan))
    return spark.createDataFrame([(done.get("copy_done", 0), done.get("skip_done", 0))], "copied long, skipped long")


_MOVED = f"SELECT path, hash FROM ({_FIRSTS} WHERE NOT path GLOB '/corpus/src[0-4]/*' AND hash NOT IN (SELECT hash FROM live WHERE path GLOB '/corpus/src[0-4]/*')) WHERE rn = 1 OR size = 0"


def _move(files: DataFrame) -> tuple[str, str, str]:
    """Move what no manifest of the old files has: the source, the target and the manifest that is left."""
    spark = files.sparkSession
    top, target, old, left = planted(files), *(shared_mount(spark, n) for n in ("target", "old", "left"))
    known = _plain(_old_new(files)[0]).na.fill({"size": 0})
    store.save(store.Manifest(known, known.select("path"), "md5"), old)
    run_dedupe(top, copy_to_path=target, compare_manifests=old, delete_on_copy=True, manifest_out_path=left, spark=spark)
    return top, target, left


@_query("move_run", f"SELECT 'target' AS place, path, hash FROM ({_MOVED})", empties=True)
def _(files):
    spark, (top, target, _) = files.sparkSession, _move(files)
    there = _contents(spark, target).withColumn("place", F.lit("target"))
    return there.unionByName(_contents(spark, top).withColumn("place", F.lit("source"))).select("place", "path", "hash")


@_query("move_run_manifest", _MOVED, empties=True)
def _(files):
    _, target, left = _move(files)
    return _below(store.load(files.sparkSession, left).files, target).select("path", "hash")


@_query("delete_run", f"SELECT path, hash FROM ({_FIRSTS}) WHERE NOT (rn > 1 AND size >= 1000)", empties=True)
def _(files):
    spark, top = files.sparkSession, planted(files)
    run_dedupe(top, delete_duplicates=True, min_delete_size=1000, spark=spark)
    return _contents(spark, top)


@_query("verify_run", "SELECT path, CASE WHEN path LIKE '%.txt' THEN 'missing' ELSE 'size' END AS error FROM live WHERE path LIKE '%.txt' OR path LIKE '%.tmp'")
def _(files):
    spark, known = files.sparkSession, shared_mount(files.sparkSession, "manifest")
    top = planted(files.filter("path NOT LIKE '%.txt'"))
    size = F.coalesce("size", F.lit(0)) + F.col("path").endswith(".tmp").cast("long")
    rows = _at(_plain(files).withColumn("size", size), top)
    store.save(store.Manifest(rows, rows.select("path"), "md5"), known)
    return _below(run_dedupe(manifests_in_paths=known, verify_manifest=True, spark=spark).errors, top)


@_query("manifest_saved", "SELECT hash, size, mtime, path FROM files")
def _(files):
    path = shared_mount(files.sparkSession, "manifest")
    store.save(store.Manifest(_plain(files), files.select("path"), "md5"), path)
    return store.load(files.sparkSession, path).files.select(*_FILE_COLUMNS)


@_query("manifest_appended", "SELECT path, path LIKE '%.jpg' AS late FROM files")
def _(files):
    path, late = shared_mount(files.sparkSession, "manifest"), F.col("path").like("%.jpg")
    store.save(store.Manifest(_plain(files.filter(~late)), files.filter(~late).select("path"), "md5"), path)
    store.append(store.Manifest(_plain(files.filter(late)), files.filter(late).select("path"), "md5"), path)
    return store.load(files.sparkSession, path).read.select("path", late.alias("late"))


def _stream(files: DataFrame, *columns: str) -> DataFrame:
    """The rows as a stream of files, a few of which are read in each batch."""
    folder = new_folder(files.sparkSession, "arriving")
    rows = files.select(*columns)
    rows.repartition(6, "path").write.parquet(folder)
    return files.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


@_query("manifest_streamed", "SELECT hash, size, mtime, path FROM files")
def _(files):
    spark = files.sparkSession
    path = shared_mount(spark, "manifest")
    ingest_stream(_stream(files, *FILES.names), path, new_folder(spark, "progress")).awaitTermination()
    return store.load(spark, path).files.select(*_FILE_COLUMNS)


@_query("stream_first_seen", "SELECT DISTINCT hash FROM files")
def _(files):
    spark = files.sparkSession
    found = _stream(files.withColumn("found_at", F.timestamp_seconds(F.lit(1704067200))), "hash", "path", "found_at")
    out = new_folder(spark, "seen")
    sink = first_seen(found).select("hash").writeStream.option("checkpointLocation", new_folder(spark, "progress"))
    sink.trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("hash string").parquet(out)


_LINE = f"concat_ws(', ', CAST(dense_rank() OVER (ORDER BY hash) AS VARCHAR), hash, chr(39) || path || chr(39), CAST(size AS VARCHAR)) AS line FROM files WHERE hash IN ({_MANY})"


def _without_time(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_replace("value", ", [^,]*$", "").alias("line"))


@_query("csv_report", f"SELECT 'Collision #, MD5, Path, Size (bytes)' AS line UNION ALL SELECT {_LINE}")
def _(files):
    path = shared_mount(files.sparkSession, "report")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if not write_report(duplicates.collisions(_plain(files)), path):
        raise RuntimeError(f"no report at {path}")
    return _without_time(files.sparkSession.read.text(f"file://{path}"))


@_query("csv_report_parts", f"SELECT {_LINE}")
def _(files):
    folder = new_folder(files.sparkSession, "report")
    write_report_parts(duplicates.collisions(_plain(files)), folder)
    return _without_time(files.sparkSession.read.schema("value string").text(folder))


_WANTED = "SELECT * FROM live WHERE (lower(path) LIKE '%.jpg' OR path LIKE '%.txt') AND NOT path LIKE '%/de/%'"


@_query("command_line", f"SELECT 0::BIGINT AS code, 'manifest' AS place, path, hash FROM ({_WANTED}) UNION ALL SELECT 0, 'target', path, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM ({_WANTED})) WHERE rn = 1 OR size = 0", empties=True)
def _(files):
    spark, top = files.sparkSession, planted(files)
    target, known = (shared_mount(spark, n) for n in ("target", "manifest"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    code = main(["-q", "--no-ui", "-p", top, "-e", "jpg", "-e", "txt", "--ignore", "*/de", "-c", target, "-m", known, "--time-zone", zone], spark)
    rows = _below(store.load(spark, known).files, top).select(F.lit("manifest").alias("place"), "path", "hash")
    there = _contents(spark, target).select(F.lit("target").alias("place"), "path", "hash")
    return rows.unionByName(there).select(F.lit(code).cast("long").alias("code"), "place", "path", "hash")
