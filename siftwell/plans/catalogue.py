"""Each operator as a query over the driver's ``documents``, seen as files, and the same in DuckDB's SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extensions import extension, has_extension, labelled_extension
from ..functions.globs import any_glob, ignore_reason, ignored
from ..functions.hashing import hash_column
from ..functions.paths import year_month
from ..functions.rules import destination
from ..operators import duplicates, records, selection
from .report import report_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SUFFIX = {0: ".jpg", 1: ".JPG", 2: ".tar.gz", 3: "", 4: ".txt"}
_FILE_COLUMNS = ("hash", "size", "mtime", "path")


def documents_as_files(spark: SparkSession, sf_dir: str, empties: bool = False) -> DataFrame:
    """hash, size, mtime, path, doc_id and text of each document; with ``empties`` those of source src3 have no content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    text = F.when(F.col("source") == "src3", F.lit("")).otherwise(F.col("text")) if empties else F.col("text")
    end = F.lit(".tmp")
    for k, v in _SUFFIX.items():
        end = F.when(F.col("doc_id") % 6 == k, F.lit(v)).otherwise(end)
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), end)
    return docs.select(hash_column(text).alias("hash"), F.octet_length(text).cast("long").alias("size"), (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double").alias("mtime"), path.alias("path"), "doc_id", text.alias("text"))


def _sql(body: str, empties: bool = False) -> str:
    text = "CASE WHEN source = 'src3' THEN '' ELSE text END" if empties else "text"
    return f"""WITH files AS (SELECT md5(t) AS hash, CAST(strlen(t) AS BIGINT) AS size, CAST(1704067200 + doc_id * 3600 AS DOUBLE) AS mtime,
  concat('/corpus/', source, '/', lang, '/doc_', lpad(CAST(doc_id AS VARCHAR), 7, '0'), CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' WHEN 4 THEN '.txt' ELSE '.tmp' END) AS path, doc_id
  FROM (SELECT *, {text} AS t FROM documents)) {body}"""


def _query(name: str, sql: str | None = None, empties: bool = False):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(documents_as_files(spark, sf_dir, empties))
        if sql:
            ORACLE_SQL[name] = _sql(sql, empties)
        return f

    return add


def _plain(files: DataFrame) -> DataFrame:
    return files.select(*_FILE_COLUMNS)


_EXT_SQL = r"coalesce(nullif(lower(regexp_extract(path, '(?s)\A(?:.*/)?\.*[^/.][^/]*\.([^./]*)\z', 1)), ''), 'no_extension')"


@_query("hash_files", "SELECT path, hash, size FROM files")
def _(files):
    return files.select("path", "hash", "size")


@_query("xxh64_files")
def _(files):
    return files.select("path", hash_column(F.col("text"), "xxh64").alias("hash"))


@_query("extension_of", rf"SELECT path, {_EXT_SQL} AS ext FROM files")
def _(files):
    return files.select("path", F.when(extension(F.col("path")) == "", "no_extension").otherwise(extension(F.col("path"))).alias("ext"))


@_query("year_month", "SELECT path, strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y_%m') AS ym FROM files")
def _(files):
    return files.select("path", year_month(F.col("mtime")).alias("ym"))


@_query("group_by_hash", 'SELECT hash, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS keeper FROM files GROUP BY hash')
def _(files):
    return duplicates.groups(files)


@_query("hash_set", "SELECT DISTINCT hash FROM files")
def _(files):
    return selection.hashes(files)


@_query("collisions_report", 'SELECT dense_rank() OVER (ORDER BY hash) AS "group", hash, path, size, mtime FROM files WHERE hash IN (SELECT hash FROM files GROUP BY hash HAVING count(*) > 1)')
def _(files):
    return duplicates.numbered(duplicates.collisions(_plain(files))).select("group", "hash", "path", "size", "mtime")


_MANY = "SELECT hash FROM files GROUP BY hash HAVING count(*) > 1"


@_query("collisions_dedupe_empty_on", f"SELECT hash, path, size FROM files WHERE hash IN ({_MANY})", empties=True)
def _(files):
    return duplicates.collisions(_plain(files), dedupe_empty=True).select("hash", "path", "size")


@_query("collisions_dedupe_empty_off", f"SELECT hash, path, size FROM files WHERE size > 0 AND hash IN ({_MANY})", empties=True)
def _(files):
    return duplicates.collisions(_plain(files)).select("hash", "path", "size")


@_query("collisions_no_walk", f"SELECT hash, path, size FROM files WHERE hash IN ({_MANY})", empties=True)
def _(files):
    return duplicates.known_collisions(_plain(files)).select("hash", "path", "size")


def _old_new(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = F.col("path").rlike("^/corpus/src[0-4]/")
    return _plain(files.filter(old)), _plain(files.filter(~old))


_SEEN = "SELECT hash, count(*) AS n, count(*) FILTER (NOT path GLOB '/corpus/src[0-4]/*') AS n_new, max(size) AS s FROM files GROUP BY hash"


@_query("collisions_ignore_old", f"SELECT hash, path FROM files WHERE hash IN (SELECT hash FROM ({_SEEN}) WHERE n_new > 0 AND n > 1 AND s > 0)", empties=True)
def _(files):
    old, new = _old_new(files)
    return duplicates.collisions(new, old, ignore_old=True).select("hash", "path")


@_query("collisions_with_old", f"SELECT hash, path FROM files WHERE hash IN (SELECT hash FROM ({_SEEN}) WHERE n_new > 0 AND n > 1 AND s > 0 OR n - n_new > 1)", empties=True)
def _(files):
    old, new = _old_new(files)
    return duplicates.collisions(new, old).select("hash", "path")


_EXT_ROLL = f"SELECT {_EXT_SQL} AS ext, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM files GROUP BY 1"


@_query("ext_rollup", _EXT_ROLL)
def _(files):
    return duplicates.extension_sizes(files)


@_query("ext_top10_size", f"SELECT * FROM ({_EXT_ROLL}) ORDER BY bytes DESC, ext LIMIT 10")
def _(files):
    return duplicates.top_extensions(files)


@_query("ext_top10_count", f"SELECT * FROM ({_EXT_ROLL}) ORDER BY n DESC, ext LIMIT 10")
def _(files):
    return duplicates.top_extensions(files, "n")


@_query("total_bytes", "SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM files")
def _(files):
    return files.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


@_query("ignore_glob", "SELECT path FROM files WHERE NOT (path GLOB '*/src1/*' OR path GLOB '*.t?p' OR path GLOB '*[37].txt')")
def _(files):
    return files.filter(~any_glob(F.col("path"), ["*/src1/*", "*.t?p", "*[37].txt"])).select("path")


@_query("ignore_prune_dir", "SELECT path FROM files WHERE NOT (starts_with(path, '/corpus/src2/') OR path LIKE '%/fr/%')")
def _(files):
    return files.filter(~ignored(F.col("path"), ["/corpus/src2", "*/fr"], ["/corpus"])).select("path")


@_query("ignore_reason", "SELECT path, CASE WHEN path LIKE '/corpus/src1%' THEN '/corpus/src1*' WHEN path LIKE '%/de/%' THEN '*/de' WHEN path LIKE '%.jpg' THEN '*.jpg' END AS reason FROM files")
def _(files):
    return files.select("path", ignore_reason(F.col("path"), ["*.jpg", "/corpus/src1*", "*/de"], ["/corpus"]).alias("reason"))


@_query("ext_filter", "SELECT path FROM files WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.gz' OR lower(path) GLOB '*.t?t'")
def _(files):
    return files.filter(has_extension(F.col("path"), ["JPG", ".gz", "t?t"])).select("path")


@_query("resume_anti_join", "SELECT path, size FROM files WHERE NOT path GLOB '/corpus/src[0-4]/*'")
def _(files):
    return selection.unread(files, _old_new(files)[0]).select("path", "size")


@_query("copy_plan", "SELECT hash, min(path) AS path FROM files GROUP BY hash")
def _(files):
    return selection.copy_selection(_plain(files)).select("hash", "path")


@_query("copy_plan_empties", "SELECT hash, min(path) AS path FROM files WHERE size > 0 GROUP BY hash UNION ALL SELECT hash, path FROM files WHERE size = 0", empties=True)
def _(files):
    return selection.copy_selection(_plain(files)).select("hash", "path")


@_query("copy_plan_compare", "SELECT hash, min(path) AS path FROM files WHERE NOT path GLOB '/corpus/src[0-4]/*' AND hash NOT IN (SELECT hash FROM files WHERE path GLOB '/corpus/src[0-4]/*') GROUP BY hash")
def _(files):
    old, new = _old_new(files)
    return selection.copy_selection(new, old).select("hash", "path")


@_query("copy_plan_filtered", "SELECT hash, min(path) AS path FROM files WHERE lower(path) LIKE '%.jpg' AND NOT path GLOB '*/en/*' GROUP BY hash")
def _(files):
    return selection.copy_selection(_plain(files), extensions=["jpg"], ignore=["*/en/*"]).select("hash", "path")


@_query(
    "move_plan",
    """, c AS (SELECT hash FROM files WHERE path GLOB '/corpus/src[0-4]/*'), n AS (SELECT * FROM files WHERE NOT path GLOB '/corpus/src[0-4]/*'), f AS (SELECT hash, min(path) AS first FROM n WHERE size > 0 GROUP BY hash)
SELECT CASE WHEN n.hash IN (SELECT hash FROM c) THEN 'delete' WHEN size = 0 OR path = first THEN 'move' ELSE 'delete' END AS action, path,
  CASE WHEN n.hash IN (SELECT hash FROM c) THEN NULL WHEN size = 0 OR path = first THEN '/target' || substr(path, 8) END AS dest FROM n LEFT JOIN f USING (hash)""",
    empties=True,
)
def _(files):
    old, new = _old_new(files)
    return selection.transfer_plan(new, "/target", ["/corpus"], compare=old, move=True).select("action", "path", "dest")


@_query("delete_plan", "SELECT path, hash, size FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM files) WHERE rn > 1 AND size > 0", empties=True)
def _(files):
    return selection.delete_plan(_plain(files)).select("path", "hash", "size")


@_query("delete_plan_empties", "SELECT path, hash, size FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM files) WHERE rn > 1", empties=True)
def _(files):
    return selection.delete_plan(_plain(files), dedupe_empty=True).select("path", "hash", "size")


@_query("delete_plan_compare", "SELECT path FROM files WHERE NOT path GLOB '/corpus/src[0-4]/*' AND hash IN (SELECT hash FROM files WHERE path GLOB '/corpus/src[0-4]/*')")
def _(files):
    old, new = _old_new(files)
    return selection.delete_plan(new, old).select("path")


@_query("delete_min_size", "SELECT path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM files) WHERE rn > 1 AND size >= 2000")
def _(files):
    return selection.delete_plan(_plain(files), min_size=2000).select("path")


def _dest(name: str, rules: list[str], sql: str) -> None:
    @_query(name, f"SELECT path, '/target' || {sql} AS dest FROM files")
    def _(files):
        return files.select("path", destination("/target", ["/corpus"], rules, F.col("path"), F.col("mtime"), files).alias("dest"))


_NAME, _YM, _INNER = "split_part(path, '/', 5)", "'/' || strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y_%m')", "'/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4)"
_dest("dest_default", [], "substr(path, 8)")
_dest("dest_mtime", ["*:mtime"], f"{_YM} || '/' || {_NAME}")
_dest("dest_extension", ["*:extension"], f"'/' || {_EXT_SQL} || '/' || {_NAME}")
_dest("dest_no_change", ["*:no_change"], f"{_INNER} || '/' || {_NAME}")
_dest("dest_combined", ["*:extension", "*:mtime", "*:no_change"], f"'/' || {_EXT_SQL} || {_YM} || {_INNER} || '/' || {_NAME}")
_dest("dest_best_match", ["*.j*:no_change", "*.jp*:mtime", "*.jpg:extension", "gz:mtime", "*.tm?:extension", "*.t?p:mtime", "*.*:no_change"], f"CASE {_EXT_SQL} WHEN 'jpg' THEN '/jpg' WHEN 'tmp' THEN '/tmp' WHEN 'gz' THEN {_YM} ELSE {_INNER} END || '/' || {_NAME}")


@_query("dest_conflicts", ", r AS (SELECT doc_id, '/out/f' || CAST(doc_id % 97 AS VARCHAR) AS dest, path FROM files) SELECT path, dest, CASE WHEN path = min(path) OVER (PARTITION BY dest) THEN 'copy' ELSE 'error' END AS action FROM r")
def _(files):
    plan = files.select(F.lit("copy").alias("action"), "path", F.concat(F.lit("/out/f"), (F.col("doc_id") % 97).cast("string")).alias("dest"), "hash", "size", F.lit(None).cast("string").alias("reason"))
    return selection.with_conflicts(plan).select("path", "dest", "action")


@_query("dest_suffixed", ", r AS (SELECT *, CASE WHEN size = 0 THEN '/out/e.x' ELSE '/out/f' || CAST(doc_id % 97 AS VARCHAR) || '.x' END AS dest FROM files), l AS (SELECT *, path > min(path) OVER (PARTITION BY dest) AS late FROM r), n AS (SELECT *, path > min(path) OVER (PARTITION BY dest, hash, late) AS again FROM l) SELECT path, CASE WHEN late THEN replace(dest, '.x', '-' || hash || CASE WHEN again THEN '-' || md5(path)[1:16] ELSE '' END || '.x') ELSE dest END AS dest FROM n", empties=True)
def _(files):
    to = F.when(F.col("size") == 0, "/out/e.x").otherwise(F.concat(F.lit("/out/f"), (F.col("doc_id") % 97).cast("string"), F.lit(".x")))
    plan = files.select(F.lit("copy").alias("action"), "path", to.alias("dest"), "hash", "size", F.lit(None).cast("string").alias("reason"))
    return selection.with_conflicts(plan, suffix=True).select("path", "dest")


@_query("hash_union", "SELECT hash FROM files WHERE path LIKE '%.jpg' UNION SELECT hash FROM files WHERE path LIKE '%.txt'")
def _(files):
    return selection.hashes(files.filter("path LIKE '%.jpg'"), files.filter("path LIKE '%.txt'"))


@_query("report_lines", "SELECT concat_ws(', ', CAST(dense_rank() OVER (ORDER BY hash) AS VARCHAR), hash, chr(39) || path || chr(39), CAST(size AS VARCHAR)) AS line FROM files WHERE hash IN (SELECT hash FROM files GROUP BY hash HAVING count(*) > 1)")
def _(files):
    lines = report_lines(duplicates.known_collisions(_plain(files)))
    return lines.select(F.regexp_replace("line", ", [^,]*$", "").alias("line"))


@_query("manifest_union", "SELECT hash, path, size, mtime FROM files WHERE NOT path LIKE '%.jpg' UNION SELECT hash, path, size, mtime FROM files WHERE NOT path LIKE '%.txt'")
def _(files):
    return records.union_files(_plain(files.filter("path NOT LIKE '%.jpg'")), _plain(files.filter("path NOT LIKE '%.txt'"))).select("hash", "path", "size", "mtime")


@_query("manifest_remove", "SELECT hash, path FROM files WHERE NOT path LIKE '%.tmp'")
def _(files):
    return records.remove_paths(_plain(files), files.filter("path LIKE '%.tmp'")).select("hash", "path")


@_query("manifest_move", "SELECT hash, CASE WHEN path LIKE '%.txt' THEN '/moved/' || CAST(doc_id AS VARCHAR) ELSE path END AS path FROM files")
def _(files):
    moved = files.filter("path LIKE '%.txt'").select("path", F.concat(F.lit("/moved/"), F.col("doc_id").cast("string")).alias("dest"))
    return records.move_paths(_plain(files), moved).select("hash", "path")


@_query("convert_paths", "SELECT hash, CASE WHEN starts_with(path, '/corpus/src1/') THEN '/else' || substr(path, 13) ELSE path END AS path FROM files")
def _(files):
    return records.convert_paths(_plain(files), "/corpus/src1", "/else").select("hash", "path")


@_query("convert_paths_anywhere", "SELECT hash, CASE WHEN instr(path, '/doc_') > 0 THEN substr(path, 1, instr(path, '/doc_') - 1) || '/file-' || substr(path, instr(path, '/doc_') + 5) ELSE path END AS path FROM files")
def _(files):
    return records.convert_paths(_plain(files), "/doc_", "/file-", anywhere=True).select("hash", "path")


@_query("path_difference", "SELECT path FROM files EXCEPT SELECT path FROM files WHERE path LIKE '%.jpg'")
def _(files):
    return records.remove_paths(files, files.filter("path LIKE '%.jpg'")).select("path")


@_query("verify_status", "SELECT path, CASE WHEN path LIKE '%.txt' THEN 'missing' WHEN path LIKE '%.tmp' THEN 'size' ELSE 'ok' END AS status FROM files")
def _(files):
    live = files.filter("path NOT LIKE '%.txt'").select("path", F.when(F.col("path").endswith(".tmp"), F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.lit(None).cast("string").alias("error"))
    return records.verified(_plain(files), live).select("path", "status")


@_query("verify_totals", "SELECT count(*) AS checked, count(*) FILTER (NOT path LIKE '%.txt') AS verified, count(*) FILTER (path LIKE '%.txt') AS errors FROM files")
def _(files):
    live = files.filter("path NOT LIKE '%.txt'").select("path", "size", F.lit(None).cast("string").alias("error"))
    return records.verify_totals(records.verified(_plain(files), live))


@_query("manifest_info", "SELECT count(DISTINCT hash) AS hashes, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def _(files):
    return records.info(files)


@_query("manifest_list", "SELECT hash, path FROM files WHERE hash IN (SELECT DISTINCT hash FROM files ORDER BY hash LIMIT 10)")
def _(files):
    return records.listed(_plain(files)).select("hash", "path")


@_query("find_path", "SELECT hash, path FROM files WHERE contains(path, '_000012')")
def _(files):
    return records.find(files, "_000012").select("hash", "path")


@_query("find_hash", "SELECT hash, path FROM files WHERE hash = md5('')", empties=True)
def _(files):
    return records.find(files, hashlib.md5(b"").hexdigest()).select("hash", "path")


@_query("common_root", "SELECT '/corpus' AS root")
def _(files):
    return files.sparkSession.createDataFrame([(records.common_root(files),)], "root string")


@_query("extension_labels", f"SELECT DISTINCT {_EXT_SQL} AS ext FROM files")
def _(files):
    return files.select(labelled_extension(F.col("path")).alias("ext")).distinct()


@_query("info_rows", "SELECT hash, path, strftime(make_timestamp(CAST(mtime AS BIGINT) * 1000000), '%Y_%m') AS year_month, size FROM files")
def _(files):
    return records.info_rows(files)


@_query("nested_manifest", "SELECT hash, size, mtime, path FROM files")
def _(files):
    return records.flattened(records.nested(_plain(files)))
