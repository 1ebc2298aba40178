"""The CSV report of duplicates."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.duplicates import numbered

log = logging.getLogger("siftwell")


def report_lines(collided: DataFrame) -> DataFrame:
    """(group, hash, path, line) of the report: fields joined by a comma and a space, the path as Python quotes it."""
    @F.pandas_udf("string")
    def quoted(paths: pd.Series) -> pd.Series:
        return paths.map(repr)

    fields = [F.col("group").cast("string"), F.col("hash"), quoted("path"), F.col("size").cast("string"), F.col("mtime").cast("string")]
    return numbered(collided).select("group", "hash", "path", F.concat_ws(", ", *fields).alias("line"))


def write_report(collided: DataFrame, path: str, roots: Sequence[str] = (), hash_algo: str = "md5") -> bool:
    """Write the report to one local file, group by group; False and a logged error if that can't be done.

    Lines come to the driver in order, one partition at a time.
    """
    try:
        with open(path, "w", encoding="utf-8", newline="") as out:
            if roots:
                out.write(f"Src: {list(roots)}\n")
            out.write(f"Collision #, {hash_algo.upper()}, Path, Size (bytes), mtime\n")
            for r in report_lines(collided).orderBy("group", "path").select("line").toLocalIterator():
                out.write(r.line + "\n")
        return True
    except OSError as e:
        log.error("no report at %s: %s", path, e)
        return False


def write_report_parts(collided: DataFrame, folder: str, parts: int | None = None) -> None:
    """The report's lines as text files in a folder that all share, in order of group over the files' names.

    No line passes through the driver; a group lies in one file.
    """
    lines = report_lines(collided)
    parts = parts or collided.sparkSession.sparkContext.defaultParallelism
    lines.repartitionByRange(parts, "group").sortWithinPartitions("group", "path").select("line").write.text(folder)
