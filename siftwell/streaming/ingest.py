"""Keeping a manifest up to date from a stream of found files, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.hashing import hash_files
from ..operators.selection import unread
from ..plans.actions import settled
from ..schemas import FILES
from ..sources import manifest as store


def ingest_batch(found: DataFrame, manifest_path: str, hash_algo: str = "md5") -> int:
    """Hash what the manifest hasn't read yet, and append it; how many files were added. What is there isn't written again.

    ``found`` has path, size, mtime, and hash if contents are hashed already. A batch that comes twice adds nothing.
    """
    spark = found.sparkSession
    known = store.load(spark, manifest_path) if store.exists(spark, manifest_path) else store.empty(spark, hash_algo)
    new = unread(found.dropDuplicates(["path"]), known.read)
    rows = settled((new if "hash" in new.columns else hash_files(new, hash_algo).filter("error IS NULL")).select(*FILES.names))
    added = rows.count()
    if added:
        store.append(store.Manifest(rows, rows.select("path"), hash_algo), manifest_path)
    return added


def ingest_stream(found: DataFrame, manifest_path: str, checkpoint: str, hash_algo: str = "md5", available_now: bool = True):
    """Start a query that keeps the manifest at ``manifest_path`` up to date with the stream ``found``.

    Its progress is in ``checkpoint``; a restart goes on where it was. Back-pressure is the source's option, such as
    ``maxFilesPerTrigger``.
    """
    writer = found.writeStream.foreachBatch(lambda df, _: ingest_batch(df, manifest_path, hash_algo) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_seen(files: DataFrame) -> DataFrame:
    """Of a stream with event times (column ``found_at``), the first row of each hash within the watermark."""
    return files.withWatermark("found_at", "1 hour").dropDuplicatesWithinWatermark(["hash"])
