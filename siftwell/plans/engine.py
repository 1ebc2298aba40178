"""The whole run: scan or load, report, copy, move or delete, and save what is known afterwards."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extensions import clean_extensions
from ..functions.hashing import check_algorithm, hash_files
from ..functions.rules import parse_rules
from ..operators import duplicates, records, selection
from ..schemas import FILES
from ..session import session
from ..sources import manifest as store
from ..sources.walk import walk_rows
from .actions import counters, execute, settled
from .report import write_report

log = logging.getLogger("siftwell")


@dataclass
class Outcome:
    """What a run found and did."""

    files: DataFrame
    collisions: DataFrame | None = None
    errors: DataFrame | None = None
    results: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)
    verified: bool | None = None


def _listed(value: str | Sequence[str] | None) -> list[str]:
    return [value] if isinstance(value, str) else list(value or ())


def scan(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), read: DataFrame | None = None, hash_algo: str = "md5", walk_threads: int = 4, read_threads: int = 1, counts: dict[str, int] | None = None) -> DataFrame:
    """Walk, drop what was read before, and hash: rows of FILES with ``error``, settled.

    ``counts`` gets how many directories were entered, and how many files were accepted and ignored (or excluded).
    """
    found = settled(walk_rows(spark, roots, extensions, ignore, walk_threads))
    failed = found.filter("kind = 'error'").select(F.lit(None).cast("string").alias("hash"), "size", "mtime", "path", "error")
    good = found.filter("kind = 'file'").select("path", "size", "mtime")
    if counts is not None:
        kinds = {r.kind: r.n for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # five kinds
        counts |= {"directories": kinds.get("directory", 0), "accepted": kinds.get("file", 0), "ignored": kinds.get("ignored", 0) + kinds.get("excluded", 0)}
    if read is not None:
        good = selection.unread(good, read)
    partitions = spark.sparkContext.defaultParallelism * 4
    return settled(hash_files(good.repartition(partitions), hash_algo, read_threads).unionByName(failed))


def _check(roots, inputs, output, compare, copy_to, delete, no_walk, rules) -> None:
    if output and any(store.same_place(output, i) for i in [*inputs, *compare]):
        raise ValueError("the output manifest must be another than those that are read or compared with")
    if no_walk and not inputs:
        raise ValueError("without a walk an input manifest is needed")
    if not roots and not no_walk:
        raise ValueError("nothing to read: give a path or --no-walk")
    if copy_to and delete:
        raise ValueError("copying and deleting duplicates can't be done in one run")
    parse_rules(rules)


def run_dedupe(
    read_from_path: str | Sequence[str] | None = None,
    extensions: Sequence[str] | None = None,
    manifests_in_paths: str | Sequence[str] | None = None,
    manifest_out_path: str | None = None,
    *,
    path_rules: Sequence[str] | None = None,
    copy_to_path: str | None = None,
    ignore_old_collisions: bool = False,
    ignored_patterns: Sequence[str] | None = None,
    csv_report_path: str | None = None,
    hash_algo: str = "md5",
    convert_manifest_paths_to: str = "",
    convert_manifest_paths_from: str = "",
    no_walk: bool = False,
    no_copy: Sequence[str] | None = None,
    dedupe_empty: bool = False,
    compare_manifests: str | Sequence[str] | None = None,
    preserve_stat: bool = False,
    delete_duplicates: bool = False,
    delete_on_copy: bool = False,
    dry_run: bool = False,
    min_delete_size: int = 0,
    verify_manifest: bool = False,
    walk_threads: int = 4,
    read_threads: int = 1,
    copy_threads: int | None = None,
    suffix_conflicts: bool = False,
    time_zone: str | None = None,
    spark: SparkSession | None = None,
) -> Outcome:
    """One run with the options of the command line.

    ``walk_threads`` look for directories on the driver, ``read_threads`` read files in each task, ``copy_threads`` is
    how many tasks copy or delete (by default as the cluster and the plan's bytes call for). ``time_zone`` is that of
    ``mtime`` rules, by default the session's. Nothing on disk changes on a dry run, the output manifest included.
    """
    spark = spark or session()
    began = time.monotonic()
    if time_zone:
        spark.conf.set("spark.sql.session.timeZone", time_zone)
    roots = [os.path.abspath(r) for r in _listed(read_from_path)]
    inputs, compare_paths = _listed(manifests_in_paths), _listed(compare_manifests)
    rules, ignore = list(path_rules or ()), list(ignored_patterns or ())
    extensions = clean_extensions(extensions)
    check_algorithm(hash_algo)
    _check(roots, inputs, manifest_out_path, compare_paths, copy_to_path, delete_duplicates, no_walk or verify_manifest, rules)
    known = store.load_all(spark, inputs) if inputs else store.empty(spark, hash_algo)
    if inputs and known.hash_algo != hash_algo:
        if not no_walk and not verify_manifest:
            raise ValueError(f"the manifest was made with {known.hash_algo}, not {hash_algo}")
        hash_algo = known.hash_algo
    compare = store.load_all(spark, compare_paths) if compare_paths else None
    if compare and compare.hash_algo != hash_algo:
        raise ValueError(f"the compared manifest was made with {compare.hash_algo}, not {hash_algo}")
    blocked = compare.files if compare else None
    if no_copy:
        extra = spark.createDataFrame([(h, None, None, None) for h in no_copy], FILES)
        blocked = extra if blocked is None else blocked.unionByName(extra)
    old = known.files
    if convert_manifest_paths_from or convert_manifest_paths_to:
        old = records.convert_paths(old, convert_manifest_paths_from, convert_manifest_paths_to)
    if verify_manifest:
        return _verify(spark, old)

    errors, met = None, {}
    if no_walk:
        files, read = settled(old), known.read
        collided = duplicates.known_collisions(files)
    else:
        log.debug("walking and reading %s", roots)
        rows = scan(spark, roots, extensions, ignore, known.read, hash_algo, walk_threads, read_threads, met)
        errors = rows.filter(F.col("error").isNotNull()).select("path", "error")
        new = rows.filter(F.col("error").isNull()).select(*FILES.names)
        files = settled(new.unionByName(old.select(*FILES.names)))
        read = known.read.unionByName(new.select("path")).distinct()
        collided = duplicates.collisions(new, old, dedupe_empty, ignore_old_collisions)
    outcome = Outcome(files, collided, errors, counts=met | _scan_counts(files, errors))
    if met:
        took = max(time.monotonic() - began, 1e-3)
        log.info("read in %.1f s: %.1f files a second", took, met["accepted"] / took)
    if csv_report_path:
        write_report(collided, csv_report_path, roots, hash_algo)

    if copy_to_path:
        under = roots or [r for r in [records.common_root(files)] if r]
        plan = selection.transfer_plan(files, os.path.abspath(copy_to_path), under, rules, blocked, extensions, ignore, dedupe_empty, delete_on_copy)
        outcome.results = execute(selection.with_conflicts(plan, suffix_conflicts), dry_run, preserve_stat, hash_algo, copy_threads)
    elif delete_duplicates:
        plan = selection.delete_plan(files, blocked, min_delete_size, dedupe_empty, extensions, ignore, roots)
        outcome.results = execute(plan, dry_run, check_with=hash_algo, partitions=copy_threads)
    if outcome.results is not None:
        outcome.counts |= counters(outcome.results)
        if not dry_run:
            done = outcome.results.filter("ok")
            moved = done.filter("action = 'move'").select("path", "dest")
            gone = done.filter("action = 'delete'").select("path")
            outcome.files = records.remove_paths(records.move_paths(files, moved), gone)
            to = moved.groupBy("path").agg(F.min("dest").alias("_dest"))
            read = read.join(to, "path", "left").select(F.coalesce("_dest", "path").alias("path")).join(gone, "path", "left_anti")
    if manifest_out_path and not dry_run:
        store.save(store.Manifest(outcome.files, read, hash_algo), manifest_out_path)
    return outcome


def _scan_counts(files: DataFrame, errors: DataFrame | None) -> dict[str, int]:
    """Rows known and files that could not be read, from tables that are settled."""
    bad = errors.count() if errors is not None else 0
    return {"files": files.count()} | ({"unread": bad} if bad else {})


def _verify(spark: SparkSession, files: DataFrame) -> Outcome:
    """Whether each file of the manifest is there with its size; contents are not read."""
    live = _stat(files.select("path").distinct())
    checked = settled(records.verified(files, live))
    totals = records.verify_totals(checked).first()
    bad = checked.filter("status != 'ok'").select("path", F.col("status").alias("error"))
    return Outcome(files, errors=bad, counts=totals.asDict(), verified=totals["errors"] == 0)


def _stat(paths: DataFrame) -> DataFrame:
    import pandas as pd

    def f(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    rows.append((p, os.stat(p).st_size, None))
                except FileNotFoundError:
                    continue
                except OSError as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "size", "error"]).astype({"size": "Int64"})

    return paths.mapInPandas(f, "path string, size long, error string")


