"""Command line: ``python -m siftwell``."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from .operators.duplicates import top_extensions
from .plans.engine import run_dedupe
from .session import session

log = logging.getLogger("siftwell")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell", description="Find duplicate files by content; report, copy, move or delete them.")
    p.add_argument("-p", "--read-path", action="append", default=[], help="directory to read; may be repeated")
    p.add_argument("--no-walk", action="store_true", help="work on manifests alone; -p then only names the roots")
    p.add_argument("-r", "--result-path", help="CSV report of duplicates")
    what = p.add_mutually_exclusive_group()
    what.add_argument("-c", "--copy-path", help="copy one file of each content to this directory")
    what.add_argument("--delete", action="store_true", help="delete duplicates")
    what.add_argument("--verify", action="store_true", help="check that the manifest's files are there with their sizes")
    p.add_argument("--delete-on-copy", action="store_true", help="remove sources after their copy was checked")
    p.add_argument("--copy-metadata", action="store_true", help="keep times and modes")
    p.add_argument("--min-delete-size", type=int, default=0, help="smallest size in bytes to delete")
    p.add_argument("--compare", action="append", default=[], help="manifest of what is already there; may be repeated")
    p.add_argument("-m", "--manifest-dump-path", help="manifest to write")
    p.add_argument("-i", "--manifest-read-path", action="append", default=[], help="manifest to read; may be repeated")
    p.add_argument("-e", "--extensions", action="append", default=[], help="extension or pattern to include")
    p.add_argument("--ignore", action="append", default=[], help="glob of paths to ignore")
    p.add_argument("-R", "--path-rules", action="append", default=[], help="extension:rule for destination paths")
    p.add_argument("--ignore-old-collisions", action="store_true")
    p.add_argument("--dedupe-empty", action="store_true", help="count empty files as duplicates")
    p.add_argument("--dry-run", action="store_true", help="show what would be done")
    p.add_argument("--walk-threads", type=int, default=4, help="threads of the driver that look for directories")
    p.add_argument("--read-threads", type=int, default=8, help="files that all tasks of an executor core read at once, one at least")
    p.add_argument("--copy-threads", type=int, help="tasks that copy or delete; by default by the cluster and the bytes")
    p.add_argument("--time-zone", help="of mtime rules; by default this machine's")
    p.add_argument("--suffix-conflicts", action="store_true", help="files that go to one destination get their hash in the name")
    p.add_argument("--hash-algo", choices=("md5", "xxh64"), default="md5")
    p.add_argument("--convert-manifest-paths-from", default="")
    p.add_argument("--convert-manifest-paths-to", default="")
    loud = p.add_mutually_exclusive_group()
    for flags in (("-q", "--quiet"), ("-v", "--verbose"), ("--debug",)):
        loud.add_argument(*flags, action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--ui", action=argparse.BooleanOptionalAction, default=sys.stdout.isatty(), help="show the progress of running stages")
    return p


class _Colored(logging.Formatter):
    """The level in color."""

    def format(self, record: logging.LogRecord) -> str:
        color = {logging.ERROR: 31, logging.WARNING: 33}.get(record.levelno, 32)
        return f"\x1b[{color}m{record.levelname}\x1b[0m {record.getMessage()}"


def _logging(a: argparse.Namespace) -> None:
    handler = logging.StreamHandler()
    colored = not a.no_color and sys.stderr.isatty()
    handler.setFormatter(_Colored() if colored else logging.Formatter("%(levelname)s %(message)s"))
    logging.basicConfig(handlers=[handler])
    log.setLevel(logging.DEBUG if a.debug or a.verbose else logging.WARNING if a.quiet else logging.INFO)


def _checked(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    if not a.read_path and not a.no_walk and not a.verify:
        p.error("one of -p/--read-path and --no-walk is needed")
    if a.delete_on_copy and not a.copy_path:
        p.error("--delete-on-copy needs -c/--copy-path")
    if (a.delete or a.delete_on_copy) and not a.manifest_dump_path:
        p.error("deleting needs -m/--manifest-dump-path, where what is left is recorded")


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """0 if all went well, 1 if a file could not be worked on or verified, 2 for wrong options."""
    p = parser()
    a = p.parse_args(argv)
    _checked(p, a)
    _logging(a)
    spark = spark or session(**{"spark_ui_showConsoleProgress": str(a.ui and not a.quiet).lower()})
    zone = a.time_zone or spark.sparkContext._jvm.java.util.TimeZone.getDefault().getID()
    try:
        out = run_dedupe(
            a.read_path or None,
            a.extensions or None,
            a.manifest_read_path or None,
            a.manifest_dump_path,
            path_rules=a.path_rules,
            copy_to_path=a.copy_path,
            ignore_old_collisions=a.ignore_old_collisions,
            ignored_patterns=a.ignore,
            csv_report_path=a.result_path,
            hash_algo=a.hash_algo,
            convert_manifest_paths_from=a.convert_manifest_paths_from,
            convert_manifest_paths_to=a.convert_manifest_paths_to,
            no_walk=a.no_walk,
            dedupe_empty=a.dedupe_empty,
            compare_manifests=a.compare or None,
            preserve_stat=a.copy_metadata,
            delete_duplicates=a.delete,
            delete_on_copy=a.delete_on_copy,
            dry_run=a.dry_run,
            min_delete_size=a.min_delete_size,
            verify_manifest=a.verify,
            walk_threads=a.walk_threads,
            read_threads=max(1, a.read_threads // max(1, spark.sparkContext.defaultParallelism)),
            copy_threads=a.copy_threads,
            suffix_conflicts=a.suffix_conflicts,
            time_zone=zone,
            spark=spark,
        )
    except ValueError as e:
        p.error(str(e))
    if out.verified is not None:
        log.info("checked %(checked)d, verified %(verified)d, errors %(errors)d", out.counts)
        return 0 if out.verified else 1
    for by, unit in (("bytes", "bytes"), ("n", "files")):
        log.info("Top extensions by %s:", unit)
        for r in top_extensions(out.files, by).collect():  # ten rows
            log.info("  %s: %d %s", r.ext, r[by], unit)
    if a.dry_run and out.results is not None:
        for r in out.results.filter("action != 'skip'").toLocalIterator():
            log.info("would %s %s%s", r.action, r.path, f" -> {r.dest}" if r.dest else "")
    for k, n in sorted(out.counts.items()):
        log.info("%s: %d", k, n)
    return 1 if any(k.endswith("_failed") for k in out.counts) else 0
