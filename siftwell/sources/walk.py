"""A data source that walks directory trees: ``spark.read.format("fswalk").option("roots", json).load()``.

Unlike ``binaryFile`` it returns empty files and names that begin with ``_`` or ``.``. The driver looks for directories
in the first levels of the roots, without a look at files, until there are a few for each task; those are dealt to a
bounded number of tasks. Ignored directories are not entered; symbolic links are neither followed nor returned. What
can't be listed is a row with an error. All executors must see the same mount.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.extensions import clean_extensions, has_extension
from ..functions.globs import glob_regex

SCHEMA = "path string, size long, mtime double, error string, kind string"
#: Directories for each task that the driver looks for, and how many it lists for that at most.
_EACH, _LISTED = 4, 4096
#: Seconds after which a directory that isn't there is looked for again.
WAIT = 1.0


class _Tree(InputPartition):
    def __init__(self, paths: list[str], deep: bool) -> None:
        self.paths, self.deep = paths, deep


def _directories(directory: str, ignore: re.Pattern | None) -> list[str]:
    """Directories right below one that isn't ignored; none if it can't be listed."""
    if ignore and ignore.search(directory) or os.path.islink(directory):
        return []
    try:
        with os.scandir(directory) as entries:
            return [e.path for e in entries if e.is_dir(follow_symlinks=False) and not (ignore and ignore.search(e.path)) and e.path.isprintable()]
    except OSError:
        return []


def _listed(directory: str, ignore: re.Pattern | None) -> tuple[list[str], list[tuple], str | None]:
    """Directories right below a directory, rows of its files and of what is ignored, and the error if it can't be listed."""
    below, rows = [], []
    try:
        with os.scandir(directory) as entries:
            for e in entries:
                try:
                    path = e.path
                    path.encode()
                    if e.is_symlink():
                        continue
                    if ignore and ignore.search(path):
                        rows.append((path, None, None, None, "ignored"))
                        continue
                    if e.is_dir(follow_symlinks=False):
                        below.append(path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        rows.append((path, s.st_size, s.st_mtime, None, "file"))
                except UnicodeEncodeError:
                    rows.append((os.fsencode(e.path).decode("utf-8", "replace"), None, None, "UnicodeEncodeError: name is not UTF-8", "error"))
                except OSError as x:
                    rows.append((e.path, None, None, f"{type(x).__name__}: {x}", "error"))
    except OSError as x:
        return [], [], f"{type(x).__name__}: {x}"
    return below, rows, None


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], ignore: str | None, wait: float, tasks: int, threads: int) -> None:
        self.roots, self.ignore, self.wait, self.tasks, self.threads = roots, ignore, wait, tasks, threads

    def partitions(self) -> list[InputPartition]:
        ignore = re.compile(self.ignore) if self.ignore else None
        inner = lambda a: any(a != b and a.startswith(b.rstrip("/") + "/") for b in self.roots)
        waiting = [r for r in dict.fromkeys(self.roots) if not inner(r)]
        upper: list[str] = []
        with ThreadPoolExecutor(self.threads) as pool:
            while waiting and len(waiting) < _EACH * self.tasks and len(upper) < _LISTED:
                now, rest = waiting[: 8 * self.threads], waiting[8 * self.threads :]
                found = list(pool.map(lambda d: _directories(d, ignore), now))
                upper += now
                waiting = [*rest, *(d for below in found for d in below)]
        few = max(1, self.tasks // 4)
        dealt = lambda paths, n, deep: [_Tree(paths[i::n], deep) for i in range(min(n, len(paths)))]
        return [*dealt(upper, few, False), *dealt(waiting, self.tasks, True)] or [_Tree([], False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ignore = re.compile(self.ignore) if self.ignore else None
        stack = list(partition.paths)
        while stack:
            d = stack.pop()
            if ignore and ignore.search(d):
                continue
            if os.path.isfile(d):
                yield d, None, None, "NotADirectoryError: a file is given as a root", "error"
                continue
            if not os.path.lexists(d):
                time.sleep(self.wait)  # a share may come back
            below, rows, error = _listed(d, ignore)
            yield from rows
            yield d, None, None, error, "error" if error else "directory"
            if partition.deep:
                stack += below


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fswalk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        number = lambda name, other: int(self.options.get(name, other))
        return _Reader(json.loads(self.options["roots"]), self.options.get("ignore"), float(self.options.get("wait", WAIT)), number("tasks", 16), number("threads", 4))


def walk(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """(path, size, mtime, error) of all files below the roots, of the given extensions, that no pattern ignores."""
    return walk_rows(spark, roots, extensions, ignore).filter("kind IN ('file', 'error')").drop("kind")


def walk_rows(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] | None = None, ignore: Sequence[str] = (), threads: int = 4) -> DataFrame:
    """What a walk meets, by ``kind``: file, excluded (of another extension), ignored, directory, error."""
    spark.dataSource.register(WalkSource)
    reader = spark.read.format("fswalk").option("roots", json.dumps([os.path.abspath(r) for r in roots]))
    reader = reader.option("tasks", max(4, 2 * spark.sparkContext.defaultParallelism)).option("threads", max(1, threads))
    if ignore:
        reader = reader.option("ignore", "|".join(f"(?:{glob_regex(p)})".replace(r"\z", r"\Z") for p in ignore))
    found = reader.load()
    if clean_extensions(extensions):
        from pyspark.sql import functions as F

        found = found.withColumn("kind", F.when((F.col("kind") == "file") & ~has_extension(F.col("path"), extensions), "excluded").otherwise(F.col("kind")))
    return found
