"""Carrying out a plan, row by row, with a result for each row.

The plan is written to a table first: what it reads may change while it runs. A copy goes to a temporary name in the
destination directory, is checked, and then renamed, so a task that runs twice does no harm. A source is removed only
after its own copy has been checked. What is deleted is looked at once more: a file that is no longer what was scanned
stays. A file that is already gone, from a directory that is there, counts as deleted (an earlier attempt of the
task did it); one to be moved only if its own destination is there.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import error_message
from ..functions.hashing import hash_file
from ..schemas import ACTIONS, RESULTS
from ..storage import written


def settled(df: DataFrame) -> DataFrame:
    """The rows, written and read again, so that nothing is computed twice against a changing file system."""
    return written(df, "plan")


def _copied(source: str, dest: str, keep_stat: bool, algorithm: str | None, expected: str | None) -> None:
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    part = os.path.join(os.path.dirname(dest), f".{uuid.uuid4().hex}.part")
    try:
        (shutil.copy2 if keep_stat else shutil.copyfile)(source, part)
        with open(part, "rb") as f:
            os.fsync(f.fileno())
        if os.path.getsize(part) != os.path.getsize(source):
            raise OSError(f"copy of {source} is short")
        if algorithm and expected and hash_file(part, algorithm) != expected:
            raise OSError(f"{source} is no longer what was scanned")
        os.replace(part, dest)
    finally:
        if os.path.exists(part):
            os.remove(part)


def act(action: str, path: str, dest: str | None, size: int, keep_stat: bool = False, algorithm: str | None = None, expected: str | None = None) -> None:
    """Do one row; OSError if it can't be done."""
    if action in ("copy", "move"):
        if action == "move" and not os.path.lexists(path) and os.path.isfile(dest) and os.path.getsize(dest) == size:
            return  # an earlier attempt of this row
        if os.path.exists(dest) and os.path.samefile(path, dest):
            raise OSError("source and destination are one file")
        _copied(path, dest, keep_stat, algorithm, expected)
    if action == "delete":
        if not os.path.lexists(path) and os.path.isdir(os.path.dirname(path)):
            return
        if os.path.getsize(path) != size or algorithm and expected and hash_file(path, algorithm) != expected:
            raise OSError(f"{path} is no longer what was scanned")
    if action in ("move", "delete"):
        os.remove(path)


#: Bytes that a task copies, or looks at before it deletes them.
TASK_BYTES = 1 << 30


def execute(plan: DataFrame, dry_run: bool = False, keep_stat: bool = False, check_with: str | None = None, partitions: int | None = None) -> DataFrame:
    """RESULTS of all rows of ``plan`` (ACTIONS), settled. With ``dry_run`` nothing is touched and ``ok`` is null.

    Without ``partitions`` there are as many tasks as the cluster runs at once, or as the plan's bytes call for.
    """
    plan = settled(plan.select(*ACTIONS.names))
    if dry_run:
        return plan.withColumns({"ok": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")})
    if not partitions:
        total = plan.filter("action IN ('copy', 'move', 'delete')").agg(F.sum("size")).first()[0] or 0
        partitions = max(plan.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK_BYTES))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, errors = [], []
            for r in b.itertuples(index=False):
                try:
                    if r.action in ("copy", "move", "delete"):
                        act(r.action, r.path, r.dest, r.size, keep_stat, check_with, r.hash)
                    ok.append(r.action != "error")
                    errors.append(r.reason if r.action == "error" else None)
                except OSError as e:
                    ok.append(False)
                    errors.append(error_message(r.path, e))
            yield b.assign(ok=ok, error=errors)

    return settled(plan.repartition(partitions, "path").mapInPandas(f, RESULTS))


def counters(results: DataFrame) -> dict[str, int]:
    """Totals of a run: how many rows of each action were done, and how many failed."""
    done = F.coalesce("ok", F.lit(True))
    rows = results.groupBy("action").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("failed")).collect()
    return {f"{r.action}_{k}": r[k] for r in rows for k in ("done", "failed") if r[k]}
