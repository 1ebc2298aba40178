"""Path algebra and dates of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
# Seconds of 0001-01-02 and 9999-12-31, between which a year has four digits in any time zone.
_FIRST, _LAST = -62135510400, 253402214400


def year_month(mtime: Column) -> Column:
    """``YYYY_MM`` of seconds since 1970 in the session's time zone; ``Unknown`` for a null or a year out of range."""
    known = (mtime >= _FIRST) & (mtime < _LAST)
    stamp = F.timestamp_seconds(F.when(known, mtime))
    year = F.year(stamp).cast("string")
    return F.when(known, F.concat(year, F.lit("_"), F.lpad(F.month(stamp).cast("string"), 2, "0"))).otherwise(UNKNOWN)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def below(path: Column, roots: Sequence[str]) -> Column:
    """The path as seen from the longest root that holds it, by whole components; its base name if none does."""
    out = base_name(path)
    for root in sorted({r.rstrip("/") for r in roots}, key=len):
        out = F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(out)
    return out


def moved_prefix(path: Column, old: str, new: str, anywhere: bool = False) -> Column:
    """The path with ``old`` at its start, by whole components (or, ``anywhere``, where it first occurs), replaced by ``new``."""
    if not old:
        return F.concat(F.lit(new), path)
    if anywhere:
        at = F.instr(path, old)
        return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(new), path.substr(at + len(old), F.length(path)))).otherwise(path)
    whole = path.startswith(old) if old.endswith("/") else (path == old) | path.startswith(f"{old}/")
    return F.when(whole, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)
