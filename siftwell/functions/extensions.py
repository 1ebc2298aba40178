"""File-name extensions: taking them from paths, normalising patterns, matching."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import glob_regex, is_glob

NO_EXTENSION = "no_extension"
# The last component's text after its last dot, if something other than dots stands before that dot.
_EXTENSION = r"(?s)\A(?:.*/)?\.*[^/.][^/]*\.([^./]*)\z"


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for dot-files, names of no dot and names that end in one."""
    return F.lower(F.regexp_extract(path, _EXTENSION, 1))


def labelled_extension(path: Column) -> Column:
    """As ``extension``, with a name for those that have none."""
    found = extension(path)
    return F.when(found == "", F.lit(NO_EXTENSION)).otherwise(found)


def clean_extensions(patterns: Iterable[str] | None) -> list[str]:
    """Patterns as users give them, made uniform: ``JPG`` is ``.jpg``, ``jp?`` is ``*.jp?``; ``*...`` and ``.`` stay."""
    out = []
    for pattern in patterns or ():
        p = pattern.strip().lower()
        if not p.startswith("*") and p != ".":
            p = p if p.startswith(".") else f".{p}"
            p = f"*{p}" if is_glob(p) else p
        out.append(p)
    return out


def has_extension(path: Column, patterns: Iterable[str] | None) -> Column:
    """Whether the lower-cased path ends in a pattern or matches it as a glob; no patterns match every path."""
    cleaned = clean_extensions(patterns)
    if not cleaned:
        return F.lit(True)
    low = F.lower(path)
    each = [low.rlike(glob_regex(p)) if is_glob(p) else low.endswith(p) for p in cleaned]
    return reduce(lambda a, b: a | b, each)
