"""Shell globs over whole paths, as regular expressions that the JVM runs."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[]")


def glob_regex(pattern: str) -> str:
    """A regular expression for the whole path; ``*`` crosses ``/``, and case counts."""
    return r"\A" + fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def any_glob(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the path matches one of the patterns, by one compiled alternation."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def first_glob(path: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in their order, that the path matches; null if none does."""
    return F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def upper_paths(path: Column, roots: Sequence[str] = ()) -> Column:
    """The path and the directories above it, down from the read root that holds it (or from the top)."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    every = F.filter(every, lambda p: p != "")
    inside = [r.rstrip("/") for r in roots]
    if not inside:
        return every
    held = F.greatest(*[F.when((path == r) | path.startswith(f"{r}/"), F.lit(len(r))).otherwise(0) for r in inside], F.lit(0))
    return F.filter(every, lambda p: F.char_length(p) >= held)


def ignored(path: Column, patterns: Sequence[str], roots: Sequence[str] = ()) -> Column:
    """Whether a pattern matches the path or a directory on the way to it: what lies below an ignored one is ignored."""
    if not patterns:
        return F.lit(False)
    return F.exists(upper_paths(path, roots), lambda p: any_glob(p, patterns))


def ignore_reason(path: Column, patterns: Sequence[str], roots: Sequence[str] = ()) -> Column:
    """The first pattern that matches the highest ignored part of the path; null if it isn't ignored."""
    if not patterns:
        return F.lit(None).cast("string")
    found = F.filter(F.transform(upper_paths(path, roots), lambda p: first_glob(p, patterns)), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))
