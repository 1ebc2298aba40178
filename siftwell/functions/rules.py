"""Rules that rebuild the destination path of a file by its extension."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extensions import clean_extensions, labelled_extension
from .paths import base_name, below, year_month

#: What a rule may ask for; ``no_change`` keeps the path below the read root.
PATH_RULES = ("mtime", "no_change", "extension")


def parse_rules(rules: Sequence[str]) -> list[tuple[str, list[str]]]:
    """``["jpg:mtime", "*.p*:extension"]`` as (pattern, rules in order); ValueError if one is malformed or unknown."""
    out: dict[str, list[str]] = {}
    for given in rules:
        fields = given.split(":")
        if len(fields) != 2:
            raise ValueError(f"a path rule is 'extension:rule', not {given!r}")
        pattern, rule = fields[0].strip().lower(), fields[1].strip()
        if rule not in PATH_RULES:
            raise ValueError(f"unknown path rule {rule!r}; one of {', '.join(PATH_RULES)}")
        if not pattern.startswith("*"):
            pattern = clean_extensions([pattern])[0]
        out.setdefault(pattern, []).append(rule)
    return list(out.items())


def best_pattern(patterns: Sequence[str], ext: str) -> str | None:
    """The pattern that says most about an extension: itself, else the glob nearest to it in length without wildcards.

    Of globs equally near, the first one given is taken, but the last of all that fit if none is nearer than that.
    """
    wanted = f".{ext}"
    if wanted in patterns:
        return wanted
    fit = [p for p in patterns if fnmatch.fnmatch(wanted, p)]
    distance = lambda p: abs(len(p.replace("?", "").replace("*", "")) - len(wanted))
    return min([*fit[-1:], *fit], key=distance) if fit else None


def destination(target: str, roots: Sequence[str], rules: Sequence[str], path: Column, mtime: Column, files: DataFrame | None = None) -> Column:
    """Where a file goes under ``target``.

    Without rules it keeps its path below the read root. With rules, those of its extension's best pattern append
    ``/YYYY_MM``, ``/extension`` or the directories below the root, in order, and then its name. Which pattern is
    best is settled here for each extension of ``files``, a column of few values; the plan is a chain of WHENs.
    """
    target = target.rstrip("/")
    inner = below(path, roots)
    if not rules:
        return F.concat(F.lit(f"{target}/"), inner)
    parsed = dict(parse_rules(rules))
    ext = labelled_extension(path)
    inner_dir = F.regexp_extract(inner, r"(?s)\A(.*)/[^/]*\z", 1)
    steps = {
        "mtime": F.concat(F.lit("/"), year_month(mtime)),
        "extension": F.concat(F.lit("/"), ext),
        "no_change": F.when(inner_dir == "", F.lit("")).otherwise(F.concat(F.lit("/"), inner_dir)),
    }
    whole = lambda names: F.concat(F.lit(target), *[steps[n] for n in names], F.lit("/"), base_name(path))
    if files is None:
        raise ValueError("rules need the files, whose extensions they are matched with")
    extensions = [r[0] for r in files.select(labelled_extension(path)).distinct().limit(MOST_EXTENSIONS + 1).collect()]
    if len(extensions) > MOST_EXTENSIONS:
        return _by_length(parsed, ext, whole)
    by: dict[str, list[str]] = {}
    for e in extensions:
        p = best_pattern(list(parsed), e)
        if p is not None:
            by.setdefault(p, []).append(e)
    return reduce(lambda out, kv: F.when(ext.isin(kv[1]), whole(parsed[kv[0]])).otherwise(out), by.items(), whole(["no_change"]))


#: Extensions that are matched on the driver; with more, patterns are compared row by row, to the same effect.
MOST_EXTENSIONS = 2000


def _by_length(parsed: dict[str, list[str]], ext: Column, whole) -> Column:
    from .globs import glob_regex

    wanted = F.concat(F.lit("."), ext)
    length = F.length(wanted)
    fits = []
    for i, (p, names) in enumerate(parsed.items()):
        far = F.when(wanted == p, F.lit(-1)).otherwise(F.abs(F.lit(len(p.replace("?", "").replace("*", ""))) - length))
        fits.append(F.when((wanted == p) | wanted.rlike(glob_regex(p)), F.struct(far.alias("far"), F.lit(i).alias("order"), whole(names).alias("dest"))))
    fit = F.filter(F.array(*fits), lambda x: x.isNotNull())
    best, last = F.array_min(fit), F.element_at(fit, -1)
    return F.when(F.size(fit) == 0, whole(["no_change"])).when(last["far"] == best["far"], last["dest"]).otherwise(best["dest"])
