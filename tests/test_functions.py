import fnmatch
import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell import clean_extensions
from siftwell.functions import errors, extensions, globs, hashing, paths, rules

ALPHABET = list("ab.XY/_*? \n-é")


def column(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def names(n, seed, most=12):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_extension_is_that_of_splitext(spark):
    values = [*names(3000, 1), "a.JPG", ".bashrc", "x.", "/a.b/c", "/a/.x.y", "tar.tar.gz", "..", "...a"]
    assert column(spark, values, extensions.extension) == [os.path.splitext(v)[1].removeprefix(".").lower() for v in values]


def test_globs_match_as_fnmatch(spark):
    r = random.Random(2)
    patterns = ["".join(r.choice([*ALPHABET, "[ab]", "[!a]", "*"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    values = names(120, 3)
    for p in patterns:
        assert column(spark, values, lambda c, p=p: c.rlike(globs.glob_regex(p))) == [fnmatch.fnmatchcase(v, p) for v in values], p


def test_clean_extensions():
    assert clean_extensions([".jpg", "png", " .gif ", "mov", "."]) == [".jpg", ".png", ".gif", ".mov", "."]
    assert clean_extensions(["JP*G", "*.x", ".a?"]) == ["*.jp*g", "*.x", "*.a?"]
    assert clean_extensions(None) == []


def test_extension_filter(spark):
    values = ["/a/x.JPG", "/a/x.jpeg", "/a/jpg", "/a/b.txt"]
    assert column(spark, values, lambda c: extensions.has_extension(c, ["jpg"])) == [True, False, False, False]
    assert column(spark, values, lambda c: extensions.has_extension(c, ["jp*g"])) == [True, True, False, False]
    assert column(spark, values, lambda c: extensions.has_extension(c, [])) == [True] * 4


def test_ignored_directories_hide_what_is_below(spark):
    values = ["/r/keep/a", "/r/skip/a/b", "/r/x.tmp", "/r/sub/skip", "/r/skipped"]
    assert column(spark, values, lambda c: globs.ignored(c, ["*/skip", "*.tmp"], ["/r"])) == [False, True, True, True, False]
    assert column(spark, ["/skip/r/a"], lambda c: globs.ignored(c, ["/skip"], ["/skip/r"])) == [False]
    assert column(spark, values[1:3], lambda c: globs.ignore_reason(c, ["*.tmp", "*/skip"], ["/r"])) == ["*/skip", "*.tmp"]


def test_year_month(spark):
    df = spark.createDataFrame([(0.0,), (1704067199.9,), (9e14,), (-9e14,), (None,), (float("nan"),)], "t double")
    assert [r[0] for r in df.select(paths.year_month(F.col("t"))).collect()] == ["1970_01", "2023_12", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_hashes(spark, tmp_path):
    text = "This is a test file for hashing."
    assert column(spark, [text], hashing.hash_column) == ["c0bebe9ec49ac60275d09d2187fc2235"]
    assert column(spark, [text, None], lambda c: hashing.hash_column(c, "xxh64")) == ["8471ab391af8733a", None]
    f = tmp_path / "f"
    f.write_text(text)
    assert hashing.hash_file(str(f)) == "c0bebe9ec49ac60275d09d2187fc2235"
    assert hashing.hash_file(str(f), "xxh64") == "8471ab391af8733a"
    with pytest.raises(ValueError):
        hashing.hash_file(str(f), "sha1")


def test_prefixes(spark):
    assert column(spark, ["/a/b/c", "/x/a/b"], lambda c: paths.moved_prefix(c, "/a/b", "/fred")) == ["/fred/c", "/x/a/b"]
    assert column(spark, ["/x/a/b/a/b"], lambda c: paths.moved_prefix(c, "/a/b", "/f", anywhere=True)) == ["/x/f/a/b"]
    assert column(spark, ["a"], lambda c: paths.moved_prefix(c, "", "/x/")) == ["/x/a"]
    assert column(spark, ["/a/bc/x", "/a/b/x", "/a/b/d/x"], lambda c: paths.below(c, ["/a/b", "/a/b/d"])) == ["x", "x", "x"]
    assert column(spark, ["/a/b/d/x"], lambda c: paths.below(c, ["/a/b"])) == ["d/x"]


def test_rules():
    assert rules.parse_rules(["jpg:mtime", "*.p*:extension", "jpg:extension"]) == [(".jpg", ["mtime", "extension"]), ("*.p*", ["extension"])]
    for bad in ("jpg", "a:b:c", "jpg:nothing"):
        with pytest.raises(ValueError):
            rules.parse_rules([bad])
    assert rules.best_pattern(["*.j*", "*.jp*", "*.jpg", "*.jpeg"], "jpg") == "*.jpg"
    assert rules.best_pattern(["*.j*", ".jpg"], "jpg") == ".jpg"
    assert rules.best_pattern(["*.?pg", "*.j?g"], "jpg") == "*.j?g"  # the last, if none is nearer
    assert rules.best_pattern(["*.jp?", "*.j?g", "*.*"], "jpg") == "*.jp?"  # else the first of the nearest
    assert rules.best_pattern(["*.*", "*.jp?", "*.j?g", "*.?pg"], "jpg") == "*.?pg"
    assert rules.best_pattern(["*.gif"], "jpg") is None


def test_destinations(spark, monkeypatch):
    files = spark.createDataFrame([("/r/s/a.jpg", 0.0), ("/r/b.TXT", 86400.0 * 40), ("/r/s/t/c", 0.0), ("/r/d.jpeg", 0.0)], "path string, mtime double")
    given = ["*.jp*:extension", "*.jpg:mtime", "txt:mtime", "txt:no_change"]
    expected = ["/t/1970_01/a.jpg", "/t/1970_02/b.TXT", "/t/s/t/c", "/t/jpeg/d.jpeg"]
    files = files.unionByName(spark.createDataFrame([("/r/e.tmp", 0.0), ("/r/f.zip", 0.0)], files.schema))
    given += ["*.zi?:extension", "*.tm?:extension", "*.t?p:mtime", "*.z?p:mtime", "*.t*:no_change"]
    expected += ["/t/tmp/e.tmp", "/t/1970_01/f.zip"]
    for most in (2000, 0):
        monkeypatch.setattr(rules, "MOST_EXTENSIONS", most)
        to = rules.destination("/t/", ["/r"], given, F.col("path"), F.col("mtime"), files)
        assert [r[0] for r in files.select(to).collect()] == expected


def test_error_messages():
    assert "permissions" in errors.error_message("/a", PermissionError("no"))
    assert "deleted" in errors.error_message("/a", "No such file or directory")
    assert "full" in errors.error_message("/a", OSError(28, "No space left on device"))
    assert "disk health" in errors.error_message("/a", OSError("x"))
    assert "Suggestions" not in errors.error_message("/a", "odd")
