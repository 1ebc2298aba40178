import os
import pickle
import sqlite3

import pytest
from pyspark.sql import functions as F

from siftwell.schemas import FILES
from siftwell.sources import legacy
from siftwell.sources import manifest as store
from siftwell.sources.walk import walk


def found(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.filter("error IS NULL").collect())


def test_walk_returns_empty_and_hidden_files_but_no_links(spark, tmp_path):
    for name in ("a", ".x", "_x", "d/b.jpg", "d/e/f/g/h/c.JPG", "skip/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "a" else "1")
    os.symlink(tmp_path, tmp_path / "d/loop")
    os.symlink(tmp_path / "a", tmp_path / "link")
    root = str(tmp_path)
    assert found(walk(spark, [root]), root) == [".x", "_x", "a", "d/b.jpg", "d/e/f/g/h/c.JPG", "skip/z"]
    assert found(walk(spark, [root], ["jpg"], ["*/skip", "*/e"]), root) == ["d/b.jpg"]
    assert found(walk(spark, [root, f"{root}/d"]), root) == found(walk(spark, [root]), root)


def test_walk_gives_errors_as_rows(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_text("1")
    with open(os.fsencode(tmp_path) + b"/d/\xff", "w"):
        pass
    rows = walk(spark, [str(tmp_path / "d"), str(tmp_path / "none")]).collect()
    assert sum(r.error is not None for r in rows) == 2 and sum(r.error is None for r in rows) == 1
    assert walk(spark, [str(tmp_path / "d/f")]).first().error.startswith("NotADirectory")


def files(spark, rows):
    return spark.createDataFrame([(h, 1, m, p) for h, m, p in rows], FILES)


def test_manifests_are_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    first = files(spark, [("h", 1.0, "/a")])
    store.save(store.Manifest(first, store.read_paths(first), "md5"), path)
    held = store.load(spark, path)
    more = held.files.unionByName(files(spark, [("h2", 1.0, "/b")]))
    store.save(store.Manifest(more, store.read_paths(more), "md5"), path)
    assert held.files.count() == 1 and store.load(spark, path).files.count() == 2
    store.save(store.load(spark, path), path)
    assert len([p for p in os.listdir(path) if p.startswith("v-")]) == 2


def test_appended_manifests(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/m"
    one = lambda i: store.Manifest(files(spark, [(f"h{i}", 1.0, f"/{i}")]), spark.createDataFrame([(f"/{i}",)], "path string"), "md5")
    assert not store.exists(spark, path)
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    for i in range(5):
        held = store.load(spark, path) if i else None
        store.append(one(i), path)
        assert sorted(r.path for r in store.load(spark, path).files.collect()) == [f"/{k}" for k in range(i + 1)]
        assert not held or held.files.count() == i
    assert store.load(spark, path).read.count() == 5
    assert len(store._pointer(spark, path)["parts"]) == 2
    with pytest.raises(ValueError):
        store.append(store.Manifest(one(9).files, one(9).read, "xxh64"), path)


def test_walks_are_dealt_to_a_bounded_number_of_tasks(spark, tmp_path):
    from siftwell.sources import walk as source

    for i in range(30):
        for j in range(10):
            (tmp_path / f"{i}/{j}").mkdir(parents=True)
            (tmp_path / f"{i}/{j}/f").write_text("1")
    parts = source._Reader([str(tmp_path)], None, 0.0, 8, 2).partitions()
    assert len(parts) <= 8 + 2
    deep = [p for t in parts if t.deep for p in t.paths]
    assert len(deep) >= 32 and max(len(t.paths) for t in parts) < 60
    rows = source.walk_rows(spark, [str(tmp_path)], ["txt"], ["*/1/*"]).collect()
    kinds = [r.kind for r in rows]
    assert (kinds.count("directory"), kinds.count("ignored"), kinds.count("excluded")) == (1 + 30 + 290, 10 + 29, 300 - 39)
    assert source.walk(spark, [str(tmp_path)]).count() == 300


def test_union_of_manifests(spark, tmp_path):
    for i, rows in enumerate(([("h", 1.0, "/a")], [("h", 1.0, "/a"), ("h", 2.0, "/a")])):
        f = files(spark, rows)
        store.save(store.Manifest(f, store.read_paths(f), "md5"), str(tmp_path / str(i)))
    both = store.load_all(spark, [str(tmp_path / "0"), str(tmp_path / "1")])
    assert both.files.count() == 2 and both.read.count() == 1
    f = files(spark, [("h", 1.0, "/a")])
    store.save(store.Manifest(f, store.read_paths(f), "xxh64"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        store.load_all(spark, [str(tmp_path / "0"), str(tmp_path / "x")])


def test_sqlite_manifests(spark, tmp_path):
    path = str(tmp_path / "m.db")
    for name, rows in ((path, [("c" * 32, b"P" + pickle.dumps([("/a", 3, 1.5), ["/b", 3, 2.5]])), ("d" * 32, pickle.dumps([("/c", 1, 1.0)]))]), (f"{path}.read", [("/a", b"N")])):
        with sqlite3.connect(name) as db:
            db.execute("CREATE TABLE t (key BLOB PRIMARY KEY, hash INTEGER, value BLOB)")
            db.executemany("INSERT INTO t VALUES (?, 0, ?)", rows)
    assert store.load(spark, path).files.count() == 3
    (tmp_path / "text").write_text("no manifest")
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "text"))
    got = legacy.load_sqlite(spark, path)
    assert got.hash_algo == "md5" and got.files.count() == 3 and [r.path for r in got.read.collect()] == ["/a"]
    with pytest.raises(pickle.UnpicklingError):
        legacy.plain(pickle.dumps(os.system))
    assert legacy.value_of(b"Sx") == "x" and legacy.value_of(b"I5") == 5 and legacy.value_of(b"N") is None


def test_filters_reach_the_scan(spark):
    from siftwell.plans.catalogue import documents_as_files

    plan = documents_as_files(spark, "/root/testdata/sf0.001").filter(F.col("doc_id") > 5).select("path")._jdf.queryExecution().toString()
    assert "GreaterThan(doc_id,5)" in plan and "text" not in plan.split("ReadSchema")[-1]
