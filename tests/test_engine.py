import os
import stat

import pytest

from siftwell import run_dedupe
from siftwell.plans import actions
from siftwell.sources import manifest as store


def tree(root, files: dict[str, str | bytes]):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(root)


def left(root) -> list[str]:
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


@pytest.fixture
def run(spark):
    return lambda *a, **k: run_dedupe(*a, spark=spark, **k)


def acted(out) -> dict[str, int]:
    return {k: n for k, n in out.counts.items() if k.endswith(("_done", "_failed"))}


FIVE = {"a.txt": "content1", "b.txt": "content1", "c.txt": "sho", "d.txt": "sho", "e.txt": "unique"}


def test_delete_from_manifest(run, tmp_path):
    src = tree(tmp_path / "s", FIVE)
    out = run(src, manifest_out_path=str(tmp_path / "m"))
    assert sorted(os.path.basename(r.path) for r in out.collisions.collect()) == ["a.txt", "b.txt", "c.txt", "d.txt"]
    dry = run(None, manifests_in_paths=str(tmp_path / "m"), manifest_out_path=str(tmp_path / "n"), no_walk=True, delete_duplicates=True, min_delete_size=4, dry_run=True)
    assert [os.path.basename(r.path) for r in dry.results.filter("action = 'delete'").collect()] == ["b.txt"]
    assert len(left(tmp_path / "s")) == 5 and not (tmp_path / "n").exists()
    done = run(None, manifests_in_paths=str(tmp_path / "m"), manifest_out_path=str(tmp_path / "n"), no_walk=True, delete_duplicates=True, min_delete_size=1)
    assert left(tmp_path / "s") == ["a.txt", "c.txt", "e.txt"]
    assert acted(done) == {"delete_done": 2}


def test_report(run, tmp_path):
    src = tree(tmp_path / "s", FIVE)
    report = tmp_path / "r.csv"
    run(src, csv_report_path=str(report))
    lines = report.read_text().splitlines()
    assert lines[0] == f"Src: {[src]}" and lines[1] == "Collision #, MD5, Path, Size (bytes), mtime"
    assert len(lines) == 6 and "e.txt" not in report.read_text()
    assert [x.split(", ")[0] for x in lines[2:]] == ["1", "1", "2", "2"] and repr(f"{src}/a.txt") in report.read_text()


def test_empty_files(run, tmp_path):
    src = tree(tmp_path / "s", {f"e{i}": "" for i in range(10)})
    run(src, manifest_out_path=str(tmp_path / "m"), delete_duplicates=True)
    assert len(left(tmp_path / "s")) == 10
    run(src, copy_to_path=str(tmp_path / "t"))
    assert len(left(tmp_path / "t")) == 10
    run(src, copy_to_path=str(tmp_path / "u"), dedupe_empty=True)
    assert left(tmp_path / "u") == ["e0"]
    run(src, manifest_out_path=str(tmp_path / "n"), delete_duplicates=True, dedupe_empty=True)
    assert left(tmp_path / "s") == ["e0"]


def test_delete_with_compare(run, tmp_path):
    src = tree(tmp_path / "s", {"dup1": "content1", "dup2": "content2", "unique.txt": "u"})
    tree(tmp_path / "c", {"comp1": "content1", "comp2": "content2"})
    run(str(tmp_path / "c"), manifest_out_path=str(tmp_path / "cm"))
    run(src, manifest_out_path=str(tmp_path / "m"), compare_manifests=str(tmp_path / "cm"), delete_duplicates=True)
    assert left(tmp_path / "s") == ["unique.txt"] and len(left(tmp_path / "c")) == 2
    run(str(tmp_path / "c"), manifest_out_path=str(tmp_path / "m2"), compare_manifests=str(tmp_path / "cm"), delete_duplicates=True)
    assert len(left(tmp_path / "c")) == 2  # a compared file never deletes itself


def test_move_with_compare_from_manifest(run, tmp_path, spark):
    tree(tmp_path / "s", {"u1": "1", "d/u2": "2", "i1": "same", "d/i2": "same", "t1": "x", "t2": "y"})
    tree(tmp_path / "t", {"a": "x", "b": "y", "c": "z"})
    run(str(tmp_path / "s"), manifest_out_path=str(tmp_path / "sm"))
    run(str(tmp_path / "t"), manifest_out_path=str(tmp_path / "tm"))
    out = run(None, manifests_in_paths=[str(tmp_path / "sm")], manifest_out_path=str(tmp_path / "m"), no_walk=True, compare_manifests=[str(tmp_path / "tm")], copy_to_path=str(tmp_path / "t"), delete_on_copy=True)
    assert left(tmp_path / "s") == [] and len(left(tmp_path / "t")) == 6
    assert acted(out) == {"move_done": 3, "delete_done": 3}
    saved = store.load(spark, str(tmp_path / "m"))
    assert all(r.path.startswith(str(tmp_path / "t")) for r in saved.files.collect()) and saved.files.count() == 3


def test_move_ignores_and_dedupes_empties(run, tmp_path):
    src = tree(tmp_path / "s", {"op": "1", "dup": "base", "i1": "in", "sub/i2": "in", "empty": "", "x.ignore": "in"})
    tree(tmp_path / "b", {"dt": "base", "e": ""})
    run(str(tmp_path / "b"), manifest_out_path=str(tmp_path / "bm"))
    run(src, manifest_out_path=str(tmp_path / "m"), copy_to_path=str(tmp_path / "t"), compare_manifests=str(tmp_path / "bm"), delete_on_copy=True, dedupe_empty=True, ignored_patterns=["*.ignore"])
    assert left(tmp_path / "t") == ["i1", "op"] and left(tmp_path / "s") == ["x.ignore"] and len(left(tmp_path / "b")) == 2


def test_copy_keeps_structure_and_rules_change_it(run, tmp_path):
    src = tree(tmp_path / "s", {"file1.txt": "1", "sub/file2.JPG": "2", "sub/nested/file3.txt": "3"})
    os.utime(tmp_path / "s/sub/file2.JPG", (0, 1704067200))
    run(src, copy_to_path=str(tmp_path / "t"), preserve_stat=True)
    assert left(tmp_path / "t") == ["file1.txt", "sub/file2.JPG", "sub/nested/file3.txt"]
    assert os.stat(tmp_path / "t/sub/file2.JPG").st_mtime == 1704067200
    run(src, copy_to_path=str(tmp_path / "u"), path_rules=["*.jp*:extension", "jpg:mtime", "*.t*:no_change"])
    assert left(tmp_path / "u") == ["2024_01/file2.JPG", "file1.txt", "sub/nested/file3.txt"]
    run(src, ["jpg"], copy_to_path=str(tmp_path / "v"))
    assert left(tmp_path / "v") == ["sub/file2.JPG"]


def test_resume_reads_only_what_is_new(run, tmp_path, spark):
    src = tree(tmp_path / "s", {"a": "1", "b": "2"})
    run(src, manifest_out_path=str(tmp_path / "m"))
    before = sorted(p.name for p in (tmp_path / "m").iterdir())
    (tmp_path / "s/a").write_text("changed")
    tree(tmp_path / "s", {"c": "1"})
    out = run(src, manifests_in_paths=str(tmp_path / "m"), manifest_out_path=str(tmp_path / "n"))
    assert out.files.count() == 3 and out.collisions.count() == 2  # by path alone: a is as it was read
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == before


def test_overlapping_roots_delete_nothing(run, tmp_path):
    tree(tmp_path / "s", {"a": "1", "sub/b": "2"})
    run([str(tmp_path / "s"), str(tmp_path / "s/sub")], manifest_out_path=str(tmp_path / "m"), delete_duplicates=True)
    assert len(left(tmp_path / "s")) == 2


def test_failed_copies_leave_their_sources(run, tmp_path):
    src = tree(tmp_path / "s", {"a": "1"})
    (tmp_path / "t").write_text("a file where the target should be")
    out = run(src, copy_to_path=str(tmp_path / "t"), manifest_out_path=str(tmp_path / "m"), delete_on_copy=True)
    assert left(tmp_path / "s") == ["a"] and acted(out) == {"move_failed": 1}
    assert [r.path for r in out.files.collect()] == [f"{src}/a"]


def test_changed_sources_are_not_moved(run, tmp_path):
    src = tree(tmp_path / "s", {"a": "1"})
    run(src, manifest_out_path=str(tmp_path / "m"))
    (tmp_path / "s/a").write_text("2")
    out = run(None, manifests_in_paths=str(tmp_path / "m"), no_walk=True, copy_to_path=str(tmp_path / "t"), delete_on_copy=True, manifest_out_path=str(tmp_path / "n"))
    assert left(tmp_path / "s") == ["a"] and left(tmp_path / "t") == [] and acted(out) == {"move_failed": 1}


def test_an_action_that_runs_twice(tmp_path):
    tree(tmp_path, {"a": "1"})
    a, b = str(tmp_path / "a"), str(tmp_path / "d/b")
    actions.act("move", a, b, 1)
    actions.act("move", a, b, 1)
    assert left(tmp_path) == ["d/b"]
    with pytest.raises(OSError):
        actions.act("copy", b, b, 1)


def test_a_deletion_that_runs_twice_and_one_of_another_file(tmp_path):
    tree(tmp_path, {"a": "1", "b": "1"})
    md5 = "c4ca4238a0b923820dcc509a6f75849b"
    for _ in range(2):
        actions.act("delete", str(tmp_path / "a"), None, 1, algorithm="md5", expected=md5)
    (tmp_path / "b").write_text("2")
    with pytest.raises(OSError):
        actions.act("delete", str(tmp_path / "b"), None, 1, algorithm="md5", expected=md5)
    with pytest.raises(OSError):  # its directory is gone: perhaps a mount is
        actions.act("delete", str(tmp_path / "none/a"), None, 1)
    assert left(tmp_path) == ["b"]


def test_late_files_of_one_hash_get_names_of_their_own(run, tmp_path):
    src = tree(tmp_path / "s", {f"d{i}/x.txt": "" for i in range(4)} | {"e/x.txt": "1"})
    run(src, copy_to_path=str(tmp_path / "t"), path_rules=["*:extension"], suffix_conflicts=True)
    assert len(left(tmp_path / "t")) == 5 and "txt/x.txt" in left(tmp_path / "t")


def test_report_in_parts(run, spark, tmp_path):
    from siftwell.plans.report import write_report_parts

    out = run(tree(tmp_path / "s", FIVE))
    write_report_parts(out.collisions, str(tmp_path / "r"), 2)
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(lines) == 4 and sum(x.startswith("1, ") for x in lines) == 2 and repr(f"{tmp_path}/s/a.txt") in "".join(lines)


def test_tables_of_a_run_are_removed(spark):
    from siftwell import storage

    df = storage.written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3
    folder = storage.run_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    storage.forget(spark)
    assert not os.path.exists(folder)


def test_verify(run, tmp_path):
    src = tree(tmp_path / "s", {f"f{i}": "x" * 100 for i in range(5)})
    run(src, manifest_out_path=str(tmp_path / "m"))
    check = lambda: run(None, manifests_in_paths=str(tmp_path / "m"), verify_manifest=True)
    assert check().verified
    with open(tmp_path / "s/f0", "a") as f:
        f.write("y")
    os.remove(tmp_path / "s/f1")
    out = check()
    assert not out.verified and sorted(r.error for r in out.errors.collect()) == ["missing", "size"]


def test_unreadable_files_are_errors(run, tmp_path):
    src = tree(tmp_path / "s", {"a": "1", "b": "1"})
    os.chmod(tmp_path / "s/a", 0)
    out = run([src, str(tmp_path / "nowhere")])
    readable = os.geteuid() == 0  # root reads everything
    assert out.files.count() == (2 if readable else 1)
    assert out.counts["unread"] == (1 if readable else 2)
    assert any("nowhere" in r.path for r in out.errors.collect())
    os.chmod(tmp_path / "s/a", stat.S_IRUSR)


def test_wrong_options(run, tmp_path):
    m = str(tmp_path / "m")
    run(tree(tmp_path / "s", {"a": "1"}), manifest_out_path=m)
    for options in (
        {"manifests_in_paths": m, "manifest_out_path": m},
        {"compare_manifests": m, "manifest_out_path": m},
        {"copy_to_path": "/t", "delete_duplicates": True},
        {"hash_algo": "sha1"},
        {"path_rules": ["a"]},
        {"manifests_in_paths": m, "hash_algo": "xxh64"},
        {"manifests_in_paths": str(tmp_path / "none")},
    ):
        with pytest.raises(ValueError):
            run(str(tmp_path / "s"), **options)
    with pytest.raises(ValueError):
        run(None, no_walk=True)
    with pytest.raises(ValueError):
        run(None)


def test_no_copy_and_converted_paths(run, tmp_path):
    src = tree(tmp_path / "s", {"a": "1", "b": "2"})
    out = run(src, manifest_out_path=str(tmp_path / "m"), no_copy=["c4ca4238a0b923820dcc509a6f75849b"], copy_to_path=str(tmp_path / "t"))
    assert left(tmp_path / "t") == ["b"] and out.counts["copy_done"] == 1
    out = run(None, manifests_in_paths=str(tmp_path / "m"), no_walk=True, convert_manifest_paths_from=src, convert_manifest_paths_to="/fred")
    assert sorted(r.path for r in out.files.collect()) == ["/fred/a", "/fred/b"]


def test_copies_in_sequence(run, tmp_path):
    target, manifests = tmp_path / "t", []
    for i, files in enumerate(({"a": "1", "b": "2"}, {"c": "2", "d": "3"}, {"e": "1", "f": "4"})):
        src, m = tree(tmp_path / f"s{i}", files), str(tmp_path / f"m{i}")
        run(src, manifest_out_path=m, copy_to_path=str(target), compare_manifests=list(manifests) or None)
        manifests.append(m)
        assert len(left(target)) == 2 + i
