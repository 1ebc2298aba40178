import io

import pytest

from siftwell.cli import main
from siftwell.explorer import Explorer
from siftwell.sources import manifest as store
from siftwell.streaming.ingest import ingest_batch, ingest_stream


def wrong(*argv):
    with pytest.raises(SystemExit) as e:
        main(argv)
    return e.value.code


def test_wrong_options():
    assert wrong() == 2
    assert wrong("-p", "/x", "--delete") == 2
    assert wrong("-p", "/x", "--delete-on-copy", "-m", "m") == 2
    assert wrong("-p", "/x", "-c", "/t", "--delete", "-m", "m") == 2
    assert wrong("-p", "/x", "--hash-algo", "sha1") == 2


def test_run_verify_and_explore(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, text in (("a", "1"), ("b", "1"), ("c", "2")):
        (tmp_path / "s" / name).write_text(text)
    m = str(tmp_path / "m")
    assert main(["-p", str(tmp_path / "s"), "-m", m, "-r", str(tmp_path / "r.csv"), "--quiet"], spark) == 0
    assert main(["--verify", "-i", m, "--quiet"], spark) == 0
    with pytest.raises(SystemExit) as e:
        main(["--no-walk", "-i", m, "-m", m, "--quiet"], spark)
    assert e.value.code == 2
    out = io.StringIO()
    shell = Explorer(spark, stdout=out)
    for line in ("info", f"load {tmp_path}/none", f"load {m}", "info", "list 1", "list x", "find c4ca4238a0b923820dcc509a6f75849b", "find nothing", "find", ""):
        shell.onecmd(line)
    said = out.getvalue()
    assert "No manifest" in said and "Hashes: 2\nFiles: 3" in said and "Nothing found for 'nothing'" in said
    assert f"c4ca4238a0b923820dcc509a6f75849b  {tmp_path}/s/a" in said and shell.onecmd("exit")
    assert main(["-p", str(tmp_path / "s"), "--no-walk", "-i", m, "-m", str(tmp_path / "n"), "--delete", "--quiet"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["a", "c"]
    assert main(["--verify", "-i", m, "--quiet"], spark) == 1


def test_sqlite_and_counters(spark, tmp_path):
    import pickle
    import sqlite3

    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("CREATE TABLE t (key BLOB PRIMARY KEY, hash INTEGER, value BLOB)")
        db.execute("INSERT INTO t VALUES (?, 0, ?)", ("c" * 32, pickle.dumps([("/a", 3, 1.5), ("/b", 3, 2.5)])))
    assert main(["--no-walk", "-i", str(tmp_path / "m.db"), "-m", str(tmp_path / "n"), "-q"], spark) == 0
    assert store.load(spark, str(tmp_path / "n")).files.count() == 2
    (tmp_path / "junk").write_text("x")
    with pytest.raises(SystemExit) as e:
        main(["--no-walk", "-i", str(tmp_path / "junk"), "-q"], spark)
    assert e.value.code == 2
    from siftwell import run_dedupe

    for name in ("s/a.txt", "s/d/b.txt", "s/d/c.jpg", "s/skip/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    out = run_dedupe(str(tmp_path / "s"), ["txt"], ignored_patterns=["*/skip"], spark=spark)
    assert {k: out.counts[k] for k in ("directories", "accepted", "ignored", "files")} == {"directories": 2, "accepted": 2, "ignored": 2, "files": 2}


def test_first_seen_in_a_stream(spark, tmp_path):
    from siftwell.streaming.ingest import first_seen

    schema = "hash string, path string, found_at timestamp"
    spark.sql("SELECT 'h' hash, '/a' path, timestamp'2024-01-01 00:00:00' found_at UNION ALL SELECT 'h', '/b', timestamp'2024-01-01 00:10:00' UNION ALL SELECT 'i', '/c', timestamp'2024-01-01 00:20:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.hash for r in spark.table("firsts").collect()) == ["h", "i"]


def test_streamed_manifest(spark, tmp_path):
    inbox, m = str(tmp_path / "in"), str(tmp_path / "m")
    schema = "hash string, size long, mtime double, path string"
    rows = [("h1", 1, 1.0, "/a"), ("h2", 1, 1.0, "/b")]
    spark.createDataFrame(rows, schema).write.parquet(inbox)
    stream = lambda: ingest_stream(spark.readStream.schema(schema).parquet(inbox), m, str(tmp_path / "c"))
    stream().awaitTermination(60)
    assert store.load(spark, m).files.count() == 2
    spark.createDataFrame([("h3", 1, 1.0, "/c"), rows[0]], schema).write.mode("append").parquet(inbox)
    stream().awaitTermination(60)
    assert sorted(r.path for r in store.load(spark, m).files.collect()) == ["/a", "/b", "/c"]
    assert ingest_batch(spark.createDataFrame(rows, schema), m) == 0
