import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.operators import duplicates, records, selection
from siftwell.plans import catalogue
from siftwell.schemas import FILES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def files(spark, rows):
    return spark.createDataFrame([(h, s, float(m), p) for h, s, m, p in rows], FILES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() == 200


def test_xxh64_files_hashes_the_texts(spark, tmp_path):
    texts = ["This is a test file for hashing.", "Ä" * 5000, "", None, "This is a test file for hashing."]
    rows = [(i, t, "en", "src3") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.path.split("_")[1][:7]): r.hash for r in catalogue.QUERIES["xxh64_files"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else xxhash.xxh64(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert got[0] == got[4] == "8471ab391af8733a"


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_a_path_listed_twice_is_no_duplicate(spark):
    twice = files(spark, [("h", 1, 1, "/a"), ("h", 1, 2, "/a")])
    assert duplicates.one_per_path(twice).collect() == [("h", 1, 2.0, "/a")]
    assert selection.delete_plan(twice).count() == 0


def test_small_keeper_does_not_shield_a_large_duplicate(spark):
    assert paths(selection.delete_plan(files(spark, [("h", 50, 1, "/a"), ("h", 200, 1, "/b")]), min_size=100)) == ["/b"]


def test_ignored_rows_claim_no_hash_and_are_not_deleted(spark):
    rows = files(spark, [("h", 1, 1, "/r/a.txt"), ("h", 1, 1, "/r/b.jpg"), ("h", 1, 1, "/r/skip/c.jpg")])
    plan = {r.path: r.action for r in selection.transfer_plan(rows, "/t", ["/r"], extensions=["jpg"], ignore=["*/skip/*"], move=True).collect()}
    assert plan == {"/r/a.txt": "skip", "/r/b.jpg": "move", "/r/skip/c.jpg": "skip"}
    assert paths(selection.copy_selection(rows, extensions=["jpg"], ignore=["*/skip/*"])) == ["/r/b.jpg"]


def test_a_compared_row_never_deletes_itself(spark):
    rows = files(spark, [("h", 1, 1, "/a"), ("h", 1, 1, "/b")])
    assert selection.delete_plan(rows, rows).count() == 0
    assert paths(selection.delete_plan(rows, rows.filter("path = '/a'"))) == ["/b"]


def test_conflicting_destinations(spark):
    rows = files(spark, [("h1", 1, 1, "/r/x/a.txt"), ("h2", 1, 1, "/r/y/a.txt")])
    plan = selection.transfer_plan(rows, "/t", ["/r"], ["*:extension"])
    assert {r.path: r.action for r in selection.with_conflicts(plan).collect()} == {"/r/x/a.txt": "copy", "/r/y/a.txt": "error"}
    assert {r.dest for r in selection.with_conflicts(plan, suffix=True).collect()} == {"/t/txt/a.txt", "/t/txt/a-h2.txt"}


def test_empty_tables_and_nulls(spark):
    none = files(spark, [])
    assert duplicates.numbered(duplicates.collisions(none)).count() == 0
    assert selection.delete_plan(none).count() == selection.copy_selection(none).count() == 0
    assert records.common_root(none) is None
    odd = spark.createDataFrame([(None, None, None, None), ("h", None, None, "/a"), ("h", 5, 1.0, "/b")], FILES)
    assert duplicates.extension_sizes(odd).count() == 2
    assert records.verified(odd, odd.select("path", "size", F.lit(None).cast("string").alias("error"))).count() == 3


def test_groups_are_numbered_in_order_of_hash(spark):
    rows = files(spark, [(f"{h:032x}", 1, 1, f"/{h}/{k}") for h in (7, 3, 1 << 120, 5 << 124) for k in range(2)])
    assert [r.group for r in duplicates.numbered(rows).orderBy("hash").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_common_root(spark):
    assert records.common_root(files(spark, [("h", 1, 1, "/a/b/c"), ("h", 1, 1, "/a/bd/e")])) == "/a"
    assert records.common_root(files(spark, [("h", 1, 1, "/a/b")])) == "/a"


def test_first_per_hash_needs_no_window(spark):
    plan = selection.copy_selection(files(spark, [("h", 1, 1, "/a")]))._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_nested_rows_are_bounded_and_lose_nothing(spark):
    rows = [("h1", 1, 1, f"/{i:04d}") for i in range(1000)] + [(None, 1, 1, f"/n{i}") for i in range(50)] + [("h2", 1, 1, "/x"), ("h2", 1, 1, "/x"), ("h3", 1, 1, None)]
    table = files(spark, rows)
    by_hash = records.nested(table, most=20)
    assert by_hash.agg(F.max(F.size("files"))).first()[0] < 60
    assert [r.part for r in by_hash.filter("hash IN ('h2', 'h3')").collect()] == [0, 0]
    back = records.flattened(by_hash)
    assert sorted(map(repr, back.select(*FILES.names).collect())) == sorted(map(repr, table.collect()))
    assert records.nested(files(spark, [])).count() == 0
