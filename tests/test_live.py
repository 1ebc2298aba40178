import pytest

from siftwell.plans import live
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(live.QUERIES))
def test_queries_on_files_match_their_sql(spark, name):
    same(live.QUERIES[name](spark, SF), live.ORACLE_SQL[name], SF)


def test_a_folder_that_is_no_mount_is_refused(spark, monkeypatch):
    monkeypatch.setattr(live, "new_folder", lambda spark, name: f"hdfs://host/{name}")
    with pytest.raises(RuntimeError, match="no mount"):
        live.shared_mount(spark, "tree")
