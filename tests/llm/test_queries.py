import pytest

import corpus_pipeline
from siftwell.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_stages_are_those_asked_for():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "decontamination", "packing"]
