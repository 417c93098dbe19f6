"""Every query of this subpackage over the smallest tables: against SQL, or for its shape."""

import pytest

import oracle
from quarry.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROWS = {"op1_warc": "pages", "op4_url_filter": "pages"}


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    good, note = oracle.compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op8_preference", "op12_whitening", "op13_structure_repair"}))
def test_a_row_for_every_input_row(spark, name):
    table = spark.read.parquet(f"{SF_DIR}/{ROWS.get(name, 'documents')}.parquet")
    assert QUERIES[name](spark, SF_DIR).count() == table.count()


def test_there_is_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
