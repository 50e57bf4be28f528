from pathlib import Path

import pytest

from splitwright.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
COLUMNS = {
    "p1_found": ["epsilon", "component_id", "stem"],
    "p3_found": ["image_a", "image_b"],
    "p4_found": ["group_id"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)


def test_every_text_comes_back(spark):
    assert QUERIES["p6_roundtrip"](spark, DATA).where("not same").count() == 0
