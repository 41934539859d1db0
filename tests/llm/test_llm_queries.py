"""The registered corpus queries against their SQL, and their number."""

import compare
import pytest

from quillmeter.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, small_dir, name):
    ok, message = compare.compare(spark, compare.duck(small_dir), name, QUERIES[name], ORACLES[name], small_dir)
    assert ok, message
