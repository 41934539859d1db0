"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

from quillmeter.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

#: Queries without comparison SQL and the hand-made cases of their operators (``tests/test_rules.py``).
HAND_MADE = {
    "j10_weighted_columns_ruled": "test_ruled_lines_break_and_attract_columns",
    "j21_logical_cells": "test_logical_cells_partition_the_words",
    "k9_pair_bill_rows": "test_bill_and_form_pairs",
    "k12_split_value": "test_value_splitting_keeps_everything",
    "k15_key_value_split": "test_key_value_split",
    "k26_split_cells": "test_value_splitting_keeps_everything",
}
#: Queries that are only known to run.
ROWS_ONLY = {
    "j17_grid_boundaries", "j18_snap_text_to_grid", "j38_soft_table", "j39_visual_grid", "j39_hybrid_grid",
    "j44_resume_rows", "j44_statement_rows", "k11_generic_fixes", "k11_fixes_by_type", "l8_route_measured",
}


def test_queries_without_sql_are_named():
    import test_rules

    assert set(QUERIES) - set(ORACLES) == set(HAND_MADE) | ROWS_ONLY
    assert all(hasattr(test_rules, name) for name in HAND_MADE.values())


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    spark.catalog.clearCache()
    assert ok, message


def test_every_inventory_group_is_registered():
    prefixes = {n.split("_")[0] for n in QUERIES}
    groups = {"b": 20, "c": 10, "d": 14, "e": 5, "f": 9, "g": 13, "h": 3, "i": 25, "j": 45, "k": 30, "l": 15, "m": 8}
    missing = [f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1) if f"{g}{i}" not in prefixes]
    assert missing == ["d4"]  # the month key of d1
