import pytest
import tables

from locusforge.plans import problems, reference

PARTS = {**reference.queries(), **problems.queries()}


@pytest.mark.parametrize("variant", ["empty", "dirty"])
def test_every_query_stands_empty_and_dirty_tables(spark, tmp_path, variant):
    d = tables.make(spark, tmp_path, variant)
    for name, query in PARTS.items():
        rows = query(spark, d).collect()
        if variant == "empty" and name not in ("null_model", "config_round_trip", "compare_zero_filled", "compare_light_mode"):
            assert rows == [], name
        if variant == "dirty" and name.startswith("p"):
            assert rows or name == "pileup", name


def test_every_query_has_sql():
    assert set(PARTS) == set(reference.oracle_sql()) | set(problems.oracle_sql())
