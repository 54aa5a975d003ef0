import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).resolve().parents[1]))
tables = pytest.importorskip("tables")
from locusforge.llm import queries, sql  # noqa: E402

COLUMNS = {
    "p1_found": ["seq_table", "seq_key", "run_start", "run_end", "n_rows"],
    "p5_found": ["genome", "group_sample", "sample"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("variant", ["empty", "dirty"])
def test_every_query_stands_empty_and_dirty_tables(spark, tmp_path, variant):
    d = tables.make(spark, tmp_path, variant)
    for name, query in queries.queries().items():
        df = query(spark, d)
        rows = df.collect()
        assert bool(rows) == (variant == "dirty"), name
        assert df.columns == COLUMNS.get(name, df.columns)


def test_sql_belongs_to_queries():
    assert set(sql.oracle_sql()) <= set(queries.queries())
