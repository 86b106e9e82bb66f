"""The driver contract and a sample of registered queries against their oracles at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "frame_label_points", "pinhole_intrinsics", "frame_histogram", "global_histogram", "contour_edges", "inner_edge_mask",
    "rasterize_polygons", "distance_transform", "opening_edges", "nearest_vertex", "segment_labels", "stream_frame_histogram", "gate_complete",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_oracle_parses(duck):
    for name, sql in entry.oracle_sql().items():
        duck.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
