"""Queries whose SQL cuts numbers in names, on tables with numbers longer than that."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SOURCE = "/root/testdata/sf0.001"
SHIFT = {"supplier": "s_suppkey + 1000 AS s_suppkey", "orders": "o_orderkey + 1001900 AS o_orderkey", "events": "event_id + 999500 AS event_id"}


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shifted")
    con = duckdb.connect()
    for t in TABLES:
        replaced = f"* REPLACE ({SHIFT[t]})" if t in SHIFT else "*"
        source = f"{SOURCE}/{t}.parquet" + ("/*.parquet" if Path(f"{SOURCE}/{t}.parquet").is_dir() else "")
        con.execute(f"COPY (SELECT {replaced} FROM '{source}') TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["door_entities", "stair_entities", "read_frame_list", "stream_dedup_frames", "stream_progress", "match_opening"])
def test_names_equal_oracle(spark, shifted, name):
    folder, con = shifted
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
