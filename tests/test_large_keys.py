"""Queries on tables whose keys go beyond those of the given ones, against DuckDB."""

import duckdb
import pytest
from test_catalogue import DATA, text

from tidelane.plans import catalogue


def same(spark, name, folder, table):
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert got and sorted(names) == columns and got == sorted(tuple(text(row[names.index(c)]) for c in columns) for row in found.fetchall())


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """Users on both sides of 65,536, where the third part of their addresses passes 255, and of 2^24."""
    folder = tmp_path_factory.mktemp("users")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CAST(CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id + 65530 ELSE user_id + 16777211 END AS BIGINT) AS user_id) FROM read_parquet('{DATA}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def test_capture_round_trip_of_many_users(spark, many_users):
    same(spark, "capture_round_trip", many_users, "events")


@pytest.mark.parametrize("name", ["frame_flows", "frame_layers", "frame_parse"])
def test_frames_of_many_users(spark, many_users, name):
    same(spark, name, many_users, "events")


@pytest.mark.parametrize("name", ["lineitem_bursts", "lineitem_flows"])
def test_tasks_grow_with_lineitem(spark, monkeypatch, name):
    """Spark would merge the shuffle's partitions into one."""
    monkeypatch.setattr("tidelane.sources.views.TASK_ROWS", 700)
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() == 9 and df.rdd.glom().map(len).filter(bool).count() == 9
    same(spark, name, DATA, "lineitem")
