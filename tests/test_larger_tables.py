"""Queries against their SQL on rows that only larger tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import DATA, rows

from trackspark.operators.segment import refine
from trackspark.plans.catalogue import ORACLES, QUERIES
from trackspark.trace import Trace


@pytest.fixture()
def same(spark, tmp_path):
    """Whether a query over a table of events gives what its SQL gives."""

    def compare(name, events):
        events.write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        cursor = con.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        found = [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
        return rows(found) == rows([dict(zip(columns, r)) for r in cursor.fetchall()])

    return compare


def test_origin_of_sessions_beyond_the_poles(spark, same):
    """Users from 1875 on are drawn beyond the pole, where 3857 has no y; their x and z count from their first row."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert same("normalise_first", events.withColumn("user_id", F.col("user_id") + F.lit(1870)))


def test_origin_of_planar_rows_has_both_coordinates(spark):
    """Without a projection the first row that has x and y is the origin, whatever else a row has."""
    df = spark.createDataFrame([("a", 0.0, 3.0, None, 0), ("a", 1.0, 4.0, 7.0, 1)], "session_id string, unix_time double, x double, y double, n long")
    trace = Trace.from_dataframe(df, ("session_id",), "local", order_by="n").coordinate("xyz", norm=True)
    assert [tuple(r) for r in trace.df.orderBy("_row").select("x", "y").collect()] == [(-1.0, None), (0.0, 0.0)]


@pytest.mark.parametrize("turned", [False, True])
def test_mean_at_the_threshold_is_summed_by_time(spark, turned):
    """The first block's mean is 50, summed by time a little less, so it goes with the slow one after it, in whatever order rows arrive."""
    v = [12.82, 133.23, 23.98, 29.97, 1.0, 2.0, 3.0, 4.0]
    data = [("a", float(i), i, x, 1 + i // 4) for i, x in enumerate(v)]
    df = spark.createDataFrame(data[::-1] if turned else data, "session_id string, unix_time double, _row long, velocity double, __block long")
    found = refine(df.coalesce(1), ["session_id"], 50.0, 4)
    assert [r[0] for r in found.select("designation").distinct().collect()] == ["relief_1"]
