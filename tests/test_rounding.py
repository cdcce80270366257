"""Rounding goes as the SQL twins round, to the last bit."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from creatorlake.functions import arrays as A
from creatorlake.plans import QUERIES, SQL


def test_halves_and_zeros_round_as_in_sql(spark):
    values = [8.1921875, -8.1921875, 0.5, -1e-7, 1e-7, -0.0, 0.0, 2.5e-6, 1e305, float("inf"), -float("inf"), float("nan"), None]
    got = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", A.rounded(F.col("v"), 6).alias("v")).collect()
    con = duckdb.connect()
    assert [repr(r.v) for r in sorted(got)] == [repr(con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values]


def test_shapes_have_the_zeros_of_their_sql(spark, tmp_path):
    start = datetime(2024, 1, 1)
    # the middle lies a little under the end: its share is a negative zero
    rows = [(i, start + timedelta(minutes=m), 1, v) for i, (m, v) in enumerate([(0, 560.0), (501, 39.99), (502, 40.0), (503, 40.0), (1000, 200.0)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["i5_affine_normalised"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, value FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["i5_affine_normalised"]).fetchall()
    assert "-0.0" in repr(want) and repr([(r.user_id, r["shape"]) for r in got]) == repr(want)
