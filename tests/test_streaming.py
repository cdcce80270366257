import datetime as dt

from creatorlake.streaming.snapshots import first_sightings, last_snapshots

START = dt.datetime(2024, 1, 1)


def test_repeats_are_left_out_and_late_rows_take_their_place(spark, tmp_path):
    rows = [("v", START + dt.timedelta(minutes=i), i) for i in range(70)]
    spark.createDataFrame(rows, "video_id string, at timestamp, views long").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("v", START + dt.timedelta(minutes=71), 69), ("w", None, 1), ("w", START, 5)], "video_id string, at timestamp, views long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, at timestamp, views long").parquet(str(tmp_path / "in"))
    query = last_snapshots(stream).writeStream.format("memory").queryName("snapshots").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("snapshots").groupBy("video_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"v": 70, "w": 1}


def test_an_id_is_seen_once(spark, tmp_path):
    spark.createDataFrame([(1, START), (1, START), (2, START)], "id long, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "in"))
    query = first_sightings(stream, "id", "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.table("seen").collect()) == [1, 2]
