"""Reading video records, keyed collections and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VIDEO = """
video_id string, metadata struct<title:string, description:string, duration:double, viewCount:bigint, uploadDate:string, isVertical:boolean, width:int, height:int>,
analytics struct<avgRetention:double, avgPercentViewed:double, totalViews:bigint, engagedViews:bigint, subscriberViews:bigint, nonSubscriberViews:bigint, likes:bigint, comments:bigint, shares:bigint,
  subscribersGained:bigint, estimatedRevenue:double, retentionCurve:array<struct<second:double,retention:double>>, dailyViews:array<struct<date:date,views:bigint>>>,
transcript struct<fullText:string, words:array<struct<word:string,timestamp:double>>>
"""


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Records with a curve and a mean retention; the schema is declared, so no pass over the files infers it."""
    rows = spark.read.schema(VIDEO).json(path)
    return rows.filter((F.size("analytics.retentionCurve") > 0) & F.col("analytics.avgRetention").isNotNull())


def flattened(videos: DataFrame) -> DataFrame:
    """One row for each video with its curve as array<double>, in order of seconds."""
    curve = F.transform(F.array_sort("analytics.retentionCurve"), lambda p: p["retention"])
    return videos.select("video_id", F.col("metadata.title").alias("title"), F.col("metadata.duration").alias("duration_s"), F.col("analytics.totalViews").alias("views"), F.col("analytics.avgRetention").alias("avg_retention"), curve.alias("curve"))


def collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet collection; an empty one of that schema if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the collection doesn't have; keys that come twice are written once."""
    old = collection(rows.sparkSession, path, rows._jdf.schema().toDDL())
    rows.dropDuplicates([key]).join(old.select(key), key, "left_anti").write.mode("append").parquet(path)
