"""Resampling and validation (J, N) over the creator panel. These have no SQL twin: tests hold them against NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.functions.text import hash_fold
from creatorlake.operators import resampling as B
from creatorlake.operators import statistics as S
from creatorlake.operators.validation import ridge_out_of_fold
from creatorlake.plans.panel import METRICS, videos
from creatorlake.plans.registry import query


@query()
def j15_row_bootstrap(table):
    return B.bootstrap_mean(videos(table), ["kind"], "views", ["video_id"])


@query()
def j16_group_bootstrap(table):
    return B.bootstrap_mean(videos(table), ["kind"], "views", ["source"])


@query()
def j14_sign_flip(table):
    v = videos(table)
    centred = v.join(F.broadcast(v.agg(F.avg("views").alias("m")))).withColumn("e", F.col("views") - F.col("m"))
    return B.sign_flip(centred, ["kind"], "source", "e")


@query()
def n1_out_of_fold_ridge(table):
    v = videos(table).withColumn("fold", hash_fold(F.col("source").cast("string"), 5))
    return S.errors(ridge_out_of_fold(v, METRICS, "views", "fold"), ["fold"], "views", "guess")
