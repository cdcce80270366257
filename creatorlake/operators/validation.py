"""Cross-validated linear models from sums of products: one small matrix for each fold, whatever the number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, features: list[str], target: str, fold: str) -> pd.DataFrame:
    """Sums of products of (1, features, target) by fold: what the driver gets depends on folds and features only."""
    names = ["__one", *features, target]
    rows = df.dropna(subset=[*features, target, fold]).withColumn("__one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(fold).agg(*sums).toPandas()


def ridge_out_of_fold(df: DataFrame, features: list[str], target: str, fold: str, alpha: float = 1.0, guess: str = "guess") -> DataFrame:
    """df with each row's prediction by the model that its own fold had no part in; null where a feature is null.

    Features are centred and scaled inside the solution; the intercept isn't shrunk.
    """
    table, p = moments(df, features, target, fold), len(features) + 2
    total = np.zeros((p, p))
    by: dict = {}
    for row in table.to_dict("records"):
        m = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                m[i, j] = m[j, i] = row[f"{i}_{j}"]
        by[row[fold]] = m
        total += m
    out = F.lit(None).cast("double")
    for k, own in by.items():
        m = total - own
        if m[0, 0] <= 0:
            continue
        mean = m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-12))
        corr = cov[:-1, :-1] / np.outer(scale, scale)
        w = np.linalg.solve(corr + alpha / m[0, 0] * np.eye(p - 2), cov[:-1, -1] / scale) / scale
        line = F.lit(float(mean[-1] - w @ mean[:-1]))
        for c, x in zip(features, w, strict=True):
            line = line + float(x) * F.col(c)
        out = F.when(F.col(fold) == k, line).otherwise(out)
    return df.withColumn(guess, out)
