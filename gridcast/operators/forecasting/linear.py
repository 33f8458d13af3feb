"""Least squares for all zones at once (ML4)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.scalar import interactions, one_hot_drop_first
from gridcast.operators.forecasting.features import HOURLY_FEATURES

_FLUSH_GROUPS = 4_096


def interaction_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The hourly features with weekday dummies and interactions; returns frame and column names."""
    dummies, cross = one_hot_drop_first("day_of_week", "day_of_week"), interactions()
    base = [c for c in HOURLY_FEATURES if c != "day_of_week"]
    return df.withColumns({**dummies, **cross}), [*base, *dummies, *cross]


def _partial_moments(region: str, columns: Sequence[str]):
    """Per task: one upper-triangular cross-product array per zone, added up over all batches."""
    k = len(columns) + 1
    upper = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def emit() -> pd.DataFrame:
            out = pd.DataFrame({region: list(state), "moments": [m[upper] for m in state.values()]})
            state.clear()
            return out

        for pdf in batches:
            z = np.ones((len(pdf), k))
            z[:, 1:] = pdf[list(columns)].to_numpy(dtype=float)
            known = ~np.isnan(z).any(axis=1)
            for key, rows in pdf.groupby(region, sort=False).indices.items():
                part = z[rows][known[rows]]
                if not len(part):
                    continue
                state[key] = state.get(key, 0.0) + part.T @ part
            if len(state) > _FLUSH_GROUPS:
                yield emit()
        if state:
            yield emit()

    return run


def _solver(n_features: int, rcond: float):
    k = n_features + 2
    upper = np.triu_indices(k)

    @F.pandas_udf("struct<intercept: double, coef: array<double>, n: bigint>")
    def solve(moments: pd.Series) -> pd.DataFrame:
        out = []
        for packed in moments:
            g = np.zeros((k, k))
            g[upper] = packed
            g = np.triu(g) + np.triu(g, 1).T
            n, mean = g[0, 0], g[0, 1:] / g[0, 0]
            cov = g[1:, 1:] / n - np.outer(mean, mean)
            # Correlations instead of covariances: features differ in scale by orders of magnitude.
            sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
            sd[sd <= 1e-9 * np.abs(mean)] = np.inf
            corr = cov / np.outer(sd, sd)
            # Weekend and weekday dummies are collinear: the pseudo-inverse picks the least-norm fit.
            beta = np.linalg.pinv(corr[:-1, :-1], rcond=rcond, hermitian=True) @ corr[:-1, -1]
            # A constant column has no weight; a constant target no slope.
            coef = beta / sd[:-1] * (sd[-1] if np.isfinite(sd[-1]) else 0.0)
            out.append((float(mean[-1] - coef @ mean[:-1]), coef.tolist(), int(round(n))))
        return pd.DataFrame(out, columns=["intercept", "coef", "n"])

    return solve


def fit_ols(
    df: DataFrame, features: Sequence[str], target: str = "load", region: str = "region", rcond: float = 1e-11
) -> DataFrame:
    """ML4, fit: a row (region, intercept, coef, n_train) per zone, from one pass over the rows. Rows
    with an unknown value are left out.

    Tasks reduce their rows to one small array of cross products per zone, Spark adds the arrays up
    entry by entry, and one small system per zone is solved. So a zone of any size is spread over all
    tasks.
    """
    names = [*features, target]
    x = df.where(F.col(region).isNotNull()).select(region, *[F.col(c).cast("double").alias(c) for c in names])
    key = x.schema[region].dataType.simpleString()
    partial = x.mapInPandas(_partial_moments(region, names), f"`{region}` {key}, moments array<double>")
    summed = (
        partial.select(region, F.posexplode("moments").alias("pos", "v"))
        .groupBy(region, "pos")
        .agg(F.sum("v").alias("v"))
        .groupBy(region)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("moments"))
    )
    solve = _solver(len(features), rcond)
    return summed.select(region, solve("moments").alias("fit")).select(
        region, "fit.intercept", "fit.coef", F.col("fit.n").alias("n_train")
    )


def predict_ols(
    df: DataFrame, model: DataFrame, features: Sequence[str], region: str = "region", as_name: str = "predicted_load"
) -> DataFrame:
    """ML4, apply: the model table has one row per zone and is joined; the rest is arithmetic. A row
    with an unknown feature gets null."""
    m = model.select(region, "intercept", "coef")
    value: Column = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coef")[i] * F.col(f)
    return df.join(m, region).withColumn(as_name, value).drop("intercept", "coef")
