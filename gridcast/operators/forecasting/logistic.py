"""Logistic regression of all zones at once (ML20): Newton steps over summed gradients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridcast.operators.relational import broadcast_if_small
from gridcast.session import written

_FLUSH_GROUPS = 1_024


def _partial_steps(region: str, k: int):
    """Per task and zone: loss, gradient and upper half of the Hessian, end to end. Columns: zone, k features
    (the first a constant), label, weight, current coefficients."""
    upper = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def emit() -> pd.DataFrame:
            out = pd.DataFrame({region: list(state), "sums": list(state.values())})
            state.clear()
            return out

        for pdf in batches:
            z = np.ones((len(pdf), k))
            z[:, 1:] = pdf[[f"_x{i}" for i in range(k - 1)]].to_numpy(dtype=float)
            y, w = pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float)
            for zone, rows in pdf.groupby(region, sort=False).indices.items():
                beta = np.asarray(pdf["beta"].iloc[rows[0]], float)
                x, t, c = z[rows], y[rows], w[rows]
                v = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(v, -700, 700)))
                loss = c @ (np.logaddexp(0.0, v) - t * v)
                hessian = (x * (c * p * (1 - p))[:, None]).T @ x
                state[zone] = state.get(zone, 0.0) + np.concatenate([[loss], x.T @ (c * (p - t)), hessian[upper]])
            if len(state) > _FLUSH_GROUPS:
                yield emit()
        if state:
            yield emit()

    return run


def _update(k: int, penalty: float):
    upper = np.triu_indices(k)
    ridge = np.r_[0.0, np.full(k - 1, penalty)]

    @F.pandas_udf("struct<beta: array<double>, last: array<double>, loss: double, slope: double>")
    def step(sums: pd.Series, beta: pd.Series, last: pd.Series, best: pd.Series) -> pd.DataFrame:
        out = []
        for total, now, before, least in zip(sums, beta, last, best, strict=True):
            total, now, before = np.asarray(total, float), np.asarray(now, float), np.asarray(before, float)
            loss = total[0] + ridge @ now**2 / 2
            if loss > least * (1 + 1e-12) + 1e-12:
                # The step was too long: go half the way back.
                out.append((((now + before) / 2).tolist(), before.tolist(), float(least), float("inf")))
                continue
            gradient = total[1 : k + 1] + ridge * now
            hessian = np.zeros((k, k))
            hessian[upper] = total[k + 1 :]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T + np.diag(ridge)
            move = np.linalg.pinv(hessian, hermitian=True) @ gradient
            out.append(((now - move).tolist(), now.tolist(), float(loss), float(np.abs(gradient).max())))
        return pd.DataFrame(out, columns=["beta", "last", "loss", "slope"])

    return step


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, region: str = "region",
    penalty: float = 1.0, max_iter: int = 50, tol: float = 1e-7,
) -> DataFrame:
    """ML20: a row (region, intercept, coef, loss, slope) per zone that minimises the weighted log loss plus
    penalty / 2 * |coef|**2; slope is the largest gradient entry at the result.

    Each round is one pass over the rows: tasks reduce them to one small array per zone, Spark adds the
    arrays entry by entry, and a small system per zone gives the next coefficients. So a zone of any size
    is spread over all tasks, and any number of zones takes the same number of rounds. ``df`` is read once
    a round, so it should be a written table. Labels are 0 or 1; rows with an unknown value must be gone.
    """
    k = len(features) + 1
    x = df.where(F.col(region).isNotNull()).select(
        region, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
        F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
    )
    key = x.schema[region].dataType.simpleString()
    zero = F.array_repeat(F.lit(0.0), k)
    state = written(x.select(region).distinct().select(region, zero.alias("beta"), zero.alias("last"), F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("slope")), "logistic")
    update = _update(k, penalty)
    for _ in range(max_iter):
        partial = x.join(broadcast_if_small(state.select(region, "beta")), region)
        partial = partial.mapInPandas(_partial_steps(region, k), f"`{region}` {key}, sums array<double>")
        summed = (
            partial.select(region, F.posexplode("sums").alias("pos", "v"))
            .groupBy(region, "pos")
            .agg(F.sum("v").alias("v"))
            .groupBy(region)
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("sums"))
        )
        moved = summed.join(state.select(region, "beta", "last", "loss"), region)
        state = written(moved.select(region, update("sums", "beta", "last", "loss").alias("s")).select(region, "s.*"), "logistic")
        if state.agg(F.max("slope")).first()[0] is None or state.where(F.col("slope") > tol).isEmpty():
            break
    # "last" is where loss and gradient were measured.
    coef = F.slice("last", F.lit(2), F.lit(k - 1))
    return state.select(region, F.get("last", F.lit(0)).alias("intercept"), coef.alias("coef"), "loss", "slope")


def predict_logistic(df: DataFrame, model: DataFrame, features: Sequence[str], as_name: str, region: str = "region") -> DataFrame:
    """Probability of class 1; rows of a zone without a model have no row."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coef")[i] * F.col(f)
    m = broadcast_if_small(model.select(region, "intercept", "coef"))
    return df.join(m, region).withColumn(as_name, 1.0 / (1.0 + F.exp(-value))).drop("intercept", "coef")
