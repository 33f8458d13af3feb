"""Filters, projections, set operations, ordering and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import as_col


def filter_in_list(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """PF1: literal list, so the filter reaches the scan."""
    return df.where(F.col(c).isin(*values))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. ``df`` is counted, so
    it should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def semi_join_membership(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``members``. The key set is made distinct first, so a key with many
    copies on the member side moves once."""
    return df.join(members.select(*on).distinct(), list(on), "left_semi")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF2."""
    return df.select(*cols)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """PF3."""
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF4."""
    return df.drop(*cols)


def filter_time_range(df: DataFrame, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """PF5: inclusive bounds; either may be missing."""
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) <= end)
    return df


def drop_null_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF6: drop a row that has a null, or a NaN, in any listed column.

    One condition per column, not one over all of them: Spark derives further conditions from each
    for every renamed column it mentions, and their number doubles with each name in one condition.
    """
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    for c in dict.fromkeys(cols):
        df = df.where(F.col(c).isNotNull())
        if c in floats:
            df = df.where(~F.isnan(c))
    return df


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF7: per column the number of nulls and the share of known values in percent."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("n_rows"), *[F.count(c).alias(c) for c in cols])
    known = F.col("n_known")
    return (
        wide.unpivot("n_rows", list(cols), "column_name", "n_known")
        .select(
            "column_name",
            "n_rows",
            (F.col("n_rows") - known).alias("n_null"),
            F.when(F.col("n_rows") > 0, known * 100.0 / F.col("n_rows")).alias("coverage_pct"),
        )
    )


def null_sample(df: DataFrame, c: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """PF7: the first rows whose ``c`` is unknown."""
    return df.where(F.col(c).isNull()).orderBy(*order).limit(n)


def tag_constant(df: DataFrame, name: str, value) -> DataFrame:
    """PF8."""
    return df.withColumn(name, F.lit(value))


def same_calendar_date(targets: DataFrame, history: DataFrame, key: str = "region", date: str = "date") -> DataFrame:
    """PF12: history rows on the month and day of a target date in an earlier year.

    ``targets`` has one row per (key, date); its date comes out as ``target_date``.
    """
    t = targets.select(
        key,
        F.col(date).alias("target_date"),
        F.month(date).alias("_m"),
        F.dayofmonth(date).alias("_d"),
    )
    h = history.withColumns({"_m": F.month(date), "_d": F.dayofmonth(date)})
    return h.join(t, [key, "_m", "_d"]).where(F.year(date) < F.year("target_date")).drop("_m", "_d")


def calendar_date_history(
    targets: DataFrame, history: DataFrame, value: str, key: str = "region", date: str = "date"
) -> DataFrame:
    """PF12 by prefix: per target the count, mean, least and greatest ``value`` and the latest date of the
    history rows that :func:`same_calendar_date` pairs it with, without the pairs.

    History shrinks to one row per (key, date) before the exchange; ordered running aggregates over the
    years of a (key, month, day) follow, a window of one row per year. A target meets the row of the last
    year before its own: the targets are merged into the same window as rows without values, so size stays
    linear. Targets without any history have count 0 and nulls. Null values are not counted; null dates
    match nothing.
    """
    months = [F.month(date).alias("_m"), F.dayofmonth(date).alias("_d"), F.year(date).alias("_y")]
    v = F.col(value).cast("double")
    days = history.where(F.col(date).isNotNull() & F.col(key).isNotNull()).groupBy(key, date).agg(
        F.count(v).alias("_n"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("_n", "bigint"), ("_s", "double"), ("_lo", "double"), ("_hi", "double"))]
    wanted = targets.select(key, F.col(date)).distinct().select(key, date, *months, *blank, F.lit(True).alias("_t"))
    rows = days.select(key, date, *months, "_n", "_s", "_lo", "_hi", F.lit(False).alias("_t")).unionByName(wanted)
    past = Window.partitionBy(key, "_m", "_d").orderBy("_y").rangeBetween(Window.unboundedPreceding, -1)
    n, total = F.coalesce(F.sum("_n").over(past), F.lit(0)), F.sum("_s").over(past)
    return rows.select(
        key, F.col(date).alias("target_date"), n.alias("n"), F.when(n > 0, total / n).alias("mean"),
        F.min("_lo").over(past).alias("least"), F.max("_hi").over(past).alias("greatest"),
        F.max(F.when(~F.col("_t"), F.col(date))).over(past).alias("latest"), "_t",
    ).where("_t").drop("_t")


def min_rows_guard(
    train: DataFrame, test: DataFrame, key: str = "region", min_train: int = 100, min_test: int = 1
) -> DataFrame:
    """PF13: keys with enough rows on both sides; use it with :func:`semi_join_membership`.

    Counts instead of a window: a large key is counted where its rows are.
    """
    def enough(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select(key)

    return enough(train, min_train).join(enough(test, min_test), key, "left_semi")


def union_batches(batches: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), batches)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U2."""
    return df.select(*cols).distinct()


def sorted_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SO5."""
    return distinct_values(df, cols).orderBy(*cols)


def sort_multi(df: DataFrame, cols: Sequence[str], global_order: bool = True) -> DataFrame:
    """SO1: total order, or only within each partition when that is enough for a writer."""
    return df.orderBy(*cols) if global_order else df.sortWithinPartitions(*cols)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """SO2: first ``k`` rows per group. ``order`` must be total, so ties are decided by it.

    Spark turns the rank filter into a group limit ahead of the exchange, so each task sends at most
    ``k`` rows per group, however large the group is.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; a null key is a key of its own."""
    return top_k_per_group(df, keys, order, 1)


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, after and removed, from one count per key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count(F.lit(1)).alias("n_after")
    ).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def best_method(results: DataFrame, metric: str, method: str = "method", ascending: bool = True) -> DataFrame:
    """SO3: the winner; a tie goes to the first name."""
    m = F.col(metric)
    return results.orderBy(m.asc_nulls_last() if ascending else m.desc_nulls_last(), method).limit(1)


def head_sample(df: DataFrame, order: Sequence[Column | str], n: int = 10) -> DataFrame:
    """SO4: the first ``n`` rows in ``order`` (a top-k, no full sort)."""
    return df.orderBy(*[as_col(c) for c in order]).limit(n)
