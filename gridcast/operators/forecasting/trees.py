"""Tree ensembles of many zones in one job.

A zone of up to ``LOCAL_ROWS`` rows is fitted by tasks that hold its rows, all zones at once; forests are
dealt out further, a block of trees to a task. Larger zones are not gathered: `regional` hands them to
Spark's own distributed trees. A fitted ensemble is a table with one row per zone and tree, and scoring
brings that table to bounded parts of a zone's rows, so neither passes through the driver.

Trees are grown level by level. Feature values are replaced by the number of their bin; one
count over the cells (node, feature, bin) and its running sums give all splits of all nodes of the level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.operators.forecasting.methods import BINS, Method
from gridcast.operators.relational import broadcast_if_small

#: Rows of a zone that one task may hold while it fits, and rows that one task scores together.
LOCAL_ROWS = 100_000
SCORE_ROWS = 200_000
#: Sums held at once while a level is searched for splits.
_CELLS = 2_000_000

TREE = "tree int, base double, scale double, feature array<int>, threshold array<double>, child array<int>, value array<double>, error string"


@dataclass
class Binned:
    """Columns as cells, the bins of all features end to end; a value goes left at cut b if its bin is at most b.

    cells: (feature, row); first: a feature's first cell; feature: that of each cell; size: number of cells.
    """

    cells: np.ndarray
    cuts: list[np.ndarray]
    first: np.ndarray
    feature: np.ndarray
    size: int


def binned(x: np.ndarray, bins: int = BINS) -> Binned:
    codes, cuts = [], []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            ranks = np.sort(column)[np.linspace(0, len(column) - 1, bins + 1).astype(np.int64)[1:-1]]
            at = np.unique(np.searchsorted(values, ranks))
            at = at[at < len(values) - 1]
        else:
            at = np.arange(len(values) - 1)
        cuts.append((values[at] + values[at + 1]) / 2)
        codes.append(np.searchsorted(cuts[-1], column, side="left"))
    bins = np.array([len(c) + 1 for c in cuts])
    first = np.cumsum(bins) - bins
    return Binned(np.stack(codes) + first[:, None], cuts, first, np.repeat(np.arange(len(bins)), bins), int(bins.sum()))


def grow(
    data: Binned, count: np.ndarray, weight: np.ndarray, slope: np.ndarray, depth: int, min_leaf: int,
    penalty: float = 0.0, subset: int | None = None, rng: np.random.Generator | None = None,
):
    """One tree over the rows with a count, and the leaf of each of them.

    A leaf's value is sum(slope) / (sum(weight) + penalty); splits raise the sum of slope**2 over the same
    denominator the most, first feature and lowest cut at a tie, and leave `min_leaf` rows on both sides.
    For targets y with slope = weight * y this is the least-squares tree, and for classes 0 and 1 the Gini
    tree. Returns feature (-1 in leaves), threshold, child (left one; the right one follows) and value.
    """
    if min_leaf < 1:
        raise ValueError("a leaf needs a row at least")
    leaf = np.full(len(count), -1, np.int64)
    rows = np.flatnonzero(count > 0)
    at = np.zeros(len(rows), np.int64)
    feature, threshold, child, value = [], [], [], []
    done, width = 0, 1
    for level in range(depth + 1):
        own = tuple(v[rows] for v in (count, weight, slope))
        totals = tuple(np.bincount(at, v, width) for v in own)
        which, cut = np.full(width, -1, np.int64), np.zeros(width, np.int64)
        if level < depth:
            allowed = None
            if subset is not None and subset < len(data.cuts):
                allowed = rng.random((width, len(data.cuts))).argsort(axis=1).argsort(axis=1) < subset
            step = max(1, _CELLS // data.size)
            for lo in range(0, width, step):
                some = slice(lo, min(lo + step, width))
                a, b = np.searchsorted(at, [some.start, some.stop])
                which[some], cut[some] = _best_splits(
                    data, data.cells[:, rows[a:b]], at[a:b] - lo, tuple(v[a:b] for v in own),
                    tuple(t[some] for t in totals), min_leaf, penalty, None if allowed is None else allowed[some],
                )
        split = which >= 0
        below = 2 * (np.cumsum(split) - split)
        feature.append(which)
        threshold.append(np.array([data.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(which.tolist(), cut.tolist(), strict=True)]))
        child.append(np.where(split, done + width + below, -1))
        value.append(totals[2] / np.maximum(totals[1] + penalty, 1e-300))
        stays = ~split[at]
        leaf[rows[stays]] = done + at[stays]
        rows, at = rows[~stays], at[~stays]
        if not len(rows):
            break
        f = which[at]
        at = below[at] + (data.cells[f, rows] - data.first[f] > cut[at])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        done += width
        width = 2 * int(split.sum())
    return tuple(np.concatenate(v) for v in (feature, threshold, child, value)), leaf


def _best_splits(data, cells, at, columns, totals, min_leaf, penalty, allowed):
    """Best feature (-1: none) and bin of each node, from the sums over the cells (node, feature, bin)."""
    width = len(totals[0])
    place = (cells + at * data.size).ravel()
    sums = [np.bincount(place, np.tile(v, len(cells)), width * data.size).reshape(width, data.size) for v in columns]
    filled = sums[0] > 0
    for h, t in zip(sums, totals, strict=True):
        # Each feature's cells add up to the node's total, so running sums begin anew with each feature.
        h[:, data.first[1:]] -= t[:, None]
        np.cumsum(h, axis=1, out=h)
    which, cut = np.full(width, -1, np.int64), np.zeros(width, np.int64)
    # Counts are whole numbers; the half is for rounding.
    node, cell = np.nonzero(filled & (sums[0] > min_leaf - 0.5) & (sums[0] < totals[0][:, None] - min_leaf + 0.5))
    if allowed is not None:
        fits = allowed[node, data.feature[cell]]
        node, cell = node[fits], cell[fits]
    if not len(node):
        return which, cut
    wl, sl = sums[1][node, cell], sums[2][node, cell]
    w, s = totals[1][node], totals[2][node]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(sl**2 / (wl + penalty) + (s - sl) ** 2 / (w - wl + penalty), nan=-1.0)
        # A gain below rounding is no gain.
        least = np.nan_to_num(totals[2] ** 2 / (totals[1] + penalty)) * (1 + 1e-10) + 1e-10
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.zeros(width)
    top[node[heads]] = np.maximum.reduceat(gain, heads)
    # The first cell of the highest gain, if it is one.
    hit = np.flatnonzero(gain >= np.where(top > least, top * (1 - 1e-10), np.inf)[node])
    if len(hit):
        hit = hit[np.r_[True, node[hit][1:] != node[hit][:-1]]]
        which[node[hit]] = data.feature[cell[hit]]
        cut[node[hit]] = cell[hit] - data.first[which[node[hit]]]
    return which, cut


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -700, 700)))


def ensemble(x: np.ndarray, y: np.ndarray, weight: np.ndarray, method: Method, trees: range):
    """(tree, base, scale, arrays) of the given trees of a forest, or of a whole boosted ensemble."""
    # The order of rows must not matter, so that a fit is the same wherever its rows were.
    order = np.lexsort((weight, y, *x.T[::-1]))
    x, y, weight = x[order], y[order], weight[order]
    # Equal rows are one row that counts several times; overlapping label windows have many.
    first = np.flatnonzero(np.r_[True, (np.diff(x, axis=0) != 0).any(axis=1) | (np.diff(y) != 0) | (np.diff(weight) != 0)])
    drawn, times = len(y), np.diff(np.r_[first, len(y)]).astype(float)
    x, y, weight = x[first], y[first], weight[first]
    data = binned(x)
    if method.kind.startswith("rf"):
        # Deviations from the mean keep the sums exact where loads are large.
        mean = 0.0 if method.classifier else float(np.average(y, weights=weight * times))
        subset = int(np.ceil(np.sqrt(x.shape[1]))) if method.classifier else None
        for t in trees:
            rng = np.random.default_rng([method.seed, t])
            count = times
            if method.bootstrap:
                count = np.add.reduceat(np.bincount(rng.integers(0, drawn, drawn), minlength=drawn), first).astype(float)
            w = count * weight
            yield t, mean, 1.0 / method.trees, grow(data, count, w, w * (y - mean), method.depth, method.min_leaf, 0.0, subset, rng)[0]
        return
    weight = weight * times
    mean = float(np.average(y, weights=weight))
    if method.classifier:
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        mean = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), mean)
    for t in trees:
        if method.classifier:
            p = _sigmoid(total)
            w, s = weight * p * (1 - p), weight * (y - p)
        else:
            w, s = weight, weight * (y - total)
        tree, leaf = grow(data, times, w, s, method.depth, method.min_leaf, penalty=1.0)
        total += method.step * tree[3][leaf]
        yield t, mean, method.step, tree


def fit_trees(rows: DataFrame, method: Method, features: Sequence[str], label: str, region: str = "region", weight: str | None = None) -> DataFrame:
    """The ensembles of all zones in ``rows`` (each at most ``LOCAL_ROWS`` rows): one row per zone and tree. A
    zone whose fit fails has one row with the reason in ``error``."""
    key = rows.schema[region].dataType.simpleString()
    x = rows.select(
        region, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
        F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
    )
    zones = max(1, x.select(region).distinct().count())
    slots = rows.sparkSession.sparkContext.defaultParallelism
    # The blocks of a forest do not change it; they only keep all cores at work if zones are few.
    blocks = min(method.trees, max(1, -(-2 * slots // zones))) if method.kind.startswith("rf") else 1
    per_block = -(-method.trees // blocks)
    x = x.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-method.trees // per_block) - 1))))
    # A fixed number of partitions: the rows are few bytes for Spark, but much work.
    x = x.repartition(min(2 * zones * blocks, max(200, 16 * slots)), region, "_block")
    columns = len(features)

    def fit(group: pa.Table) -> pa.Table:
        values = [group.column(1 + i).to_numpy() for i in range(columns + 2)]
        start = group.column(columns + 3)[0].as_py() * per_block
        todo = range(start, min(start + per_block, method.trees))
        out, error = [], None
        try:
            out = list(ensemble(np.column_stack(values[:-2]), *values[-2:], method, todo))
        except Exception as e:  # noqa: BLE001 - becomes a row, which the caller raises or lists
            error = f"{type(e).__name__}: {e}"
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64())
        arrays = [
            pa.array([t for t, *_ in out] or [start], pa.int32()),
            pa.array([b for _, b, _, _ in out] or [0.0]),
            pa.array([c for _, _, c, _ in out] or [0.0]),
            *[pa.array([tree[i] for *_, tree in out] or [None], pa.list_(k)) for i, k in enumerate(kinds)],
            pa.array([error] * max(1, len(out)), pa.string()),
        ]
        zone = pa.array([group.column(0)[0].as_py()] * len(arrays[0]), group.column(0).type)
        return pa.Table.from_arrays([zone, *arrays], names=[region, *[c.split()[0] for c in TREE.split(", ")]])

    return x.groupBy(region, "_block").applyInArrow(fit, f"`{region}` {key}, {TREE}")


def walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Value of the leaf of every row."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        here = at[rows]
        at[rows] = child[here] + (x[rows, f] > threshold[here])
    return value[at]


def score_trees(df: DataFrame, trees: DataFrame, features: Sequence[str], method: Method, as_name: str, region: str = "region") -> DataFrame:
    """Rows of zones that have an ensemble, with its prediction or probability. Features must be known.

    A zone's rows are cut into parts of about ``SCORE_ROWS``, and each part meets a copy of the zone's trees.
    """
    sizes = df.groupBy(region).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SCORE_ROWS)).cast("int").alias("_parts"))
    sizes = broadcast_if_small(sizes)
    rows = df.join(sizes, region).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int"))
    rows = rows.select(*df.columns, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], "_part")
    copies = trees.join(sizes, region).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copies = copies.select(region, "_part", "base", "scale", "feature", "threshold", "child", "value")
    width, columns, classes, boosted = len(df.columns), len(features), method.classifier, method.kind.startswith("gbt")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left.slice(0, 0).select(range(width)).append_column(as_name, pa.array([], pa.float64()))
        x = np.column_stack([left.column(width + i).to_numpy() for i in range(columns)])
        total = np.full(len(x), right.column(2)[0].as_py())
        parts = [right.column(i).combine_chunks() for i in range(4, 8)]
        for t in range(right.num_rows):
            arrays = [p[t].values.to_numpy(zero_copy_only=False) for p in parts]
            total += right.column(3)[t].as_py() * walk(x, *arrays)
        if classes and boosted:
            total = _sigmoid(total)
        return left.select(range(width)).append_column(as_name, pa.array(total))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{as_name}` double"])
    return rows.groupBy(region, "_part").cogroup(copies.groupBy(region, "_part")).applyInArrow(score, schema)
