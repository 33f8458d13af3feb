"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridcast.llm.common import pick

#: Vectors whose sorted lists one task holds, and queries that meet them in one task.
BLOCK, QUERIES = 8192, 8192
SCALE = 1024


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component. Vectors that are null or hold null, infinite or
    not-a-number components take no part, nor do rows without an id."""
    rows = pick(rows, id_col, vector_col).toDF("vec_id", "v")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


class SortedLists:
    """Vectors of a block with, for every dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.floats, self.largest = self.vectors.astype(float), _largest(vectors)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products with some of the vectors: in floating point only where every sum stays below
        2 ** 53, so that it is exact."""
        if self.largest * _largest(query) * len(query) < 1 << 53:
            return (self.floats[rows] @ query.astype(float)).astype(np.int64)
        return self.vectors[rows] @ query

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best, without the query itself.

        The lists of all dimensions with a non-zero weight are read in step, from the high end for a
        positive weight and from the low end for a negative one. What was not seen yet scores at most the
        sum of weight times component at the depth reached; the search stops when that is below the kth
        score (at a tie an unseen vector with a smaller id could still win), or when all were seen.
        """
        n = len(self.ids)
        high, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        depth, step = 0, 4 * k
        while depth < n and not seen.all():
            end = min(n, depth + step)
            reached = np.full(n, not len(high) and not len(low))
            reached[self.lists[n - end : n - depth, high]] = True
            reached[self.lists[depth:end, low]] = True
            new = np.flatnonzero(reached & ~seen)
            seen |= reached
            depth = end
            step *= 2
            scores = self.scores(new, query)
            mine = self.ids[new] != own
            best = _best([*best, *_first(scores[mine], self.ids[new][mine], k)], k)
            if len(best) == k:
                bound = sum(
                    int(self.vectors[self.lists[at, dims], dims] @ query[dims])
                    for at, dims in ((n - depth, high), (depth - 1, low))
                )
                if bound < best[-1][0]:
                    break
        return best


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(scores[order].tolist(), ids[order].tolist(), strict=True))


def _best(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all vectors but its own id.

    vectors and queries: vec_id (long) and v (array of long). Ties go to the smaller vec_id. Vectors of
    different length meet on their common components, an empty one scores 0. Of rows with one vec_id
    the smallest vector counts. No queries or no vectors give no rows; fewer than k others give fewer.

    Vectors are dealt into blocks of about `block` by id, and queries into blocks of about
    `query_block`; each pair of blocks is one bounded group, found by the threshold algorithm, and the
    k best of all blocks are merged per query.
    """
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))

    def number(seed: int, blocks: int):
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(blocks)).cast("int")

    def copies(count: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    left = vectors.select("vec_id", "v", number(1, blocks).alias("b"), copies(query_blocks, "q"))
    right = queries.select("vec_id", "v", number(2, query_blocks).alias("q"), copies(blocks, "b"))

    def search(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vs) and len(qs):
            width = max(map(len, [*vs["v"], *qs["v"]]))
            ids, rows = _matrix(vs, width)
            lists = SortedLists(ids, rows)
            for own, q in zip(*_matrix(qs, width), strict=True):
                out += [(int(own), i, s) for s, i in lists.top(q, int(own), k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors, one row per id, short vectors filled with zeros."""
    held: dict[int, tuple[int, ...]] = {}
    for i, v in zip(rows["vec_id"].tolist(), rows["v"], strict=True):
        v = tuple(np.asarray(v, np.int64).tolist())
        held[i] = min(held.get(i, v), v)
    out = np.zeros((len(held), max(width, 1)), np.int64)
    for row, v in zip(out, held.values(), strict=True):
        row[: len(v)] = v
    return np.array(list(held), np.int64), out
