"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import per_batch, pick, staged, utf8
from gridcast.llm.labelled import fold, with_label

FEATURES = 192
RIDGE = 1e-3
#: Part of the training rows that calibrates: one fold of this many.
CALIBRATION = 4
BINS = 1024
SEED = 7

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT), (b" \t\n\r\x0b\x0c", _SPACE), (b".,;:'\"?-()", _MARK)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = _HIGH
STATISTICS = 20


def statistics(text: bytes) -> list[float]:
    """Facts about a text, none of which depends on its language's words: sizes, shares of character
    classes, repetition of words, pairs and lines, ends of sentences. All are 0 for an empty text."""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0] * STATISTICS
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / n
    sizes = np.fromiter(map(len, words), np.int32, m)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = sum(w[-1] in b".!?" for w in words)
    odd_ends = sum(_CLASS[w[-1]] == _SYMBOL for w in words)
    alone = sum(len(w) == 1 and _CLASS[w[0]] in (_SYMBOL, _MARK) for w in words)
    return [
        np.log1p(n), np.log1p(m), *kinds.tolist(),
        float(sizes.mean()), float(sizes.std()), np.log1p(int(sizes.max())),
        len(counts) / m, max(counts.values()) / m, same / m, pairs / max(m - 1, 1),
        len(set(lines)) / len(lines), ends / m, odd_ends / m, alone / m,
    ]


@dataclass
class Model:
    """Standardisation, random features, ridge weights (last: constant), calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        wave = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.hstack([wave, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of STATISTICS doubles) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return per_batch(rows, f"doc_id {kind}, x array<double>", make)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Fit on all rows of train (doc_id, x, label); None without rows.

    Every task sums its normal equations into one matrix; Spark adds the matrices entry by entry, and
    the driver gets (features + 1) x (features + 2) sums whatever the number of rows. A quarter of the
    rows does not enter the equations and calibrates instead: their scores are counted in bins of
    1 / BINS and the bins' label shares are made monotone by pooling neighbours.
    """
    sums = [F.count(F.lit(1))]
    sums += [f(F.get("x", F.lit(i))) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    n, *moments = train.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    if not n:
        return None
    mean, scale = np.array(moments[::2], float), np.array(moments[1::2], float)
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, features))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))

    folds = train.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CALIBRATION)))

    def normal(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            total += z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
        size = total.shape[1]
        for i, row in enumerate(total):
            arrays = [pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(row)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "v"])

    sums = folds.where("part > 0").select("x", "label").mapInArrow(normal, "i int, j int, v double")
    held = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    table = np.zeros((features + 1, features + 2))
    table[held["i"].to_numpy(), held["j"].to_numpy()] = held["v"].to_numpy()
    gram, target = table[:, :-1], table[:, -1]
    penalty = np.eye(features + 1) * (ridge * max(gram[-1, -1], 1.0) + 1e-9)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, target)

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = np.floor(np.clip(model.raw(_matrix(batch.column(0))), -1, 2) * BINS).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], names=["bin", "label"])

    counted = per_batch(folds.where("part = 0").select("x", "label"), "bin int, label double", bins)
    counted = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("bin").toArrow()
    if len(counted):
        model.knots = isotonic(*(counted[c].to_numpy().astype(float) for c in ("bin", "n", "ones")))
    return model


def isotonic(bins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing curve: neighbouring bins are pooled while their shares fall. The curve
    is straight between the middles of pools. Half a row of either label at the ends keeps pure pools
    off 0 and 1, in proportion to their rows."""
    pools: list[list[float]] = []
    for b, k, s in zip((bins + 0.5) / BINS, n, ones, strict=True):
        pools.append([b * k, k, s])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], last, strict=True)]
    at = np.array([p[0] / p[1] for p in pools])
    share = np.array([(p[2] + 0.5 * p[2] / p[1] + 0.05) / (p[1] + 0.5 * p[2] / p[1] + 0.5 * (1 - p[2] / p[1]) + 0.1) for p in pools])
    return at, np.maximum.accumulate(share)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Labels of rows whose CRC-32 fold is `held_out` are never learned. Null and empty texts are scored from
    statistics that are all 0; repeated rows each come back; without any label the score is 0.5; labels
    of unknown documents are ignored; other columns are not looked at.
    """
    rows = staged(document_statistics(docs), "quality-statistics")
    out = fold("doc_id", folds) == held_out
    model = fit(staged(with_label(rows.where(~out), labels, "quality"), "quality-train"))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    done = per_batch(rows, f"doc_id {kind}, score double", scored)
    return done.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
