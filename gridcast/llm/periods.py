"""Periodic runs of words, found by dyadic catchers of squares.

The words of a text are appended one by one. Whenever a block of 2**j words [x, x + B), x a multiple of
B = 2**j, is complete, it becomes a catcher for the periods B <= p < 2 B. Every word appended later ends one
suffix of length B for each j; the suffix that starts at y meets the one catcher whose distance p = y - x
lies in that range. If both agree, the catcher has caught a square of period p, or the start of one. Squares
of one period on neighbouring blocks merge; the ends of a merged chain are less than B words away and are
found by halving. A run of period p and at least 3 p words holds a whole block and its copy, so none is
missed. All suffixes of a level are compared at once, for many texts, in arrays.

Suffixes are compared by hashes, which can agree by accident but never differ for equal words. The words of
every run that is reported are compared themselves, and a text that fails is hashed anew: running sums modulo
2**64 take some regular texts of two words for equal, those modulo primes do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.common import pick, utf8

LEAST_WORDS, LEAST_PERIODS = 24, 3
_MUL = 0xC2B2AE3D27D4EB4F
#: Primes and multipliers of the second kind of hash, for texts whose runs fail the comparison.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253))

Run = tuple[int, int, int]


class _Sums:
    """Hash of any stretch of words from running sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        up, self.down = (x[: len(words) + 1] for x in W._powers(_MUL, len(words) + 1))
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.down[start]

    def agree(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words, up to `limit`, agree with those `period` later: from `at` on (step 1), or
        before `at` (step -1)."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            start = at if step > 0 else at - mid
            same = self.of(start, mid) == self.of(start + period, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


class _PrimeSums(_Sums):
    """The same modulo two primes below 2**31, side by side in one number."""

    def __init__(self, words: np.ndarray):
        self.parts = []
        for prime, mul in _PRIMES:
            p = np.uint64(prime)
            up, down = (_prime_powers(m, prime, len(words) + 1) for m in (mul, pow(mul, -1, prime)))
            total = np.zeros(len(words) + 1, np.uint64)
            # Fewer than 2**33 terms below 2**31 fit into the sum.
            np.cumsum(words % p * up[: len(words)] % p, out=total[1:])
            self.parts.append((p, total % p, down))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        a, b = ((total[start + size] + p - total[start]) % p * down[start] % p for p, total, down in self.parts)
        return a << np.uint64(32) | b


def _prime_powers(mul: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(mul, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def caught_runs(
    words: np.ndarray, offsets: np.ndarray, least_words: int, least_periods: int, kind: type[_Sums] = _Sums
) -> list[list[Run]]:
    """Per text the runs (start, length, period) by start, then period. words: hashes of the words of all
    texts, text k at offsets[k] to offsets[k + 1]."""
    sizes = np.diff(offsets)
    out: list[list[Run]] = [[] for _ in sizes]
    text = np.repeat(np.arange(len(sizes)), sizes)
    y = np.flatnonzero(sizes[text] >= least_words)
    if not len(y):
        return out
    sums = kind(words)
    found: list[np.ndarray] = []
    known_from = known_to = np.zeros(0, np.int64)
    block = 1
    while len(y := y[sizes[text[y]] >= least_periods * block]):
        start, end = offsets[text[y]], offsets[text[y] + 1]
        ends = y[(y - start >= block) & (y + block <= end)]
        first = offsets[text[ends]]
        x = first + ((ends - first) // block - 1) * block
        same = sums.of(ends, block) == sums.of(x, block)
        at, x = ends[same], x[same]
        if len(known_from) and len(x):
            # Inside a run of a smaller period there are only multiples of that period.
            j = np.searchsorted(known_from, x, side="right") - 1
            new = (j < 0) | (known_to[np.maximum(j, 0)] < at + block)
            at, x = at[new], x[new]
        if len(x):
            runs = _merged(sums, x, at - x, block, text, offsets)
            runs = runs[runs[:, 1] - runs[:, 0] >= least_periods * runs[:, 2]]
            lengths = runs[:, 1] - runs[:, 0]
            found.append(runs[lengths >= least_words])
            # Only what holds two blocks of the next level can hide a square there.
            wide = runs[lengths >= 4 * block]
            if len(wide):
                a, b = np.concatenate([known_from, wide[:, 0]]), np.concatenate([known_to, wide[:, 1]])
                order = np.argsort(a, kind="stable")
                known_from, known_to = a[order], np.maximum.accumulate(b[order])
        block *= 2
    if found:
        runs = np.concatenate(found)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        # One stretch has one smallest period; longer ones are its multiples.
        runs = runs[np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)]] if len(runs) else runs
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        owner = text[runs[:, 0]] if len(runs) else runs[:, 0]
        for k, (a, b, p) in zip(owner.tolist(), runs.tolist(), strict=True):
            out[k].append((a - int(offsets[k]), b - a, p))
    return out


def _merged(sums: _Sums, x: np.ndarray, period: np.ndarray, block: int, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Squares on neighbouring blocks as one stretch [from, to) with its period, as wide as it goes."""
    order = np.lexsort((x, period))
    x, period = x[order], period[order]
    owner = text[x]
    apart = (np.diff(period) != 0) | (np.diff(x) != block) | (np.diff(owner) != 0)
    heads, tails = np.flatnonzero(np.r_[True, apart]), np.flatnonzero(np.r_[apart, True])
    lo, hi, p, own = x[heads], x[tails] + block, period[heads], owner[heads]
    lo = lo - sums.agree(lo, p, np.minimum(lo - offsets[own], block - 1), -1)
    hi = hi + sums.agree(hi, p, np.minimum(offsets[own + 1] - hi - p, block - 1), 1)
    return np.stack([lo, hi + p, p], axis=1)


def _sound(words: list[bytes], runs: list[Run]) -> bool:
    return all(words[a : a + n - p] == words[a + p : a + n] for a, n, p in runs)


def text_runs(
    texts: list[bytes | None], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and verified runs of each text, in order."""
    for chunk in W.chunks(texts):
        runs = caught_runs(W.word_hashes(chunk), chunk.offsets, least_words, least_periods)
        for k, found in enumerate(runs):
            own = (texts[chunk.first + k] or b"").split()
            if not _sound(own, found):
                lo, hi = chunk.offsets[k], chunk.offsets[k + 1]
                again = W.word_hashes(chunk, 1)[lo:hi]
                (found,) = caught_runs(again, np.array([0, hi - lo]), least_words, least_periods, _PrimeSums)
                if not _sound(own, found):
                    raise ValueError("two kinds of hashes collide in one text")
            yield own, found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds beyond its first period."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((a + p, a + n) for a, n, p in runs):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    return b" ".join(kept + words[at:])


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def find_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row.

    A run is a stretch of words with smallest period q (words q apart are equal), of at least `least_words`
    and `least_periods` * q words (`least_periods` is 3 or more), that neither neighbour extends. runs are
    ordered by start, then period; word numbers count from 0. collapsed is the text, UTF-8, of the words
    that no run holds beyond its first q, joined by one space. Words lie between white space (space,
    0x09-0x0D). A null or empty text has no words and no runs; each row stands for itself, so repeated rows
    and null ids come back as they are; an empty table gives no rows; other columns are not looked at.
    No shuffle; a task holds one batch of texts and arrays of a few numbers per word of one chunk.
    """
    if least_periods < 3:
        raise ValueError("a run needs three periods at least: with fewer it may hold no whole block")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, id_col, text_col).select(F.col(id_col), utf8(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            part: list[tuple[int, list[Run], bytes]] = []
            size = 0
            for own, found in text_runs(batch.column(1).to_pylist(), least_words, least_periods):
                part.append((len(own), found, collapsed(own, found)))
                size += len(part[-1][2])
                if size > W.CHUNK_BYTES:
                    yield _out(ids.slice(at, len(part)), part)
                    at, part, size = at + len(part), [], 0
            if part:
                yield _out(ids.slice(at, len(part)), part)

    def _out(ids, part):
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in p[1]] for p in part]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([p[0] for p in part], pa.int64()), pa.array(runs, _RUN_TYPE), pa.array([p[2] for p in part], pa.binary())],
            names=[id_col, "n_words", "runs", "collapsed"],
        )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs {RUNS}, collapsed binary")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length in periods, then smallest start, then smallest period; else null."""

    def order(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (
            F.when(left != right, F.when(left > right, -1).otherwise(1))
            .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1))
            .otherwise(0)
        )

    return F.get(F.array_sort(runs, order), F.lit(0))
