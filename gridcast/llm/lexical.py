"""Ranked lexical search over an index that is stratified by length.

A term's share of a document's score depends on the term's weight, its occurrences tf and the document's
normaliser m, which is a whole number of the document's length. So all documents of equal m form a stratum,
a stratum's postings are kept by term and tf, and the impact of a tf is computed once for all documents of
the stratum that have it. The greatest tf of each term bounds what a stratum can score for an item: strata
are visited from the highest bound down, until the bound is below the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.common import per_batch, pick, staged, utf8

TOP = 20
#: Bytes of item texts that one broadcast may hold; more items are searched slice by slice.
SLICE_BYTES = 4 << 20
#: A large stratum is kept in blocks of at most so many documents.
BLOCK_DOCS = 8_192
#: Blocks are searched together, in the order of their bounds, up to so many of them or of their postings.
TOGETHER, TOGETHER_POSTINGS = 256, 2_000_000
#: One block in FIRST is visited before all others, to know a score that the best documents reach at least.
FIRST = 64

INDEX = "m bigint, block bigint, ids array<bigint>, terms array<int>, tfs array<int>, ends array<int>, docs array<int>"


def impact(tf, m):
    """Share of a term that occurs tf times in a document of normaliser m; whole numbers or arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Vocabulary:
    """Terms of a slice of items: sorted hashes, a second hash to confirm them; number of a term is its place."""

    first: np.ndarray
    second: np.ndarray

    def find(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words in the chunk and their terms."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = W.word_hashes(chunk)
        place = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        at = np.flatnonzero(self.first[place] == h)
        at = at[W.word_hashes(chunk, 1)[at] == self.second[place[at]]]
        return at, place[at]


@dataclass
class Items:
    """Items of a slice as (term, weight times repeats) lists end to end."""

    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def bounds(self, best: np.ndarray) -> np.ndarray:
        """Per item the sum over its terms of the weight times the term's best impact."""
        total = np.concatenate([[0], np.cumsum(self.weights * best[self.terms])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def vocabulary(texts: list[bytes]) -> tuple[Vocabulary, list[np.ndarray], list[np.ndarray]]:
    """All terms of the texts; per text its distinct terms and how often each occurs."""
    hashes = [[np.concatenate([W.word_hashes(c, f) for c in W.chunks([t], alnum=True)]) for f in (0, 1)] for t in texts]
    every = [np.concatenate([h[f] for h in hashes]) if hashes else np.zeros(0, np.uint64) for f in (0, 1)]
    first, at = np.unique(every[0], return_index=True)
    vocab = Vocabulary(first, every[1][at])
    counted = [np.unique(np.searchsorted(first, h[0]), return_counts=True) for h in hashes]
    return vocab, [c[0] for c in counted], [c[1] for c in counted]


def term_counts(docs: DataFrame, vocab) -> DataFrame:
    """(id, n, terms, tfs) per document: its number of terms, the known ones among them and their
    occurrences. docs: id, text (UTF-8 bytes); vocab: a broadcast Vocabulary."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batch.column(1).to_pylist(), alnum=True):
            count = len(chunk.offsets) - 1
            at, terms = vocab.value.find(chunk)
            owner = np.searchsorted(chunk.offsets, at, side="right") - 1
            pairs, tfs = np.unique(owner << 32 | terms, return_counts=True)
            ends = np.searchsorted(pairs >> 32, np.arange(count + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, v.astype(np.int32)) for v in (pairs & 0xFFFFFFFF, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, count), pa.array(np.diff(chunk.offsets), pa.int64()), *lists],
                names=["id", "n", "terms", "tfs"],
            )

    return per_batch(docs, "id bigint, n bigint, terms array<int>, tfs array<int>", make)


def build_index(counts: DataFrame, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of strata (INDEX), written once. counts: as `term_counts`, without documents of no terms.

    Documents are range-partitioned by m; a stratum of any size is spread over partitions by a hash of
    the document. A block holds documents of one m: their ids, and postings in groups of equal term and tf
    (the highest tf of a term first), each group up to its end in `docs`.
    """
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    rows = counts.select(m.cast("bigint").alias("m"), "id", "terms", "tfs", F.xxhash64("id", "n").alias("spread"))
    rows = rows.repartitionByRange("m", "spread").sortWithinPartitions("m", "spread").drop("spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, current = 0, None
        for batch in batches:
            ms, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = batch.column(2).offsets.to_numpy()
            terms, tfs = (batch.column(i).values.to_numpy() for i in (2, 3))
            at = 0
            while at < len(ms):
                if ms[at] != current or size >= block_docs:
                    if held:
                        yield _block(current, held)
                    held, size, current = [], 0, ms[at]
                to = min(at + int(np.searchsorted(ms[at:], current, side="right")), at + block_docs - size)
                lo, hi = ends[at], ends[to]
                held.append((ids[at:to], np.diff(ends[at : to + 1]), terms[lo:hi], tfs[lo:hi]))
                size, at = size + to - at, to
        if held:
            yield _block(current, held)

    return staged(rows.mapInArrow(run, INDEX), "lexical-index")


def _block(m: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
    docs = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.lexsort((docs, -tfs, terms))
    terms, tfs, docs = terms[order], tfs[order], docs[order]
    last = np.flatnonzero(np.r_[(np.diff(terms) != 0) | (np.diff(tfs) != 0), True]) if len(terms) else np.zeros(0, np.int64)
    columns = [(ids, pa.int64()), (terms[last], pa.int32()), (tfs[last], pa.int32()), (last + 1, pa.int32()), (docs, pa.int32())]
    block = int(ids.min()) ^ int(m)
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), pa.array([block], pa.int64()), *[pa.array([v], pa.list_(t)) for v, t in columns]],
        names=["m", "block", "ids", "terms", "tfs", "ends", "docs"],
    )


class _Stratum:
    """A block as it is searched: impacts by group, groups by term."""

    def __init__(self, row: list, n_terms: int):
        m, self.ids, terms, tfs, ends, self.docs = row
        kinds, which = np.unique(tfs, return_inverse=True)
        impacts = impact(kinds.astype(np.int64), int(m))[which]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        self.values = np.repeat(impacts, ends - starts)
        self.terms, head = np.unique(terms, return_index=True)
        self.starts = starts[head]
        self.ends = np.r_[self.starts[1:], len(self.docs)] if len(head) else head
        self.best = np.zeros(n_terms, np.int64)
        self.best[self.terms] = impacts[head]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.ids), np.int64)
        place = np.searchsorted(self.terms, terms)
        for k, w in zip(place.tolist(), weights.tolist(), strict=True):
            a, b = self.starts[k], self.ends[k]
            # A document occurs once among a term's postings.
            total[self.docs[a:b]] += w * self.values[a:b]
        return total


def visit(index: DataFrame, items, floor, top: int) -> DataFrame:
    """(item, id, score): for each task and item the best documents, at most `top`, with scores above 0 and at
    least the item's floor. items, floor: broadcast Items and array of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = items.value, floor.value.copy()
        n_terms = int(q.terms.max()) + 1 if len(q.terms) else 0
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in _together(batches):
            strata = [_Stratum(row, n_terms) for row in part]
            bounds = np.stack([q.bounds(s.best) for s in strata])
            for item in range(bounds.shape[1]):
                lo, hi = q.offsets[item], q.offsets[item + 1]
                for k in np.argsort(-bounds[:, item], kind="stable"):
                    if bounds[k, item] < max(least[item], 1):
                        break
                    known = strata[k].best[q.terms[lo:hi]] > 0
                    scores = strata[k].scores(q.terms[lo:hi][known], q.weights[lo:hi][known])
                    good = np.flatnonzero(scores >= max(least[item], 1))
                    if not len(good):
                        continue
                    ids, values = strata[k].ids[good], scores[good]
                    if item in best:
                        ids, values = np.concatenate([best[item][0], ids]), np.concatenate([best[item][1], values])
                    order = np.lexsort((ids, -values))[:top]
                    best[item] = ids[order], values[order]
                    if len(order) == top:
                        least[item] = max(least[item], values[order[-1]])
        for item, (ids, values) in best.items():
            numbers = [pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(numbers, names=["item", "id", "score"])

    return index.mapInArrow(run, "item int, id bigint, score bigint")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    held: list[list] = []
    postings = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(2, 7)]
        for i, m in enumerate(batch.column(0).to_pylist()):
            row = [m, *[c[i].values.to_numpy(zero_copy_only=False) for c in columns]]
            if held and (len(held) == TOGETHER or postings + len(row[-1]) > TOGETHER_POSTINGS):
                yield held
                held, postings = [], 0
            held.append(row)
            postings += len(row[-1])
    if held:
        yield held


def best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    slice_bytes: int = SLICE_BYTES,
    block_docs: int = BLOCK_DOCS,
    first: int = FIRST,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with scores above 0, equal scores by doc_id.

    Terms are runs of digits, ASCII letters (A-Z lowered) and characters beyond ASCII. Scores are whole
    numbers, see `weight` and `impact`; an item's repeated terms count as often as they occur. A null or
    empty text has no terms: such an item finds nothing, such a document is not counted; a row of docs
    without an id takes no part; each row of docs is a document and each row of items an item, repeated
    or not; empty tables give no rows; other columns are not looked at.

    The items are measured first and cut into slices of about `slice_bytes`; a slice's terms and items are
    what one broadcast holds, and an index holds every document but only the terms of its slice. One block
    in `first` is visited ahead of all: its k-th scores are a floor under the final ones, so that every
    task then returns only documents that reach it.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = pick(items, "item_id", "text").select("item_id", utf8("text").alias("text"))
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-2 * size // slice_bytes)) if size > slice_bytes else 1
    rows = pick(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("text"))
    out = None
    for k in range(slices):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        found = _search_slice(rows, [bytes(r.text) for r in part], top, block_docs, first)
        if found is not None:
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {kind}")
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out


def _search_slice(rows: DataFrame, texts: list[bytes], top: int, block_docs: int, first: int) -> DataFrame | None:
    context = rows.sparkSession.sparkContext
    vocab, terms, repeats = vocabulary(texts)
    counts = staged(term_counts(rows, context.broadcast(vocab)).where("n > 0"), "lexical-counts")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not len(vocab.first):
        return None
    # One row for each term of the slice at most.
    df = {r.term: r["count"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(n_docs, df[t]) if t in df else 0 for t in range(len(vocab.first))], np.int64)
    flat, often = (np.concatenate(x) for x in (terms, repeats))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    items = context.broadcast(Items(offsets, flat, weights[flat] * often))
    index = build_index(counts, n_docs, n_terms, block_docs)

    none = context.broadcast(np.zeros(len(texts), np.int64))
    ahead = best_of(visit(index.where(F.pmod(F.xxhash64("block"), F.lit(first)) == 0), items, none, top), top)
    floor = np.zeros(len(texts), np.int64)
    for r in ahead.where(F.col("rank") == top).collect():
        floor[r["item"]] = r["score"]
    return best_of(visit(index, items, context.broadcast(floor), top), top)
