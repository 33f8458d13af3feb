"""Benchmark decontamination: test windows as a broadcast hash set, documents scanned once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.common import pick, staged, utf8

WINDOW = 13
#: A document is contaminated if at least 1 / SHARE of its words are hit.
SHARE = 20
#: Bytes of benchmark text that one broadcast may hold; more is scanned slice by slice.
SLICE_BYTES = 8 << 20


@dataclass
class Index:
    """Windows of a slice of the benchmark: per window length the sorted hashes, and for each hash the
    windows' words with the items that hold them."""

    hashes: dict[int, np.ndarray]
    held: dict[tuple[int, int], list[tuple[bytes, list[str]]]]
    sieve: dict[int, np.ndarray]


def build_index(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Index:
    """items: id as text (null: hits count, but no item is listed) and text."""
    held: dict[tuple[int, int], dict[bytes, set[str]]] = {}
    for name, text in items:
        for chunk in W.chunks([text], alnum=True):
            ws = chunk.words(0, len(chunk.starts))
            size = min(window, len(ws))
            if size:
                for i, h in enumerate(W.window_hashes(W.word_hashes(chunk), size).tolist()):
                    ids = held.setdefault((size, h), {}).setdefault(b" ".join(ws[i : i + size]), set())
                    if name is not None:
                        ids.add(name)
    hashes = {}
    for size in sorted({k[0] for k in held}):
        hashes[size] = np.sort(np.array([h for s, h in held if s == size], np.uint64))
    sieve = {}
    for size, values in hashes.items():
        sieve[size] = np.zeros(1 << 20, bool)
        sieve[size][(values >> np.uint64(44)).astype(np.int64)] = True
    return Index(hashes, {k: [(w, sorted(i)) for w, i in v.items()] for k, v in held.items()}, sieve)


def scan(texts: list[bytes | None], index: Index) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: words, verified hit spans [from, to) in words (overlapping ones joined), item ids."""
    out = []
    for chunk in W.chunks(texts, alnum=True):
        n_texts = len(chunk.offsets) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
        items: list[set[str]] = [set() for _ in range(n_texts)]
        hashed = W.word_hashes(chunk)
        for size, known in index.hashes.items():
            found = W.window_hashes(hashed, size)
            maybe = np.flatnonzero(index.sieve[size][(found >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[np.isin(found[maybe], known)]
            owner = np.searchsorted(chunk.offsets, maybe, side="right") - 1
            maybe, owner = (x[maybe + size <= chunk.offsets[owner + 1]] for x in (maybe, owner))
            for at, k in zip(maybe.tolist(), owner.tolist(), strict=True):
                seen = b" ".join(chunk.words(at, at + size))
                for ws, ids in index.held[size, int(found[at])]:
                    if ws == seen:
                        spans[k].append((at, at + size))
                        items[k].update(ids)
        for k in range(n_texts):
            base = int(chunk.offsets[k])
            out.append((int(chunk.offsets[k + 1]) - base, merge((a - base, b - base) for a, b in spans[k]), items[k]))
    return out


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def strip(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the bytes from the first to the last word of each span."""
    data = text.encode()
    (chunk,) = W.chunks([data], alnum=True)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : chunk.starts[a]])
        at = int(chunk.ends[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


FOUND = "n_words bigint, hits array<struct<lo: int, hi: int>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All columns of docs, and n_words, hits (word spans [lo, hi) that lie in an occurrence of a benchmark
    window, joined where they overlap or touch), items (ids of the items found, sorted as text).

    docs needs text, benchmark item_id and text. A null or empty text has no words and no hits; an item
    without words has no window, an item shorter than a window is one window; items with a null id give
    hits but are not listed; repeated rows each come back; an empty table gives no rows or no hits.
    A column of docs with the name of a result column is replaced by it.

    The benchmark is measured first and cut into slices of at most about slice_bytes of text by a hash of
    each row; a slice is what one broadcast holds. One slice is the rule; with more, the documents are
    scanned once per slice and the spans found so far travel along in staged tables.
    """
    spark = docs.sparkSession
    bench = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("id"), utf8("text").alias("text"))
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-2 * size // slice_bytes)) if size > slice_bytes else 1
    bench = bench.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(slices)))
    new = [c.split()[0] for c in ("n_words", "hits", "items")]
    kept = [i for i, n in enumerate(docs.columns) if n not in new]
    names = [docs.columns[i] for i in kept]
    at = names.index("text")
    plain = [f"_in{i}" for i in kept]
    rows = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))]).select(plain)
    for k in range(slices):
        part = [(r.id, bytes(r.text)) for r in bench.where(F.col("slice") == k).select("id", "text").distinct().collect()]
        rows = _scanned(rows, plain, at, spark.sparkContext.broadcast(build_index(part, window)), k == 0)
        if k < slices - 1:
            rows = staged(rows, "decontamination-slice")
    return rows.toDF(*names, *new)


def _scanned(rows: DataFrame, plain: list[str], at: int, index, first: bool) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in plain)
    hit_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = scan(batch.column(at).cast(pa.binary()).to_pylist(), index.value)
            hits, items = [f[1] for f in found], [f[2] for f in found]
            if not first:
                before = batch.column(len(plain) + 1).to_pylist()
                hits = [merge([*h, *((x["lo"], x["hi"]) for x in b)]) for h, b in zip(hits, before, strict=True)]
                items = [i | set(b) for i, b in zip(items, batch.column(len(plain) + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(plain)],
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in h] for h in hits], hit_type),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                names=[*plain, "n_words", "hits", "items"],
            )

    return rows.mapInArrow(run, f"{kinds}, {FOUND}")


def hit_words(hits: str = "hits"):
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + h["hi"] - h["lo"])


def contaminated(share: int = SHARE):
    n_hit = hit_words()
    return (n_hit > 0) & (share * n_hit >= F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Rows of docs that are not contaminated, with their columns as they are."""
    found = find_contamination(_plain(docs), benchmark, window)
    return found.where(~contaminated(share)).drop("n_words", "hits", "items").toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of docs, the hit words cut out of text (null stays null)."""
    found = find_contamination(_plain(docs), benchmark, window)
    kinds = found.schema["text"].dataType.simpleString()

    @F.udf(kinds)
    def cut(text, hits):
        return strip(text, [(h["lo"], h["hi"]) for h in hits]) if hits and text is not None else text

    return found.withColumn("text", cut("text", "hits")).drop("n_words", "hits", "items").toDF(*docs.columns)


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names, but for text, that clash with nothing."""
    at = docs.columns.index("text")
    return docs.toDF(*["text" if i == at else f"_kept{i}" for i in range(len(docs.columns))])
