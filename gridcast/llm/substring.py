"""Removal of repeated word passages, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridcast.llm import words as W
from gridcast.llm.common import per_batch, pick, release, staged, text_key, utf8

WINDOW = 20
#: A perfect difference cover: for any two positions some shift below the period takes both into it.
PERIOD, COVER = 13, (0, 1, 3, 9)
NULL_ID = -(1 << 63)
#: Bytes of text (or one text, if longer) that a task holds as arrays of words and hashes at a time.
SLICE_BYTES = 4 << 20


def anchor_words(window: int = WINDOW) -> int:
    """Words of an anchor: with every shift below the period it still lies in the window."""
    if window < PERIOD + 3:
        raise ValueError(f"a window needs at least {PERIOD + 3} words")
    return window - PERIOD + 1


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, tid (see `keyed`) and starts: first words of the windows that also start earlier (smaller
    doc_id, or same document and earlier start). Documents without such a window have no row.

    1. Every text is hashed at cover positions only (4 of 13); a window that occurs twice has an anchor at
       the same shift in both places. Anchors that occur once are dropped.
    2. The rest extend to the windows around them, whose 96-bit hashes are compared.
    Each task first keeps one row per anchor or window of a slice of its rows; the other rows of the slice
    are settled there and travel under keys of their own, so the most common passage sends a row per slice.
    """
    size = anchor_words(window)
    rows = keyed(docs, id_col, text_col)
    anchors = per_batch(rows, "hash bigint, ord bigint, tid bigint, pos int, settled boolean", _anchors(size))
    more = F.count(F.lit(1)).over(Window.partitionBy("hash"))
    shared = anchors.withColumn("n", more).where("settled or n > 1")
    lists = staged(shared.groupBy("ord", "tid").agg(F.collect_set("pos").alias("pos")), "substring-anchors")
    release(docs.sparkSession)

    near = packed(rows).join(lists, ["ord", "tid"])
    found = per_batch(near.select("ord", "tid", "text", "pos"), _FOUND, _windows(window))
    lowest = F.min(F.struct("ord", "start")).over(Window.partitionBy("h1", "h2"))
    later = found.withColumn("first", lowest).where("settled or first.ord != ord or first.start != start")
    out = staged(later.groupBy("ord", "tid").agg(F.collect_set("start").alias("starts")), "substring-starts")
    release(docs.sparkSession)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space, as UTF-8 bytes) of every row.

    Words lie between white space (space, 0x09-0x0D) and are taken as they are. Each word covered by a
    window of `window` words that also starts earlier goes; windows are judged on the input. A null or
    empty text has no words; a null doc_id counts as smaller than all others; rows that share a doc_id are
    parts of one document, each counted from its own start, so equal rows keep the same words; an empty
    table gives no rows; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    starts = repeated_passages(docs, window, id_col, text_col)
    rows = packed(keyed(docs, id_col, text_col)).join(starts, ["ord", "tid"], "left")

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _slices(batch, _unzipped(batch.column(1))):
            yield remove(part)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        unzip = zstandard.ZstdDecompressor().decompress
        words, removed, kept = [], [], []
        for z, s in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            ws = unzip(z).split()
            words.append(len(ws))
            gone = np.zeros(len(ws) + 1, np.int32)
            if s.is_valid:
                at = s.values.to_numpy(zero_copy_only=False)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(ws))
        arrays = [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["ord", "n_words", "n_removed", "kept"])

    done = per_batch(rows.select("ord", "text", "starts"), "ord bigint, n_words bigint, n_removed bigint, kept binary", make)
    back = F.when(F.col("ord") != NULL_ID, F.col("ord")).cast(kind)
    return done.select(back.alias("doc_id"), "n_words", "n_removed", "kept")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ord (doc_id, null as the smallest number), tid (tells rows of one id apart) and text as bytes."""
    order = F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("ord")
    return text_key(pick(docs, id_col, text_col).select(order, utf8(text_col).alias("text")), "ord").select("ord", "tid", "text")


def packed(rows: DataFrame) -> DataFrame:
    """Compress text before a shuffle; Zstandard takes about half of what the shuffle's own codec leaves."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        texts = pa.array([zip_(t) for t in batch.column(2).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["ord", "tid", "text"])

    return per_batch(rows, "ord bigint, tid bigint, text binary", make)


def _unzipped(texts: pa.Array) -> list[int]:
    """Lengths of compressed texts, from their headers."""
    return [zstandard.frame_content_size(z) for z in texts.to_pylist()]


def _slices(batch: pa.RecordBatch, sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The batch in neighbouring parts of about SLICE_BYTES by the sizes of its rows. A batch has a fixed
    number of rows, so what is built from it at once would grow with the length of the texts."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE_BYTES:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _settle(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order: rows sorted by key; same: whether a row of that order has the key of the row before.
    In the rows' own order: is the row not the first of its key, and has its key several rows."""
    later, many = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same
    many[order] = same | np.concatenate([same[1:], [False]])
    return later, many


def _salted(keys: np.ndarray, later: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Rows that are settled get a key made of themselves."""
    own = np.zeros(len(keys), np.uint64)
    for p in parts:
        own = W.mix(own ^ p.astype(np.int64).view(np.uint64))
    return np.where(later, own, keys).view(np.int64)


def _anchors(size: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def make(batch: pa.RecordBatch):
        for part in _slices(batch, pc.binary_length(batch.column(2)).to_pylist()):
            yield from anchors(part)

    def anchors(batch: pa.RecordBatch):
        ids, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held = [[], [], [], []]
        for chunk in W.chunks(batch.column(2).to_pylist()):
            total = len(chunk.starts)
            ok = W.window_starts(chunk.offsets, size, total)
            owner = chunk.text_of_word()[: len(ok)]
            pos = np.arange(len(ok)) - chunk.offsets[owner]
            at = np.flatnonzero(ok & cover[pos % PERIOD])
            held[0].append(W.window_hashes(W.word_hashes(chunk), size)[at])
            held[1].append(ids[chunk.first + owner[at]])
            held[2].append(tids[chunk.first + owner[at]])
            held[3].append(pos[at])
        hashes, ord_, tid, pos = (np.concatenate(h) for h in held)
        order = np.argsort(hashes, kind="stable")
        in_order = hashes[order]
        later, many = _settle(order, np.concatenate([[False], in_order[1:] == in_order[:-1]])[: len(order)])
        arrays = [_salted(hashes, later, ord_, tid, pos), ord_, tid, pos.astype(np.int32), many]
        yield from _pieces(arrays, ["hash", "ord", "tid", "pos", "settled"])

    return make


_FOUND = "h1 bigint, h2 int, ord bigint, tid bigint, start int, settled boolean"


def _windows(size: int):
    def make(batch: pa.RecordBatch):
        for part in _slices(batch, _unzipped(batch.column(2))):
            yield from windows(part)

    def windows(batch: pa.RecordBatch):
        unzip = zstandard.ZstdDecompressor().decompress
        ids, tids, anchors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        held = [[], [], [], [], []]
        for chunk in W.chunks([unzip(t) for t in batch.column(2).to_pylist()]):
            total = len(chunk.starts)
            wanted = np.zeros(total + 1, np.int32)
            for k in range(len(chunk.offsets) - 1):
                a, end = int(chunk.offsets[k]), int(chunk.offsets[k + 1])
                pos = anchors[chunk.first + k].values.to_numpy(zero_copy_only=False).astype(np.int64) + a
                pos = pos[pos < end]
                np.add.at(wanted, np.maximum(pos - PERIOD + 1, a), 1)
                np.add.at(wanted, pos + 1, -1)
            ok = W.window_starts(chunk.offsets, size, total)
            at = np.flatnonzero(ok & (np.cumsum(wanted)[: len(ok)] > 0))
            owner = chunk.text_of_word()[at]
            held[0].append(W.window_hashes(W.word_hashes(chunk, 0), size, 0)[at])
            held[1].append(W.window_hashes(W.word_hashes(chunk, 1), size, 1)[at] >> np.uint64(32))
            held[2].append(ids[chunk.first + owner])
            held[3].append(tids[chunk.first + owner])
            held[4].append(at - chunk.offsets[owner])
        h1, h2, ord_, tid, start = (np.concatenate(h) for h in held)
        order = np.lexsort((start, ord_, h2, h1))
        same = np.zeros(len(order), bool)
        prev, this = order[:-1], order[1:]
        same[1:] = (h1[prev] == h1[this]) & (h2[prev] == h2[this])
        later, _ = _settle(order, same)
        # Later in the order, but at the very place of the first (equal rows): not removed for that.
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        twin = np.zeros(len(order), bool)
        twin[order] = same & (ord_[order] == ord_[first]) & (start[order] == start[first])
        later &= ~twin
        arrays = [_salted(h1, later, ord_, start), h2.astype(np.uint32).view(np.int32), ord_, tid, start.astype(np.int32), later]
        yield from _pieces(arrays, ["h1", "h2", "ord", "tid", "start", "settled"])

    return make


def _pieces(arrays: list[np.ndarray], names: list[str], rows: int = 1 << 18):
    for lo in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + rows]) for a in arrays], names=names)
