"""Repeat removal over batches larger than a slice: memory and results."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gridcast.llm import substring


def texts(count, length=800, seed=3):
    rng = random.Random(seed)
    return [" ".join("w%d" % rng.randrange(50_000) for _ in range(length)) for _ in range(count)]


def batch_of(made, kind):
    n = len(made)
    columns = [pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64())]
    if kind == "anchors":
        return pa.RecordBatch.from_arrays([*columns, pa.array([t.encode() for t in made], pa.binary())], names=["ord", "tid", "text"])
    packed = pa.array([zstandard.compress(t.encode()) for t in made], pa.binary())
    places = pa.array([list(range(0, len(t.split()), 3)) for t in made], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, packed, places], names=["ord", "tid", "text", "pos"])


@pytest.mark.parametrize("kind", ["anchors", "windows"])
def test_memory_of_a_task_does_not_grow_with_its_batch(monkeypatch, kind):
    monkeypatch.setattr(substring, "SLICE_BYTES", 1 << 18, raising=False)
    make = substring._anchors(substring.anchor_words()) if kind == "anchors" else substring._windows(substring.WINDOW)
    peaks, rows = [], []
    # The first round fills the table of powers.
    for count in (10, 80, 640):
        batch = batch_of(texts(count), kind)
        tracemalloc.start()
        rows.append(sum(out.num_rows for out in make(batch)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert rows[2] >= 7 * rows[1]
    assert peaks[2] < 2 * peaks[1]


def test_repeats_across_slices_of_a_batch(spark):
    made = texts(1500)
    rng = random.Random(4)
    passage = made[0].split()[100:140]
    for i in range(0, 1500, 7):
        words = made[i].split()
        at = rng.randrange(700)
        made[i] = " ".join([*words[:at], *(passage if i % 2 else passage[:20]), *words[at:]])
    made += made[:50]
    assert sum(map(len, made)) > 2 * substring.SLICE_BYTES
    seen, want = set(), {}
    for i, text in enumerate(made):
        words = text.split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - substring.WINDOW + 1):
            window = hash(tuple(words[k : k + substring.WINDOW]))
            if window in seen:
                gone[k : k + substring.WINDOW] = True
            seen.add(window)
        want[i] = " ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(docs).collect()}
    assert got == {i: (len(t.split()), len(t.split()) - len(want[i].split()), want[i]) for i, t in enumerate(made)}
