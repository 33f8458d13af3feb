"""Near-duplicate groups by similarity, against all pairs in plain Python."""

import random

import numpy as np
import pytest

from gridcast.llm import simhash_similar as similar

SCHEMA = "doc_id long, text string, label string, n string, DOC_ID string, _id string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def plain_groups(texts):
    """Smallest index reachable, for every text."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = "new%d" % rng.randrange(10**6)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [None, "", " \n ", "a b", "A  b", "a b c", "y" * 60_000]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 200, 800]))
        texts.append(" ".join(base))
        for _ in range(3):
            texts.append(" ".join(changed(rng, base, rng.randrange(0, 2 + len(base) // 50))))
    long = rng.choices(vocabulary, k=40_000)
    texts += [" ".join(long), " ".join(changed(rng, long, 700)), " ".join(rng.choices(vocabulary, k=40_000))]
    crowd = rng.choices(vocabulary, k=150)
    texts += [" ".join(changed(rng, crowd, 1)) for _ in range(90)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


@pytest.mark.parametrize("dense", [64, 4])
def test_groups_of_similar_texts(spark, corpus, dense):
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate(corpus)]
    got = similar.one_per_group(spark.createDataFrame(rows, SCHEMA), dense=dense)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [r[0] for r in got.collect()]
    want = {i for i, x in enumerate(plain_groups(corpus)) if i == x}
    assert len(kept) == len(set(kept))
    # Nothing that stands alone goes; what is missed is a share of the copies.
    assert want <= set(kept)
    assert len(set(kept) - want) <= 0.03 * (len(corpus) - len(want))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "p q r s t u", "x"), (4, "P q r s t u", "x"), (4, "P q r s t u", "x"), (4, "other", "x"), (None, "alone", "x"), (None, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segs string")
    got = sorted(map(str, (tuple(r) for r in similar.one_per_group(docs).collect())))
    assert got == sorted(map(str, [rows[1], rows[3], rows[4]]))
    assert similar.one_per_group(docs.limit(0)).count() == 0


def test_shingle_sets_cross_no_text():
    sets = list(similar.shingle_sets([b"a b c d e f", b"", b"f a b c d E", b"a B c d e"]))
    assert [len(s) for s in sets] == [2, 0, 2, 1]
    assert set(sets[0]) & set(sets[2]) == set(sets[3])


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**8])
def test_segments_meet_pairs_of_similarity_0_8(rows):
    rng = np.random.default_rng(rows)
    bits, segments = similar.segments_for(rows)
    met, tried = 0, 150
    for _ in range(tried):
        pool = rng.integers(0, 2**63, 330, dtype=np.uint64)
        _, ga, ma = similar.fingerprint(pool[:297], bits, segments)
        _, gb, mb = similar.fingerprint(pool[33:], bits, segments)
        met += bool((((ga ^ gb) & ~ma == 0) | ((ga ^ gb) & ~mb == 0)).any())
    assert met >= 0.92 * tried
