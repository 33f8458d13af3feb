"""Lexical search, periodic runs and repeated lines against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridcast.llm import lexical, lines, periods
from gridcast.llm.queries import QUERIES, with_planted_periods

SF = "/root/testdata/sf0.001"

# Lexical search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    bags = [b for b in bags if b[1]]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
                for t in terms(text)
                if b[t]
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, score string, ID string, terms string")


@pytest.fixture(scope="module")
def search_rows():
    rng = random.Random(8)
    common, rare = ["the", "und", "of", "é"], [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):
        size = rng.choice([3, 3, 3, 12, 40])
        docs.append((i, " ".join(rng.choices(common, k=size) + rng.choices(rare, k=size))))
    docs += [(200, None), (201, ""), (202, " ,; \n"), (None, "w1 w2 w3"), (203, "W1, w1. W1-w2"), (203, "another w1 of one id"), docs[5], docs[5]]
    docs.append((300, "w1 " * 30_000 + "einzig"))
    items = [(1, "w1 w2 the"), (2, "W5 w5 w5 einzig"), (3, None), (4, ""), (5, "unknown words"), (1, "w1 w2 the"), (None, "w7 of"), (6, "é")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_docs": 4, "first": 2}, {"slice_bytes": 12, "top": 3}, {"block_docs": 1, "top": 1}])
def test_search(spark, search_rows, options):
    docs, items = search_rows
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, item string, RANK string")
    got = lexical.search(doc_frame(spark, docs), frame, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, options.get("top", lexical.TOP))


def test_search_of_empty_tables(spark, search_rows):
    docs, items = (doc_frame(spark, search_rows[0]), spark.createDataFrame([(1, "w1")], "item_id long, text string"))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# Periodic runs.


def plain_runs(w, least=24, times=3):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                # The smallest period of a stretch comes first.
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng):
    letters = [f"{c}é" for c in "abcdefghij"[: rng.choice([1, 2, 2, 3, 10])]]
    w = rng.choices(letters, k=rng.choice([0, 5, 24, 40, 90, 200]))
    for _ in range(rng.choice([0, 1, 2])):
        if len(w) > 30:
            p, a = rng.randrange(1, len(w) // 3), rng.randrange(len(w) // 2)
            for i in range(a + p, min(len(w), a + rng.randrange(2, 8) * p)):
                w[i] = w[i - p]
    return rng.choice([" ", "\n", " \t "]).join(w)


@pytest.mark.parametrize("least", [24, 3])
def test_runs(spark, least):
    rng = random.Random(least)
    texts = [None, "", " \n ", "one", "x " * 40_000, *[periodic_text(rng) for _ in range(600)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (7, texts[9]), (7, texts[9])]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, runs string, N_WORDS string")
    got = sorted(periods.find_runs(frame, least_words=least).collect(), key=str)
    want = []
    for i, t in rows:
        w = (t or "").split()
        runs = [(0, len(w), 1)] if t == texts[4] else plain_runs(w, least)
        want.append((i, len(w), runs, collapse(w, runs).encode()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.find_runs(frame.limit(0)).count() == 0


def test_runs_of_a_text_that_deceives_running_sums():
    bits = "0"
    for _ in range(13):
        bits += bits.translate(str.maketrans("01", "10"))
    ((words, runs),) = periods.text_runs([" ".join(bits).encode()])
    # This text holds no word three times in a row, by a theorem, so it has no run of three periods.
    assert len(words) == 2**13 and runs == []
    (again,) = periods.text_runs([(" ".join(bits) + " 0 1" * 20).encode()])
    assert again[1] == plain_runs(again[0])


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periods.find_runs(doc_frame(spark, [(1, "a")]), least_periods=2)


def test_runs_query(spark):
    """The whole query on the smallest table, planted periods included."""
    got = {r.doc_id: r for r in QUERIES["op12_find_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = (d.text or "").split()
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (
            d.doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(collapse(w, runs).encode()).hexdigest(),
        )
        assert tuple(got[d.doc_id]) == want


def test_planted_periods_leave_null_ids_and_texts(spark):
    rows = [(None, "a b c"), (3, None), (4, ""), (5, " \n")]
    got = with_planted_periods(doc_frame(spark, rows)).collect()
    assert [(r.doc_id, (r.text or "").split()) for r in got] == [(i, (t or "").split()) for i, t in rows]


# Repeated lines.


def plain_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def plain_drops(rows, least_chars, least_docs):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(plain_key(x)) >= least_chars:
                held.setdefault(plain_key(x), set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        gone = [i is not None and len(held.get(plain_key(x), ())) >= least_docs and i < max(held[plain_key(x)]) for x in all_lines]
        out.append((i, len(all_lines), sum(gone), "\n".join(x for x, g in zip(all_lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [(lines.HOT_LEAST, lines.HOT_SHARE), (0, 50), (3, 10**9)])
def test_lines(spark, hot):
    rng = random.Random(4)
    pool = ["%s line %d %s" % (rng.choice(["\t", "", " \x0b"]), i, rng.choice(["ÄÖ", "KK", "x\r"])) for i in range(25)]
    pool += ["everywhere, in all documents", "EVERYWHERE, in all Documents  "]
    rows = []
    for i in range(80):
        rows.append((i, "\n".join(rng.choices(pool, k=rng.choice([1, 2, 5, 30])) + [rng.choice(pool[-2:])])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, "\n".join(pool)), (93, "everywhere, in all documents"), rows[3], rows[3], (7, "\n".join(pool[::-1]))]
    rows.append((95, "\n".join(rng.choices(pool, k=20_000))))
    frame = doc_frame(spark, rows)
    got = lines.without_repeated_lines(frame, 9, 3, hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_drops(rows, 9, 3)
    kept = {(r.id, r.tid): r for r in lines.keep_bitmaps(frame, 9, 3, hot).collect()}
    assert all(r.dropped > 0 and all(x["count"] != 0 for x in r.kept) for r in kept.values())


def test_lines_of_an_empty_table(spark):
    empty = doc_frame(spark, [(1, "a")]).limit(0)
    assert lines.without_repeated_lines(empty).count() == 0
    assert lines.keep_bitmaps(empty).count() == 0


def test_line_stream_needs_no_second_exchange(spark):
    """Windows and sort of the stream use the range partitions as they are."""
    rows = spark.range(5_000).select("id", F.lit(0).cast("bigint").alias("tid"), F.lit("x" * 50).alias("text"))
    plan = lines.repeated_lines(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
