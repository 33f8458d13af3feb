"""Operators of gridcast.llm against brute force, on small frames with nulls, empty texts, ties and odd columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.llm import decontamination, mixing, quality, secrets, simhash, substring, token_counts, topk, toxicity, warc
from gridcast.llm.oracles import ORACLES
from gridcast.llm.queries import QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, fp string, n_words string, _n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(base[10:45]), None, "", " \n\t ", "one", "x" * 50_000, " ".join(rng.choices(words, k=3000))]
    rows = [(i, t, "s%d" % (i % 2)) for i, t in enumerate(texts)]
    return [*rows, (None, " ".join(base), None), rows[0], rows[0], (1, "other text of the same id", "s1")]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, key):
    assert not differences(QUERIES[key](spark, SF), connect(SF), ORACLES[key])


def test_near_duplicates(spark):
    rng = random.Random(5)
    start = rng.getrandbits(64)
    fps = {start}
    for _ in range(300):
        f = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 2, 2, 3, 9])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    reach = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if (a ^ b) & (2**64 - 1) and bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and reach[b] < reach[a]:
                    reach[a], changed = reach[b], True
    want = {i: signed.index(reach[f]) for i, f in enumerate(signed)}
    for dense in (64, 1):
        got = {r.doc_id: r.component_id for r in simhash.with_components(rows, dense).collect()}
        assert got == want


def test_one_per_group(spark, odd):
    docs = frame(spark, odd)
    kept = sorted((r.doc_id, r.text) for r in simhash.one_per_group(docs).collect() if r.doc_id is not None)
    assert kept.count((0, odd[0][1])) == 1 and (1, odd[0][1]) not in kept
    assert [i for i, _ in kept].count(3) == 1 and 4 not in [i for i, _ in kept]
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_repeats(spark, odd):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.remove_repeats(frame(spark, odd)).collect()}
    assert got[(None, 60)] == 0 and got[(0, 60)] == 60 and got[(2, 35)] == 35 and got[(1, 6)] == 0
    assert substring.remove_repeats(frame(spark, odd).limit(0)).count() == 0


def test_tokens(spark, odd):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = token_counts.load(model)
    extra = [(50 + i, t, None) for i, t in enumerate(["  a  b ", "a\n\nb\t1 23", "x ▁ y", "<s> é́ 漢字", "\x00 z"])]
    rows = [*odd, *extra]
    for frequent in (3, 1000):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, rows), model, frequent).collect())
        assert got == sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in rows)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 8))
    v[50:120] = v[7]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10, 64, 2).collect())
    want = []
    for q in (0, 100, 200):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(300) if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    odd = spark.createDataFrame([(1, None), (2, [None, 1.0]), (None, [1.0]), (3, [float("nan")]), (4, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.v) for r in topk.integer_vectors(odd).collect()] == [(4, [512])]


def test_sorted_lists():
    rng = np.random.default_rng(3)
    for largest, width in ((3, 1), (40, 5), (1024, 64), (1 << 28, 3)):
        v = rng.integers(-largest, largest + 1, (500, width))
        v[::7], v[5] = v[3], 0
        lists = topk.SortedLists(np.arange(500)[::-1], v[::-1])
        for q in (0, 3, 5, 7, 499):
            want = sorted((-int(sum(int(a) * int(b) for a, b in zip(v[q], v[i]))), i) for i in range(500) if i != q)[:10]
            assert lists.top(v[q], q, 10) == [(-s, i) for s, i in want]
    assert topk.SortedLists(np.array([1, 2]), np.ones((2, 3), np.int64)).top(np.ones(3, np.int64), 1, 10) == [(3, 2)]


def test_salvage():
    parts = [warc.page_record(i, f"http://x/{i}", b"<p>%d</p>" % i * 200) for i in range(5)]
    plain = warc.record("response", [("WARC-Record-ID", "<urn:page:9>")], b"body")
    hurt = bytearray(parts[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + bytes(hurt) + parts[2] + b"noise" + plain + parts[3][: len(parts[3]) // 2] + parts[4]
    found = list(warc.salvage(data))
    ids = [f[3]["warc-record-id"] for f in found if f[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 9, 4)]
    gaps = [data[f[1] : f[2]] for f in found if f[0] == "gap"]
    assert gaps == [bytes(hurt), b"noise", parts[3][: len(parts[3]) // 2]]
    assert sum(f[2] - f[1] for f in found) == len(data)


def test_salvage_of_members_longer_than_a_piece():
    rng = random.Random(2)
    bodies = [rng.randbytes(size) for size in (0, 1, warc.PIECE - 300, 3 * warc.PIECE, 5)]
    parts = [warc.page_record(i, None, b) for i, b in enumerate(bodies)]
    cut = parts[3][: 2 * warc.PIECE]
    found = list(warc.salvage(b"".join(parts) + cut + parts[1]))
    assert [f[4].partition(b"\r\n\r\n")[2] for f in found if f[0] == "record"] == [*bodies, bodies[1]]
    assert [f[2] - f[1] for f in found if f[0] == "gap"] == [len(cut)]


def test_secrets(spark, odd):
    rng = random.Random(1)
    keys = ["".join(rng.choice(secrets.ALPHABETS["base64_url"]) for _ in range(60)) + "9aZ" for _ in range(40)]
    texts = [f"é token='abcdef12' x {'0a1b' * 8} AKIA{'Q' * 16} password: abc {key} end" for key in keys]
    text = texts[0]
    rows = [*odd, *[(900 + i, t, None) for i, t in enumerate(texts)]]
    found = {r.doc_id: r.secrets for r in secrets.find_secrets(frame(spark, rows)).collect()}
    values = [text[s.start : s.end] for s in found[900]]
    assert values[:3] == ["token='abcdef12", "0a1b" * 8, "AKIA" + "Q" * 16]
    hits = [k for k in range(40) if keys[k] in [texts[k][s.start : s.end] for s in found[900 + k]]]
    assert len(hits) >= 30
    clean = {r.doc_id: r.text for r in secrets.redacted(frame(spark, rows)).collect()}
    assert all(keys[k] not in clean[900 + k] for k in hits) and clean[900].startswith("é [SECRET]") and clean[3] is None and clean[7] == odd[7][1]


def plain_base_spans(text):
    """(start, kind, end) of op6's base spans."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_columns_of_the_secrets_query(spark, odd, tmp_path):
    rng = random.Random(6)
    parts = ["password", "Passwd", "TOKEN", "api_key", "=", ": ", '"', "'", " ", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x.y-z", "\U0001f600", "\u212a", "\u017f"]
    texts = [None, "", "0a" * 12, f"x {'0a' * 12} AKIA{'Q' * 16} token=abcdef {'0b' * 12}", *["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300)]]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op6_scan_secrets"](spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        want = plain_base_spans(t or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i] == (*[sum(k == x for _, x, _ in want) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest())


def test_contamination(spark, odd):
    bench = spark.createDataFrame([(1, odd[0][1]), (2, None), (3, "one"), (None, "unseen"), (1, odd[0][1])], "item_id long, text string")
    for size in (8 << 20, 100):
        got = {(r.doc_id, r.n_words): (decontamination.merge((h.lo, h.hi) for h in r.hits), r["items"]) for r in decontamination.find_contamination(frame(spark, odd), bench, slice_bytes=size).collect()}
        assert got[(0, 60)] == ([(0, 60)], ["1"]) and got[(6, 1)] == ([(0, 1)], ["3"])
        assert got[(1, 6)][1] == [] and got[(3, 0)] == ([], [])
    left = decontamination.without_contaminated(frame(spark, odd), bench)
    assert left.columns == frame(spark, odd).columns and {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 7, 8}


def test_mixture(spark, odd):
    mixed = mixing.mixture(frame(spark, odd), budget_ratio=None)
    assert mixed.count() == len(odd) and mixing.realised(mixed).count() >= len(odd)
    assert mixing.mixture(frame(spark, odd).limit(0)).count() == 0


def test_classifiers(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert (scored.predicted == scored.quality)[scored.held_out].mean() > 0.85
    none = labels.limit(0)
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(frame(spark, odd), none).count() == len(odd)
    marks = toxicity.Landmarks(["^idiot$", "^moron$"])
    close = marks.similarity(["^idiot$", "^idxiot$", "^mo$", "^theon$"])
    assert close[0, 0] == pytest.approx(1) and close[1, 0] > 0.5 > close[2:, 0].max()
    assert toxicity.spaced("you i d i o t there") == ["idiot"]


def plain_kernel(a, b, order=3):
    """Common subsequences of three letters, each by the letters it spans in both words."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), order):
        for j in itertools.combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel_and_folded_decisions():
    rng = random.Random(4)
    words = ["^" + "".join(rng.choices("abcé😀", k=rng.randint(1, 7))) + "$" for _ in range(25)]
    marks = toxicity.Landmarks(words[:6])
    want = [[plain_kernel(a, b) / np.sqrt(plain_kernel(a, a) * plain_kernel(b, b)) for b in words[:6]] for a in words]
    assert np.allclose(marks.similarity(words), want)
    beta = np.linspace(-1, 2, 6)
    model = toxicity.Model(marks.codes, marks.table @ beta, -0.7)
    decided = np.maximum(np.array(want) @ beta - 0.7, toxicity.FLOOR)
    assert np.allclose(model.words([w[1:-1] for w in words]), decided)
    long = "z" * 40 + words[5][1:-1] * 4
    value = max(model.bias + marks.similarity(toxicity.pieces(long)) @ beta)
    assert model.words([long, ""])[0] == pytest.approx(value) and value > toxicity.FLOOR
    assert model.words([""])[0] == toxicity.FLOOR
    # What is passed over is spanned by what was chosen.
    chosen = toxicity.spanning(words, 25)
    gram = toxicity.Landmarks(chosen).similarity(chosen)
    rest = [w for w in words if w not in chosen]
    k = toxicity.Landmarks(chosen).similarity(rest)
    assert (1 - np.einsum("ij,jk,ik->i", k, np.linalg.inv(gram), k) <= toxicity.RESIDUAL + 1e-6).all()


def test_clashing_names_in_redaction_and_mixture(spark):
    rows = [(1, "password = hunter22x9", "s", 21, "T", 5, 7), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, TEXT string, Secrets int, MIX_COPIES int")
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got[1] == (1, "[SECRET]", "s", 8, "T", 5, 7) and got[2] == rows[1]
    real = mixing.realised(mixing.mixture(docs, budget_ratio=None))
    assert sorted(r[0] for r in real.collect()) == [1, 2] and "MIX_COPIES" not in real.columns


def test_toxic_tokens_stay_known_within_a_part(monkeypatch):
    marks = toxicity.Landmarks(["^idiot$", "^moron$"])
    model = toxicity.Model(marks.codes, marks.table.sum(axis=1) * 3, -1.5)
    texts = ["you i d i o t there", *(f"w{i} plain words" for i in range(50)), "you idiot", None, "what a mor0n", "an i.d.i.o.t indeed", "idiots", "x" * 50_000]
    column = pa.array([t and t.encode() for t in texts], pa.binary())
    want = toxicity.Decisions(model).batch(column)
    assert [bool(w > 0) for w in want[:, 0]] == [True, *[False] * 50, True, False, True, True, True, False]
    monkeypatch.setattr(toxicity, "KNOWN", 10)
    for size in (512, 3):
        monkeypatch.setattr(toxicity, "TEXTS", size)
        assert (toxicity.Decisions(model).batch(column) == want).all()


def test_skewed_lexicon_of_insults(spark):
    rng = random.Random(8)
    insult = ["".join(rng.choices("bcdfgklmnprstvz", k=rng.choice([3, 6, 7]))) for _ in range(40)]
    plain = ["".join(rng.choices("aeiou", k=6)) for _ in range(200)]
    rows = []
    for k, word in enumerate([*insult, *[None] * 20]):
        for _ in range(300 if k == 0 else 12 if k < 40 else 60):
            text = rng.choices(plain, k=12)
            rows.append((len(rows), " ".join(text if word is None else [*text[:6], word, *text[6:]]).encode(), float(word is not None)))
    train = spark.createDataFrame(rows, "doc_id long, text binary, label double")
    copies = train.union(train.where("doc_id < 200").withColumn("doc_id", F.col("doc_id") + 10_000))
    assert toxicity.distinct_texts(copies).count() == train.select("text", "label").distinct().count()
    toxic, _ = toxicity.choose_landmarks(toxicity.count_parts(train), 768.0, 1200.0)
    assert set(insult) <= {t.strip("^$") for t in toxic}
    seen = spark.createDataFrame([(f"{plain[0]} {w} {plain[1]}",) for w in insult] + [(f"{a} {b}",) for a, b in zip(plain, plain[1:])], "text string")
    model = toxicity.fit(train)
    scored = toxicity.scores(seen, 0, model).collect()
    assert [r.score >= 0.7 for r in scored] == [True] * len(insult) + [False] * (len(plain) - 1)
    # The fit depends neither on the size of batches nor on the placement of rows.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    again = toxicity.fit(train.repartition(5))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(again.gain, model.gain, atol=1e-3) and np.allclose(again.link, model.link, atol=1e-2)


def test_repetition_limit_of_the_smallest_whole_budget(spark):
    sizes = {"big": 667, **{f"s{i}": 60 for i in range(20)}, "rare": 1}
    docs = frame(spark, [(i, " ".join(["w"] * 10), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))])
    mixed = mixing.mixture(docs, budget_ratio=None)
    quota = {r.source: r.mix_quota / (10 * sizes[r.source]) for r in mixed.select("source", "mix_quota").distinct().collect()}
    assert quota["big"] == pytest.approx(1, abs=0.01) and 1 <= quota["rare"] <= 4 + 0.1
    # The whole budget also reads every document at least once.
    assert mixed.where("mix_copies < 1").count() == 0


def test_long_pretokens_are_not_broadcast(spark, odd, monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    held, documents = [], token_counts._documents
    monkeypatch.setattr(token_counts, "_documents", lambda pattern, known: held.append(known.value) or documents(pattern, known))
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, odd), model).collect()}
    assert held[0] and max(len(t.encode()) for t in held[0]) <= 64
    sp = token_counts.load(model)
    assert got == {(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in odd}


def test_spans_of_many_matches(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("0123456789abcdef", k=rng.choice([8, 24, 30]))) + rng.choice(["", "é", " x\n"]) for _ in range(6_000))
    texts = [long, " ".join(["a" * 24] * 128), " ".join(["b" * 25] * 129), "c" * 24, "", "none", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [(s.start, s.end, s.value) for s in r.s or []] for r in docs.select("i", secrets.spans(F.col("text"), "[0-9a-f]{24,}").alias("s")).collect()}
    want = {i: [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9a-f]{24,}", t or "")] for i, t in enumerate(texts)}
    assert got == want
