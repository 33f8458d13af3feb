"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import pick, staged, utf8
from gridcast.llm.labelled import fold, with_label

#: Labelled documents that are learned from, at most: those with the smallest keyed hash of their id.
TRAIN_DOCUMENTS = 20_000
#: The chance that any of the tested parts of words passes as telling without being so is at most this.
SIGNIFICANCE = 0.01
#: A part in fewer documents is not tested.
LEAST_DOCUMENTS = 3
#: Landmarks are at most RANK telling parts and BACKGROUND common clean words, chosen from CANDIDATES
#: each; one whose kernel image the earlier ones span up to RESIDUAL adds nothing and is passed over.
RANK, BACKGROUND, CANDIDATES, RESIDUAL = 256, 64, 1_000, 0.2
#: Words of a toxic document at least so similar to a telling landmark are learned as toxic.
WITNESS = 0.6
#: Clean words at least so similar to one are all learned.
ALIKE = 0.35
#: Clean words unlike every telling landmark that are learned from, about.
PLAIN_WORDS = 10_000
DECAY = 0.7
LONG, PART = 24, 16
PREFIXES = range(4, 11)
#: Decisions up to this are as good as none: the margin of clean words.
FLOOR = -0.5
#: Tokens whose decisions a task remembers.
KNOWN = 200_000
#: Texts whose tokens are decided together.
TEXTS = 512

_SPACED = re.compile(r"(?<!\S)(?:\w\W{1,2}){3,}\w(?!\w)")
# Signs that stand for letters inside a word.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"^\W+|[\W_]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(token: str) -> str:
    """Lower-case letters of a token; signs and digits between letters that stand for a letter count as that
    letter, others go. Accents stay: two words may differ by nothing else."""
    token = _EDGE.sub("", token.lower())
    if not token.isalpha():
        token = _NOT_LETTERS.sub("", token.translate(_LEET))
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
    return token


def spaced(text: str) -> list[str]:
    """Letters written apart, as one token each run."""
    return [_NOT_LETTERS.sub("", m[0]) for m in _SPACED.finditer(text)]


def pieces(word: str) -> list[str]:
    """The word between a mark of its start and one of its end, or overlapping parts of one longer than
    LONG letters; nothing of an empty word."""
    if len(word) <= LONG:
        return [f"^{word}$"] if word else []
    cut = [word[k : k + LONG] for k in range(0, len(word) - LONG + PART, PART // 2)]
    return ["^" + cut[0], *cut[1:-1], cut[-1] + "$"]


@lru_cache(1 << 17)
def parts(word: str) -> tuple[str, ...]:
    """What may be a landmark: the word's pieces and its beginnings."""
    return *pieces(word), *("^" + word[:k] for k in PREFIXES if k < len(word))


# ---------------------------------------------------------------- kernel


@lru_cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All three ascending places in a word of n letters, and the weight of their span."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words of equal length, and their letters as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes[sizes >= 3]).tolist():
        members = np.flatnonzero(sizes == n)
        step = max(1, 1_000_000 // len(_places(n)[0]))
        for lo in range(0, len(members), step):
            at = members[lo : lo + step]
            raw = "".join(words[m] for m in at.tolist()).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(raw, np.uint32).reshape(len(at), n).astype(np.int64)


def subsequences(chars: np.ndarray, base: int = 1 << 21) -> np.ndarray:
    """Codes of the subsequences of three letters, a row per word."""
    i, j, k, _ = _places(chars.shape[1])
    return (chars[:, i] * base + chars[:, j]) * base + chars[:, k]


def spectra(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Images of words in the kernel's feature space: numbers of the words, codes of their subsequences
    and weights: a subsequence counts DECAY ** (letters it spans), each time it occurs. A code that occurs
    twice in a word is twice in its row."""
    for at, chars in by_length(words):
        yield at, subsequences(chars), _places(chars.shape[1])[3]


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lengths of the images in rows of codes."""
    order = np.argsort(codes, axis=1, kind="stable")
    sorted_codes = np.take_along_axis(codes, order, axis=1)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    starts = np.flatnonzero(new)
    squares = np.add.reduceat(weight[order].ravel(), starts) ** 2
    return np.sqrt(np.bincount(starts // codes.shape[1], squares, len(codes)))


@dataclass
class Landmarks:
    """Marked words and parts of words, and their images as the columns of a table by code."""

    words: list[str]
    codes: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        held = list(spectra(self.words))
        self.codes = np.unique(np.concatenate([c.ravel() for _, c, _ in held])) if held else np.zeros(0, np.int64)
        self.table = np.zeros((len(self.codes), len(self.words)))
        for at, codes, weight in held:
            place = np.searchsorted(self.codes, codes)
            np.add.at(self.table, (place, at[:, None]), np.broadcast_to(weight, codes.shape) / norms(codes, weight)[:, None])

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each marked word with each landmark."""
        out = np.zeros((len(words), len(self.words)))
        for at, codes, weight in spectra(words):
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit, length = self.codes[place] == codes, norms(codes, weight)
            for row, p, h, n in zip(at.tolist(), place, hit, length.tolist(), strict=True):
                out[row] = weight[h] @ self.table[p[h]] / n
        return out


@dataclass
class Model:
    """decision(word) = bias + sum of `gain` over its subsequences, normalised: the support vector machine
    on Nyström features, folded into one number per code. score = logistic of `link` and a document's
    features (see `Decisions.document`)."""

    codes: np.ndarray
    gain: np.ndarray
    bias: float
    link: np.ndarray = field(default_factory=lambda: np.array([2.0, 0.0, 0.0, 0.0]))

    def gains(self, chars: np.ndarray) -> np.ndarray:
        """Gain of every subsequence, 0 of those of no landmark."""
        codes = subsequences(chars)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[place] == codes, self.gain[place], 0.0)

    def words(self, words: list[str]) -> np.ndarray:
        """Decision of each word (letters), of a long one that of its worst part; FLOOR if it is lower."""
        cut = [pieces(w) for w in words]
        flat = [p for c in cut for p in c]
        value = np.full(len(flat), max(self.bias, FLOOR))
        for at, chars in by_length(flat):
            weight = _places(chars.shape[1])[3]
            total = self.gains(chars) @ weight
            # A subsequence that occurs twice only makes the norm larger than this.
            high = np.flatnonzero(total > (FLOOR - self.bias) * np.sqrt(weight @ weight)) if self.bias < FLOOR else np.arange(len(at))
            if len(high):
                value[at[high]] = self.bias + total[high] / norms(subsequences(chars[high]), weight)
        out = np.full(len(words), FLOOR)
        np.maximum.at(out, np.repeat(np.arange(len(words)), [len(c) for c in cut]), value)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.link[:3] + self.link[3], -50, 50)))


class Decisions:
    """Decisions of the tokens met so far; only those above FLOOR are kept with theirs."""

    def __init__(self, model: Model):
        self.model, self.seen, self.above = model, set(), {}

    def learn(self, new: set[str]) -> None:
        words = sorted(new - self.seen)
        for lo in range(0, len(words), 5_000):
            part = words[lo : lo + 5_000]
            value = self.model.words([letters(w) for w in part])
            self.above.update((part[i], float(value[i])) for i in np.flatnonzero(value > FLOOR).tolist())
        self.seen.update(words)

    def texts(self, column: pa.Array) -> Iterator[str]:
        """Texts of a batch in turn; the tokens of the one in hand are known. Only here, where no text is in
        hand, are known tokens forgotten."""
        column = column.cast(pa.binary())
        for lo in range(0, len(column), TEXTS):
            if len(self.seen) > KNOWN:
                self.seen, self.above = set(), {}
            part = [(t or b"").decode() for t in column[lo : lo + TEXTS].to_pylist()]
            self.learn(set().union(*map(str.split, part)))
            yield from part

    def document(self, text: str) -> tuple[float, float, float]:
        """Of a text from `texts`: the worst decision of a sentence, which is that of its worst word, and
        the logarithms of one plus the sum of positive decisions, whole and per thousand words."""
        toks = text.split()
        apart = spaced(text)
        if apart:
            self.learn(set(apart))
            toks += apart
        held = [self.above[t] for t in toks if t in self.above]
        total = sum(v for v in held if v > 0)
        return max(held, default=FLOOR), np.log1p(total), np.log1p(1000 * total / max(len(toks), 1))

    def batch(self, column: pa.Array) -> np.ndarray:
        return np.array([self.document(t) for t in self.texts(column)]).reshape(-1, 3)


# ---------------------------------------------------------------- training


def count_parts(train: DataFrame) -> DataFrame:
    """part, a, b: the toxic and the clean texts that hold each part of a word, from train (text as bytes,
    label)."""

    def count(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text.decode()
                words = {letters(t) for t in {*text.split(), *spaced(text)}}
                for p in set().union(*map(parts, words)):
                    held.setdefault(p, [0, 0])[label < 1] += 1
                if len(held) > 200_000:
                    yield made(held)
                    held = {}
        yield made(held)

    def made(held: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(held, pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "a", "b"])

    counts = train.select("text", "label").mapInArrow(count, "part string, a bigint, b bigint")
    return staged(counts.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxicity-parts")


def telling(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """Parts whose log-likelihood ratio for toxic texts is significant, with that `ratio`: the level is
    divided by the number of tested parts, and no part is measured by another."""
    seen, rate = F.col("a") + F.col("b"), F.lit(n1 / (n1 + n0))
    tested = counts.where(seen >= LEAST_DOCUMENTS)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), seen * rate) + part(F.col("b"), seen * (1 - rate)))
    # The ratio of a part that tells nothing is the square of a standard normal number.
    least = NormalDist().inv_cdf(SIGNIFICANCE / max(tested.count(), 1) / 2) ** 2
    return tested.withColumn("ratio", F.round(ratio, 6)).where((F.col("a") / seen > 2 * rate) & (F.col("ratio") >= least))


def spanning(words: list[str], most: int, before: list[str] = ()) -> list[str]:
    """Of words in order those, `most` at most, whose images have a part of more than RESIDUAL that the
    chosen ones before (and `before`) do not span: an incomplete Cholesky factorisation."""
    words = [*before, *words]
    if not words:
        return []
    marks = Landmarks(words)
    gram = marks.table.T @ marks.table
    factor, left, chosen = np.zeros((len(words), len(before) + most)), np.ones(len(words)), []
    for i in range(len(words)):
        if len(chosen) == len(before) + most:
            break
        if i < len(before) or left[i] > RESIDUAL:
            column = (gram[:, i] - factor @ factor[i]) / np.sqrt(max(left[i], 1e-9))
            factor[:, len(chosen)] = column
            left = left - column**2
            chosen.append(i)
    return [words[i] for i in chosen if i >= len(before)]


def choose_landmarks(counts: DataFrame, n1: float, n0: float) -> tuple[list[str], list[str]]:
    """Telling parts, the most telling first, and common words that tell nothing, for the background."""
    order = [F.desc("ratio"), F.desc(F.length("part")), "part"]
    told = [r["part"] for r in telling(counts, n1, n0).orderBy(*order).limit(CANDIDATES).collect()]
    toxic = spanning(told, RANK)
    plain = counts.where((F.col("a") * n0 <= F.col("b") * n1) & F.col("part").like("^%$"))
    common = [r["part"] for r in plain.orderBy(F.desc("b"), "part").limit(CANDIDATES).collect()]
    return toxic, spanning(common, BACKGROUND, toxic)


def obfuscated(word: str) -> list[str]:
    """A word with a letter put in, with a letter left out and with a letter doubled, places told by the
    word itself."""
    place = 1 + sum(map(ord, word)) % max(len(word) - 1, 1)
    extra = chr(97 + sum(map(ord, word)) % 26)
    return [word[:place] + extra + word[place:], word[:place] + word[place + 1 :], word[:place] + word[place - 1 :]]


def training_rows(rows: DataFrame, labels: DataFrame, learnable, documents: int) -> DataFrame:
    """text and label of at most about `documents` rows (doc_id, text): those of the labelled ids that
    `learnable` admits with the smallest keyed hash. The sample of ids is small enough to broadcast."""
    ids = with_label(pick(labels, "doc_id").where("doc_id is not null").distinct(), labels, "toxic").where(learnable)
    chosen = ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(documents)
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """Each labelled text once per label, however many documents hold it."""
    known = staged(labelled.withColumn("_key", F.xxhash64("text")), "toxicity-train")
    first = known.groupBy("_key", "label").agg(F.min("doc_id").alias("doc_id"))
    kept = known.join(F.broadcast(first), ["_key", "label", "doc_id"], "left_semi")
    return staged(kept.select("text", "label"), "toxicity-texts")


def instances(counts: DataFrame, landmarks: Landmarks, plain: float, n1: float, n0: float) -> DataFrame:
    """word, label, n, near: words that are like a telling landmark, by the shares of toxic and clean texts
    that hold them, the toxic also disguised; and words of clean texts, of those unlike any the share
    `plain`."""

    def make(batches):
        for batch in batches:
            words, a, b, sample = (c.to_pylist() for c in batch.columns)
            rows = []
            for lo in range(0, len(words), 2_000):
                near = landmarks.similarity(words[lo : lo + 2_000]).max(axis=1).tolist()
                for i, like in enumerate(near, lo):
                    if b[i] and (like >= ALIKE or sample[i] < plain):
                        rows.append((words[i], 0.0, b[i] / n0, like >= ALIKE))
                    if a[i] and like >= WITNESS:
                        rows.append((words[i], 1.0, a[i] / n1, True))
                        if len(words[i]) > 5:
                            rows += [(f"^{w}$", 1.0, a[i] / n1 / 4, True) for w in obfuscated(words[i][1:-1])]
            if rows:
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "n", "near"])

    words = counts.where(F.col("part").like("^%$"))
    sample = (F.pmod(F.xxhash64(F.lit(5), "part"), F.lit(1_000_000)) / 1_000_000).alias("sample")
    return words.select("part", "a", "b", sample).mapInArrow(make, "word string, label double, n double, near boolean")


def fit(labelled: DataFrame) -> Model | None:
    """Fit on labelled (doc_id, text as bytes, label); None if a label or any telling part is missing.

    Landmarks are parts of words that tell toxic texts from clean ones, and common words. A word's Nyström
    features are its kernels with the landmarks times an inverse root of the landmarks' own kernels. The
    support vector machine learns words: of clean sentences, and those of toxic texts that are like a
    telling landmark, as they are and disguised. A logistic curve takes a document's worst sentence and its
    amount of toxic words to the score.
    """
    train = distinct_texts(labelled)
    n1, n0 = train.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n1 or not n0:
        return None
    counts = count_parts(train)
    toxic, common = choose_landmarks(counts, n1, n0)
    if not toxic:
        return None
    landmarks = Landmarks([*toxic, *common])
    values, vectors = np.linalg.eigh(landmarks.table.T @ landmarks.table)
    kept = values > 1e-2
    root = vectors[:, kept] / np.sqrt(values[kept])
    plain = min(1.0, PLAIN_WORDS / max(counts.where(F.col("part").like("^%$") & (F.col("b") > 0)).count(), 1))
    rows = staged(instances(counts, Landmarks(toxic), plain, n1, n0), "toxicity-instances")
    total = dict(rows.groupBy("near").agg(F.sum("n")).collect())
    if len(total) < 2:
        return None
    # Words like a landmark weigh as their shares of either label say, all other words as much as they together.
    svm = LinearSVC(maxIter=50, regParam=1e-4, standardization=False, weightCol="weight").fit(
        _weighed(rows, "near", total, lambda words: landmarks.similarity(words) @ root)
    )
    gain = landmarks.table @ (root @ svm.coefficients.toArray())
    model = Model(landmarks.codes, gain, float(svm.intercept))

    def features(batches):
        known = Decisions(model)
        for batch in batches:
            f = known.batch(batch.column(0)).round(2)
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), batch.column(1)], names=["features", "label"])

    found = train.select("text", "label").mapInArrow(features, "features array<double>, label double")
    found = staged(found.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("n")), "toxicity-decisions")
    # A toxic label without any toxic word does not tell where the curve lies; the share of toxic documents
    # among the labelled ones is not to move the score; more toxic words never lower it.
    found = found.where((F.col("label") == 0) | (F.element_at("features", 1) > 0))
    total = dict(found.groupBy("label").agg(F.sum("n")).collect())
    if len(total) < 2:
        return None
    rising = LogisticRegression(maxIter=100, regParam=1e-4, weightCol="weight", lowerBoundsOnCoefficients=DenseMatrix(1, 3, [0.0] * 3))
    link = rising.fit(_weighed(found, "label", total))
    model.link = np.array([*link.coefficients.toArray(), float(link.intercept)])
    return model


def _weighed(rows: DataFrame, by: str, total: dict, image=None) -> DataFrame:
    """Rows for a classifier; both values of `by` have equal weight. Two partitions of told content and
    order: sums, and so the fit, do not depend on where rows were made. With `image` the features are
    that of the words, made behind the exchange, which carries words only."""
    even = F.when(F.col(by).cast("double") == 1, F.lit(500 / total[1.0])).otherwise(F.lit(500 / total[0.0]))
    key = "word" if image else "features"
    dealt = rows.select(key, "label", (F.col("n") * even).alias("weight")).repartition(2, key).sortWithinPartitions(key, "label", "weight")

    def make(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                cut = batch.slice(lo, 2_000)
                features = pa.array(list(image(cut.column(0).to_pylist())), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([features, *cut.columns[1:]], names=["features", "label", "weight"])

    if image:
        dealt = dealt.mapInArrow(make, "features array<double>, label double, weight double")
    return dealt.select(array_to_vector("features").alias("features"), "label", "weight")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Labels of rows whose CRC-32 fold is `held_out` are never learned. Null and empty texts have the score
    of a text without any suspicious word; repeated rows each come back; without labels of both
    kinds the score is 0; labels of unknown documents are ignored; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").select("doc_id", utf8("text").alias("text"))
    out = fold("doc_id", folds) == held_out
    model = fit(training_rows(rows, labels, ~out, documents))
    scored = scores(rows, 1, model).toDF("doc_id", "text", "score")
    done = scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "score")
    return done.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Rows of docs, all columns, whose score is below `least`; learned from all labels of docs."""
    wide = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    train = pick(docs, "doc_id", "text").select("doc_id", utf8("text").alias("text"))
    model = fit(training_rows(train, labels, F.lit(True), documents))
    scored = scores(wide, docs.columns.index("text"), model)
    return scored.where(F.col("score") < least).select(wide.columns).toDF(*docs.columns)


def scores(rows: DataFrame, at: int, model: Model | None) -> DataFrame:
    """All columns of rows, and score of the text (string or bytes) in column number `at`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        m = shared.value
        known = m and Decisions(m)
        for batch in batches:
            s = m.score(known.batch(batch.column(at))) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")
