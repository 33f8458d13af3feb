"""Near-duplicate groups by similarity of shingle sets: long SimHash fingerprints find, Jaccard decides.

Two sets whose Jaccard similarity is 0.8 differ in about 15 % of their fingerprint bits, far beyond the few
bits that two halves of 64 can bridge. Here the fingerprint is as long as it must be, cut into segments, and
the Hamming ball around a segment holds the changes that are likely: those of its least certain bits, whose
counts lie next to half. A pair that shares a bucket is compared by a further 64 bits, then by its sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridcast.llm import words
from gridcast.llm.common import per_batch, release, staged, utf8
from gridcast.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits of a segment that are flipped in all combinations.
UNCERTAIN = 3
#: Differing bits of 64 up to which a pair is compared exactly: a similarity of 0.8 gives 9.7 on average with
#: a deviation of 2.9, unrelated texts 32 with one of 4.
CHECK_BITS = 19
#: Classes of one group in one bucket beyond which that group's own probes pass the bucket by.
DENSE = 64

_GOLDEN = 0x9E3779B97F4A7C15
_BLOCK = 1 << 15


def segments_for(rows: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for a table of so many rows.

    A bucket shall hold about one unrelated row, hence log2(rows) bits, at least 16. The longer a segment,
    the rarer is one whose changes all fall on its uncertain bits; the number of segments makes up for it,
    so that a pair of similarity 0.8 is met with a probability of 0.97 at any size (0.4 a segment of 16
    bits, by a factor of 1.164 fewer with each further bit, from simulated fingerprints).
    """
    bits = max(16, math.ceil(math.log2(max(rows, 2))))
    return bits, math.ceil(6.8 * 1.164 ** (bits - 16))


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: words between white space, A-Z
    lower-cased. Fewer words than `size` are one shingle, no words none."""
    for chunk in words.chunks([t.lower() for t in texts]):
        hashed = words.word_hashes(chunk)
        windows = words.window_hashes(hashed, size)
        for lo, hi in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(windows[lo : hi - size + 1])
            else:
                yield words.window_hashes(hashed[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray, bits: int, segments: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Check word, segment values and, per segment, a mask of its least certain bits.

    A bit of the SimHash is set if it is in over half of the shingles' hashes; how far the count is from
    half tells how likely a similar set has the other value.
    """
    count = -(-(64 + bits * segments) // 64)
    ones = np.zeros(count * 64, np.int64)
    seeds = (np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_GOLDEN))[None, :]
    for lo in range(0, len(shingles), _BLOCK):
        values = words.mix(shingles[lo : lo + _BLOCK, None] + seeds)
        ones += np.unpackbits(values.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    lead = 2 * ones - len(shingles)
    check = int(np.packbits(lead[:64] > 0, bitorder="little").view(np.int64)[0])
    cut = lead[64 : 64 + bits * segments].reshape(segments, bits)
    place = np.int64(1) << np.arange(bits, dtype=np.int64)
    doubtful = np.argsort(np.abs(cut), axis=1, kind="stable")[:, :UNCERTAIN]
    return check, (cut > 0) @ place, place[doubtful].sum(axis=1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns _in0, _in1, ... as given, _id, _text (bytes) and _tid, which tells rows of one id apart."""
    wide = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    key, text = (f"_in{docs.columns.index(c)}" for c in (id_col, text_col))
    return wide.withColumn("_id", F.col(key)).withColumn("_text", utf8(text)).withColumn("_tid", F.xxhash64("_text"))


def _features(keyed: DataFrame, size: int, bits: int, segments: int) -> DataFrame:
    """_id, _tid, cls (hash of the shingle set), n (its size), check, segs and masks of every row."""
    name = keyed.schema["_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for s in shingle_sets(batch.column(2).to_pylist(), size):
            check, segs, masks = fingerprint(s, bits, segments)
            cls = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))
            found.append((cls, len(s), check, segs.tolist(), masks.tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        made = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *made], names=["_id", "_tid", "cls", "n", "check", "segs", "masks"]
        )

    schema = f"_id {name}, _tid bigint, cls bigint, n bigint, check bigint, segs array<bigint>, masks array<bigint>"
    return per_batch(keyed.select("_id", "_tid", "_text"), schema, make)


def _sets(wanted: DataFrame, classes: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """cls and s (its shingles) of the wanted classes, read from one text of each."""
    at = wanted.join(classes, "cls").select("cls", F.col("best._id").alias("_bid"), F.col("best._tid").alias("_btid"))
    same = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_tid") == F.col("_btid"))
    texts = keyed.select("_id", "_tid", "_text").join(at, same).select("cls", "_text")

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, s in enumerate(shingle_sets(batch.column(1).to_pylist(), size)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["cls", "s"]
            )

    sets = staged(per_batch(texts, "cls bigint, s array<bigint>", make).dropDuplicates(["cls"]), "similar-sets")
    # The texts were shuffled to find those of the classes; their shuffle files are of no more use.
    release(keyed.sparkSession)
    return sets


def _similar(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs u, v of classes whose shingle sets have that Jaccard similarity."""
    sets = _sets(pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct(), classes, keyed, size)
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    # The margin takes up rounding of the product, far below one shingle.
    enough = F.col("common") >= similarity * (F.size("a") + F.size("b") - F.col("common")) - 1e-6
    return both.where(enough).select("u", "v")


def _families(labels: DataFrame, classes: DataFrame, table: DataFrame, probes: DataFrame, dense: int) -> DataFrame:
    """cls and centre: classes that meet a group of over `dense` classes and lie near its centre, the member
    whose check word is nearest to the most common bits of the group."""
    rows = labels.join(classes.select("cls", "check"), "cls")
    ones = F.array(*[F.sum(F.expr(f"shiftright(check, {i}) & 1")).alias(f"b{i}") for i in range(64)])
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), ones.alias("ones")).where(F.col("n") > dense)
    word = F.expr("aggregate(transform(ones, (o, i) -> if(2 * o > n, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    far = F.expr("bit_count(check ^ most)")
    centre = rows.join(sums.select("label", word.alias("most")), "label").groupBy("label").agg(F.min(F.struct(far, "cls", "check")).alias("c"))
    centre = staged(centre.select("label", F.col("c.cls").alias("centre"), F.col("c.check").alias("cc")), "similar-centres")
    places = table.join(labels.toDF("v", "label"), "v").join(centre, "label").select("bucket", "centre", "cc").distinct()
    near = probes.join(places, "bucket").where(_near("cu", "cc")).select("u", F.expr("bit_count(cu ^ cc)").alias("d"), "centre")
    return staged(near.groupBy(F.col("u").alias("cls")).agg(F.min(F.struct("d", "centre")).alias("m")).select("cls", "m.centre"), "similar-families")


def _within(families: DataFrame, classes: DataFrame, keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links u, v that join all similar classes of a family, without comparing all its pairs.

    Each class stands for its difference to the centre. Classes similar to the centre are linked to it; a
    pair is then open only if one of both is not, so that its difference is large and, for the pair to be
    similar, most of the smaller difference must be shared. So one of its rarest elements must be shared
    (prefix filter), and these are mostly of one class only. No similar pair is lost.
    """
    ends = families.select("cls").union(families.select("centre")).distinct()
    sets = _sets(ends, classes, keyed, size)
    both = families.join(sets, "cls").join(sets.toDF("centre", "c"), "centre")
    delta = F.array_union(F.array_except("s", "c"), F.array_except("c", "s"))
    rows = both.select("centre", "cls", F.size("s").alias("n"), F.size("c").alias("nc"), delta.alias("delta")).withColumn("d", F.size("delta"))
    # The symmetric difference of a similar pair is at most this share of the sum of both sizes.
    share, most = (1 - similarity) / (1 + similarity), F.least(F.col("n") / similarity, F.col("nc") + F.col("d"))
    rows = rows.withColumn("close", F.col("d") <= share * (F.col("n") + F.col("nc")) + 1e-6)
    # Elements that a similar class with an equal or larger difference must share with it, at least.
    close = F.floor((F.col("d") + share * (F.col("nc") - F.col("n"))) / 2) + 1
    least = F.when(F.col("close"), close).otherwise(F.ceil((2 * F.col("d") - F.floor(share * (F.col("n") + most) + 1e-6)) / 2))
    rows = staged(rows.withColumn("need", F.greatest(F.lit(1), least)), "similar-deltas")
    parts = rows.select("centre", "cls", "n", "d", "need", "close", F.explode("delta").alias("e"))
    often = parts.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = Window.partitionBy("centre", "cls")
    ranked = parts.join(often, ["centre", "e"]).withColumn("h", F.count(F.lit(1)).over(own))
    ranked = staged(ranked.withColumn("q", F.row_number().over(own.orderBy("k", "e"))).select("centre", "e", F.struct("cls", "n", "d", "close", "h", "q", "need").alias("x")), "similar-ranks")
    other = ranked.withColumnRenamed("x", "y")
    shared = f"(x.d + y.d - {share} * (x.n + y.n)) / 2 - 1e-6"
    pairs = ranked.where("x.q <= x.h - x.need + 1").join(other, ["centre", "e"]).where(
        "not (x.close and y.close) and (x.d < y.d or (x.d = y.d and x.cls < y.cls))"
        f" and y.d - x.d <= {share} * (x.n + y.n) + 1e-6"
        f" and least(x.q, y.q) + least(x.h - x.q, y.h - y.q) >= {shared}"
    )
    pairs = pairs.select(F.col("x.cls").alias("x"), F.col("y.cls").alias("y"))
    pairs = staged(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "similar-within")
    hub = rows.where("close and cls != centre").select(F.least("cls", "centre").alias("u"), F.greatest("cls", "centre").alias("v"))
    return staged(hub.union(_similar(pairs, classes, keyed, size, similarity)), "similar-hubs")


def _near(u: str, v: str) -> str:
    return f"bit_count({u} ^ {v}) <= {CHECK_BITS}"


def groups(keyed: DataFrame, size: int, similarity: float, dense: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets (cls, best: first row by id) and labels (cls, label) of those in a
    group of several classes.

    First every class is compared with the smallest and the largest class of each of its buckets, which
    joins the bulk of a large group by a number of pairs that grows with the group, not with its square.
    Classes around the centre of a group of over `dense` classes are a family, whose links are found by
    differences to that centre. Then every class probes all its balls, and pairs not yet in one group are
    compared. Members of a family, and of a group with over `dense` classes in a bucket, are not met by
    probes of their own.
    """
    bits, segments = segments_for(keyed.count())
    rows = staged(_features(keyed, size, bits, segments), "similar-features")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_tid")).alias("best")
    like = [F.first(c).alias(c) for c in ("n", "check", "segs", "masks")]
    classes = staged(rows.groupBy("cls").agg(first, *like), "similar-classes")

    def bucket(value: str) -> str:
        return f"shiftleft(cast(s as bigint), {bits}) | {value}"

    spread = classes.where("n > 0").select("cls", "check", F.posexplode(F.arrays_zip("segs", "masks")).alias("s", "z"))
    table = spread.select(F.expr(bucket("z.segs")).alias("bucket"), F.col("cls").alias("v"), F.col("check").alias("cv"))
    a, b = "z.masks & -z.masks", "(z.masks & (z.masks - 1)) & -(z.masks & (z.masks - 1))"
    low = spread.select("cls", "check", "s", F.col("z.segs").alias("g"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.col("z.masks").alias("m"))
    low = low.withColumn("c", F.expr("m ^ a ^ b"))
    ball = F.expr("transform(array(0L, a, b, c, a | b, a | c, b | c, m), f -> " + bucket("(g ^ f)") + ")")
    probes = low.select(F.explode(ball).alias("bucket"), F.col("cls").alias("u"), F.col("check").alias("cu"))

    ends = table.groupBy("bucket").agg(*[f(F.struct("v", "cv")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    pivots = ends.where("lo.v < hi.v").select("bucket", F.explode(F.array("lo", "hi")).alias("p"))
    stars = table.join(pivots, "bucket").where("v != p.v and " + _near("cv", "p.cv"))
    stars = stars.select(F.least("v", "p.v").alias("u"), F.greatest("v", "p.v").alias("v")).distinct()
    linked = staged(_similar(staged(stars, "similar-stars"), classes, keyed, size, similarity), "similar-links")
    labels = components(linked).withColumnRenamed("node", "cls")

    families = _families(labels, classes, table, probes, dense)
    if not families.isEmpty():
        linked = staged(linked.union(_within(families, classes, keyed, size, similarity)).distinct(), "similar-links")
        labels = components(linked).withColumnRenamed("node", "cls")

    # Families are settled; other groups are told apart by their label where a bucket holds many of one.
    kin = labels.select("cls", F.struct(F.lit(0).alias("kind"), F.col("label").alias("key")).alias("g"))
    ours = families.select("cls", F.struct(F.lit(1).alias("kind"), F.col("centre").alias("key")).alias("g"))
    own = staged(kin.join(ours.select("cls"), "cls", "left_anti").union(ours), "similar-own")
    grouped = table.join(own.toDF("v", "g"), "v").groupBy("bucket", "g").count()
    crowds = staged(grouped.where((F.col("count") > dense) | (F.col("g.kind") == 1)).select("bucket", "g"), "similar-crowds")
    if crowds.isEmpty():
        met = probes.join(table, "bucket")
    else:
        members = table.join(own.toDF("v", "g"), "v", "left").join(crowds.withColumn("crowd", F.col("g")), ["bucket", "g"], "left")
        seen = probes.join(own.toDF("u", "g"), "u", "left")
        others = seen.join(crowds.toDF("bucket", "crowd"), "bucket").where("g is null or g != crowd")
        plain = members.where("crowd is null").select("bucket", "v", "cv")
        packed = members.where("crowd is not null").select("bucket", "crowd", "v", "cv")
        met = probes.join(plain, "bucket").select("u", "cu", "v", "cv").union(
            others.join(packed, ["bucket", "crowd"]).select("u", "cu", "v", "cv")
        )
    met = met.where("u != v and " + _near("cu", "cv")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    met = met.distinct().join(labels.toDF("u", "lu"), "u", "left").join(labels.toDF("v", "lv"), "v", "left")
    open_pairs = staged(met.where("coalesce(lu, u) != coalesce(lv, v)").select("u", "v"), "similar-pairs")
    release(keyed.sparkSession)
    more = staged(_similar(open_pairs, classes, keyed, size, similarity), "similar-more")
    if not more.isEmpty():
        labels = components(linked.union(more)).withColumnRenamed("node", "cls")
    return classes, labels


def one_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    dense: int = DENSE,
) -> DataFrame:
    """Rows of docs, all columns, one per group of texts linked by a Jaccard similarity of their shingle sets
    of `similarity` or more: the row with the smallest doc_id (null ids last, then the smallest text hash; of
    rows equal in id and text any).

    Every link is verified; a pair right at 0.8 is met with a probability of about 0.97, closer ones with
    more. Null texts count as empty; texts without words are one group. Texts of fewer words than a shingle
    are alike if their words are equal. Rows may repeat, also under one id with several texts. An empty table
    gives no rows; names of other columns do not matter. Sets are compared as 64-bit hashes of shingles.
    """
    keyed = _keyed(docs, id_col, text_col)
    classes, labels = groups(keyed, size, similarity, dense)
    named = classes.select("cls", "best").join(labels, "cls", "left")
    best = named.groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("best").alias("best"))
    best = staged(best.select(F.col("best._id").alias("_bid"), F.col("best._tid").alias("_btid")), "similar-best")
    release(docs.sparkSession)
    same = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_tid") == F.col("_btid"))
    kept = keyed.join(best, same, "left_semi")
    repeated = keyed.groupBy("_id", "_tid").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["_id", "_tid"])
    return kept.select([f"_in{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
