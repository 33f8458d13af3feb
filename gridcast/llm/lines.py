"""Removal of repeated lines: hashes range-partitioned, sorted by document and position, streamed.

DataFrame functions only. The result of the search is a bitmap per document, compressed as runs of kept
lines, so texts are moved once at most, and only when the caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import pick, staged, text_key

LEAST_CHARS, LEAST_DOCS = 40, 5
#: A key is hot if it holds more than HOT_LEAST lines and more than one in HOT_SHARE of all lines, so there
#: are fewer than HOT_SHARE hot keys, of 24 bytes each, whatever the tables' size.
HOT_LEAST, HOT_SHARE = 1_000, 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: str = "text") -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case and all other letters as they are."""
    bare = F.btrim(line, F.lit(_BLANKS))
    # Plain ASCII is lowered as a whole, which is much faster than letter by letter.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(rows: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, id, tid, pos) of every line whose key is long enough; h1 and h2 are XXH64 of the key under
    two seeds, 128 bits together."""
    lines = rows.where("id is not null").select("id", "tid", F.posexplode(text_lines()).alias("pos", "line"))
    # The key is never longer than its line, so short lines leave before any work on them.
    keys = lines.where(F.octet_length("line") >= least_chars).select("id", "tid", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "tid", "pos"
    )


def repeated_lines(
    rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot: tuple[int, int] = (HOT_LEAST, HOT_SHARE)
) -> DataFrame:
    """(id, tid, pos) of the lines to drop. rows: id, tid (tells rows of one id apart) and text.

    The hashes are written once. Keys of few lines are range-partitioned by hash, sorted by document
    (largest first) and position, and streamed: the first document of a key keeps its lines, the later
    ones lose theirs if the key's documents number enough. A hot key would fill one partition; its
    documents are counted by a combined aggregate and its rows settled where they are, by a broadcast of
    at most `HOT_SHARE` keys.
    """
    lines = staged(line_hashes(rows, least_chars), "lines-hashes")
    share = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(hot[0]), F.lit(lines.count() // hot[1]))
    hot_keys = staged(share.where(F.col("n") > limit).select("h1", "h2"), "lines-hot")
    key = ["h1", "h2"]

    # Rows of one id are parts of one document, and a document counts once for a key.
    many = lines.join(F.broadcast(hot_keys), key).select("h1", "h2", "id").distinct()
    settled = many.groupBy(key).agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs)
    settled = staged(settled.select("h1", "h2", "last"), "lines-settled")
    hot_drops = lines.join(F.broadcast(settled), key).where("id < last").select("id", "tid", "pos")

    few = lines.join(F.broadcast(hot_keys), key, "left_anti").repartitionByRange("h1", "h2")
    group = Window.partitionBy("h1", "h2")
    streamed = few.withColumn("rank", F.dense_rank().over(group.orderBy(F.col("id").desc())))
    streamed = streamed.withColumn("docs", F.max("rank").over(group))
    few_drops = streamed.where((F.col("rank") > 1) & (F.col("docs") >= least_docs)).select("id", "tid", "pos")
    return hot_drops.unionByName(few_drops)


def keep_bitmaps(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    hot: tuple[int, int] = (HOT_LEAST, HOT_SHARE),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, tid, dropped, kept) of the documents that lose a line: the number of lost lines and the bitmap of
    the kept ones, as runs (first, count) between the lost ones; the last run is open (count null).

    Lines are what lies between line feeds. A line's key is the line without white space (space, 0x09-0x0D)
    at both ends, A-Z lowered. Keys of at least `least_chars` code points in at least `least_docs` documents
    lose all their lines but those in the document with the largest id. Rows that share an id are parts of
    one document. A row without an id neither loses lines nor counts for others; a null text has one empty
    line; an empty table has no row; other columns are not looked at. The result is a written table.
    """
    rows = text_key(pick(docs, id_col, text_col).toDF("id", "text"), "id")
    # A row that occurs several times has the same lines each time.
    drops = repeated_lines(rows, least_chars, least_docs, hot).groupBy("id", "tid").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    runs = F.transform(
        before,
        lambda p, i: F.struct((p + 1).alias("first"), (F.get("gone", i) - p - 1).alias("count")),
    )
    bitmaps = drops.select("id", "tid", F.size("gone").cast("bigint").alias("dropped"), F.filter(runs, lambda r: r["count"].isNull() | (r["count"] > 0)).alias("kept"))
    return staged(bitmaps, "lines-bitmaps")


def without_repeated_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    hot: tuple[int, int] = (HOT_LEAST, HOT_SHARE),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept_text) of every row: its text with the lines of its bitmap only, see
    `keep_bitmaps`. A document without a bitmap keeps all; one that loses all lines has an empty text."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs, hot, id_col, text_col)
    rows = text_key(pick(docs, id_col, text_col).toDF("id", "text"), "id")
    # Bitmaps grow with the documents, so the join is the same, by shuffle, at every size.
    joined = rows.join(bitmaps.hint("merge"), ["id", "tid"], "left").withColumn("lines", text_lines())
    count = F.size("lines")
    left = F.flatten(
        F.transform("kept", lambda r: F.slice("lines", r["first"] + 1, F.coalesce(r["count"], count - r["first"])))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    return joined.select(
        F.col("id").alias(id_col),
        count.cast("bigint").alias("n_lines"),
        F.coalesce("dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.when(F.col("kept").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )
