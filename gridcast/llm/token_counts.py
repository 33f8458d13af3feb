"""Token counts of a SentencePiece BPE model, one count per distinct pre-token."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import pick, release, staged, text_key, utf8

#: Pre-tokens of the broadcast part of the count table, the most frequent ones; the rest is joined.
FREQUENT = 500_000
#: Bytes of a pre-token of the broadcast part, at most; longer ones are joined.
SHORT = 64
#: Distinct pre-tokens that a task holds before it passes their frequencies on.
HELD = 1_000_000
_SPACE = "▁"


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def pretoken_pattern(model: bytes) -> str:
    """A pattern that cuts a text into pre-tokens which no piece of the model can straddle.

    A merge needs a piece that holds both sides of the cut. Cuts are made before a run of spaces (no
    piece may hold a space after another character) and around characters that occur in no longer
    piece, such as line breaks and, in many models, digits. A model that breaks the first rule, or whose
    line break can merge, is refused.
    """
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
        raise ValueError("a piece of this model spans words")
    merged = {c for p in pieces if len(p) > 1 for c in p}
    alone = "".join(sorted({c for c in map(chr, range(128)) if c not in merged and c != " "}))
    if "\n" not in alone or len(sp.encode("\n\n")) != len(sp.encode("\n")) + 1:
        raise ValueError("this model has pieces with line breaks")
    alone = re.escape(alone)
    return f"[{alone}]|[ {_SPACE}]+[^ {_SPACE}{alone}]*|[^ {_SPACE}{alone}]+"


def count_tokens(docs: DataFrame, model: bytes, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, as the model's library counts them.

    A null text counts as empty; an empty text has no tokens; repeated rows each come back; a null doc_id
    stays null; an empty table gives no rows; other columns are not looked at.

    One pass collects the frequencies of distinct pre-tokens, each is encoded once, and a second pass
    makes the per-document frequencies. The counts of the `frequent` most frequent pre-tokens of at
    most SHORT bytes are broadcast and summed where the document is; all others are joined.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    rows = text_key(rows, "doc_id")
    pattern, shared_model = pretoken_pattern(model), spark.sparkContext.broadcast(model)

    seen = rows.select("text").mapInArrow(_frequencies(pattern), "token string, freq bigint")
    counts = seen.groupBy("token").agg(F.sum("freq").alias("freq"))
    counts = staged(counts.mapInArrow(_pieces(shared_model), "token string, freq bigint, pieces int"), "token-counts")
    release(spark)
    top = counts.where(F.octet_length("token") <= SHORT).orderBy(F.desc("freq"), "token").limit(frequent).select("token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["pieces"].to_pylist(), strict=True)))

    parts = rows.mapInArrow(_documents(pattern, known), f"doc_id {kind}, tid bigint, token string, freq int, base struct<n_bytes: bigint, known: bigint>")
    joined = parts.join(counts.select("token", "pieces"), "token", "left")
    total = F.sum(F.coalesce("base.known", F.lit(0)) + F.col("freq").cast("bigint") * F.coalesce("pieces", F.lit(0)))
    base = F.count("base").alias("rows"), F.max("base.n_bytes").alias("n_bytes")
    out = joined.groupBy("doc_id", "tid").agg(*base, total.alias("total"))
    # Equal rows fall into one group, which holds their counts `rows` times.
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
    return out.select("doc_id", "n_bytes", F.expr("total div rows").alias("n_tokens"))


def _spaced(text: bytes) -> str:
    return " " + text.decode() if text else ""


def _frequencies(pattern: str):
    def run(batches):
        find = re.compile(pattern).findall
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(find(_spaced(text)))
                if len(held) >= HELD:
                    yield _batch(held)
                    held = Counter()
        if held:
            yield _batch(held)

    return run


def _batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["token", "freq"])


def _pieces(model):
    def run(batches):
        sp = load(model.value)
        # The line break before a pre-token keeps the library's own leading space away from it.
        base = len(sp.encode("\n"))
        for batch in batches:
            sizes = [len(sp.encode("\n" + t)) - base for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32())], names=["token", "freq", "pieces"])

    return run


def _documents(pattern: str, known):
    def run(batches):
        find = re.compile(pattern).findall
        pieces = known.value
        for batch in batches:
            at, base, tokens, freqs = [], [], [], []
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                total, rare = 0, []
                for token, n in Counter(find(_spaced(text))).items():
                    p = pieces.get(token)
                    if p is None:
                        rare.append((token, n))
                    else:
                        total += p * n
                # Two line breaks never are a pre-token: this key meets no row of the count table.
                for k, (token, n) in enumerate(rare or [(f"\n\n{ids[i]}", 0)]):
                    at.append(i)
                    base.append(None if k else {"n_bytes": len(text), "known": total})
                    tokens.append(token)
                    freqs.append(n)
                if len(at) > 200_000:
                    yield _rows(batch, at, base, tokens, freqs)
                    at, base, tokens, freqs = [], [], [], []
            if at:
                yield _rows(batch, at, base, tokens, freqs)

    return run


def _rows(batch, at, base, tokens, freqs):
    at = pa.array(at, pa.int64())
    kind = pa.struct([("n_bytes", pa.int64()), ("known", pa.int64())])
    arrays = [batch.column(0).take(at), batch.column(2).take(at), pa.array(tokens, pa.string()), pa.array(freqs, pa.int32())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(base, kind)], names=["doc_id", "tid", "token", "freq", "base"])
