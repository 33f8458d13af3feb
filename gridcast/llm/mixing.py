"""Mixing sources to target weights: temperature, and block permutations that spend a token budget.

DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridcast.llm.common import pick, staged

WORD = r"[^\x20\x09-\x0D]+"
#: The exponent is sought in [0, HIGHEST], so weights are never steeper than shares; LEVELS halvings are settled in one pass over the sources.
HIGHEST, LEVELS, PASSES = 1.0, 5, 8
NO_SOURCE = "(none)"


def tokens_of(text: str = "text") -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_tokens(sized: DataFrame) -> DataFrame:
    """source, docs and tokens per source, from a table with source and tokens."""
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


def exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None, budget_ratio: float | None = 1.0) -> float:
    """The exponent a of the weights share**a / sum(share**a), found by bisection.

    entropy: the target, as a part of the largest entropy log(sources) that the sources allow; the
    weights' entropy falls as a grows. repetition: the largest number of times that a budget of
    budget_ratio times all tokens (None: the smallest budget that reads every source once whole) may read
    a source; a is the smallest that keeps to it, at most 1.
    With both, the larger a counts: the limit on repetition is kept where the two disagree. Targets out
    of reach give the nearer end of the range; sources without tokens take no part; none at all, or a
    single one, give 1.
    """
    everything = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(everything)).alias("logp"))
    shares = staged(shares, "mixing-shares")
    n = shares.count()
    if n < 2:
        return 1.0
    found = []
    if entropy is not None:
        found.append(_bisect(shares, HIGHEST, lambda a, z, s, _: math.log(z) - a * s / z >= entropy * math.log(n)))
    if repetition is not None:
        # Weight over share is largest where the share is smallest.
        over = lambda a, z, _, low: budget_ratio * math.exp((a - 1) * low) / z > repetition
        if budget_ratio is None:
            # The largest source is read once and the smallest (largest share / smallest share)**(1 - a) times.
            high = shares.agg(F.max("logp")).first()[0]
            over = lambda a, z, _, low: math.exp((1 - a) * (high - low)) > repetition
        found.append(_bisect(shares, 1.0, over))
    return max(found) if found else 1.0


def _bisect(shares: DataFrame, high: float, below) -> float:
    """The end of the exponents for which below(a, sum p**a, sum p**a log p, smallest log p) holds. A pass
    sums for all midpoints that the next LEVELS halvings can meet: they are rows, so that every pass is the
    same short plan; a column for each would be compiled anew with each pass, in the driver too."""
    low = 0.0
    power = F.exp(F.col("a") * F.col("logp"))
    for _ in range(PASSES):
        grid = [low + (high - low) * i / (1 << LEVELS) for i in range(1, 1 << LEVELS)]
        tried = shares.select("logp", F.posexplode(F.lit(grid)).alias("i", "a"))
        sums = tried.groupBy("i").agg(F.sum(power), F.sum(power * F.col("logp")), F.min("logp"))
        rows = {i: found for i, *found in sums.collect()}
        at = 0
        for step in (1 << k for k in reversed(range(LEVELS))):
            i = at + step - 1
            if below(grid[i], *rows[i]):
                at += step
        width = (high - low) / (1 << LEVELS)
        low, high = low + width * at, low + width * (at + 1)
    return (low + high) / 2


def mixture(docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 4.0, budget_ratio: float | None = 1.0, seed: int = 0) -> DataFrame:
    """The columns of docs with, per row, mix_tokens, mix_weight (its source's weight), mix_quota (tokens
    that the source may spend), mix_block, mix_place (tokens of the source's permutation up to and
    including this row) and mix_copies (times that the row is read).

    A source's rows are permuted by blocks: about the square root of its rows are blocks, a keyed hash
    of id and text deals rows to blocks and orders them there, so neither the blocks of the largest source nor the
    rows of a block are many. The quota pays for whole passes over the permutation, and a last pass pays
    for the rows that end within what is left. budget_ratio: the budget as a multiple of all tokens;
    None: the smallest budget that reads every source once whole.

    A null source is a source of its own (named NO_SOURCE); null and empty texts have no tokens and are
    read as often as the source is read whole, without end of quota; a source without any tokens is read
    once; equal rows are interchangeable and keep places of their own; an empty table gives no rows;
    columns of docs named like a result column, in any case, are replaced.
    """
    new = ["mix_tokens", "mix_weight", "mix_quota", "mix_block", "mix_place", "mix_copies"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    source = F.coalesce("source", F.lit(NO_SOURCE)).alias("source")
    sized = pick(docs, "source", "text", "doc_id").toDF("source", "text", "id").select(source, tokens_of().alias("tokens"))
    sources = staged(source_tokens(sized), "mixing-sources")
    a = exponent(sources, entropy, repetition, budget_ratio)

    everything = sources.agg(F.sum("tokens")).first()[0] or 0
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(everything)))).otherwise(0.0)
    powers = sources.withColumn("power", power)
    norm, widest = powers.agg(F.sum("power"), F.max(F.col("tokens") / F.nullif("power", F.lit(0.0)))).first()
    norm, widest = norm or 1.0, widest or 0.0
    budget = everything * budget_ratio if budget_ratio is not None else norm * widest
    weight = F.col("power") / F.lit(norm)
    plan = powers.select(
        "source",
        F.col("tokens").alias("of"),
        weight.alias("mix_weight"),
        F.round(weight * F.lit(float(budget))).cast("bigint").alias("mix_quota"),
        F.ceil(F.sqrt("docs")).cast("bigint").alias("blocks"),
    )
    plan = staged(plan, "mixing-plan")

    wide = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    at = {n: F.col(f"_in{docs.columns.index(n)}") for n in ("doc_id", "text", "source")}
    rows = wide.select("*", F.coalesce(at["source"], F.lit(NO_SOURCE)).alias("source"), at["text"].alias("text"), at["doc_id"].alias("id"))
    rows = rows.withColumns({"mix_tokens": tokens_of(), "key": key}).drop("text", "id")
    number = F.conv(F.substr("key", F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    rows = rows.join(plan, "source").withColumn("mix_block", number % F.col("blocks"))
    held = rows.groupBy("source", "mix_block").agg(F.sum("mix_tokens").alias("in_block"))
    before = F.sum("in_block").over(Window.partitionBy("source").orderBy("mix_block")) - F.col("in_block")
    held = staged(held.select("source", "mix_block", before.alias("before")), "mixing-blocks")
    within = Window.partitionBy("source", "mix_block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(held, ["source", "mix_block"]).withColumn("mix_place", F.col("before") + F.sum("mix_tokens").over(within))
    left = F.expr("mix_quota % nullif(of, 0)")
    copies = F.when(F.col("of") == 0, F.lit(1)).otherwise(F.expr("mix_quota div nullif(of, 0)") + ((F.col("mix_place") <= left) & (F.col("mix_tokens") > 0)).cast("bigint"))
    rows = rows.withColumn("mix_copies", F.coalesce(copies, F.lit(1)).cast("bigint"))
    kept = [i for i, n in enumerate(docs.columns) if n.lower() not in new]
    return rows.select(*[f"_in{i}" for i in kept], *new).toDF(*[docs.columns[i] for i in kept], *new)


def realised(mixed: DataFrame) -> DataFrame:
    """Each row of a mixture as often as it is read, with mix_pass from 0."""
    last = (F.col("mix_copies") - 1).cast("bigint")
    return mixed.where("mix_copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
