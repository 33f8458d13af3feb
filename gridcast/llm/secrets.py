"""Secret scans: fixed patterns, and a randomness test battery on other long tokens.

DataFrame and SQL functions only; the driver sees one histogram of a few thousand counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 20 (24) or more is what the whole run of the plain pattern is where it is long enough.
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
BASE = {"assign": _ASSIGN, "access": _ACCESS, "hex": _HEX}
VALUE_CHARS = 6
#: Tokens that are tested, and alphabets by which their encoding is told, smallest first.
_CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex_lower": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "alnum_lower": _DIGITS + _LOWER,
    "alnum_upper": _DIGITS + _UPPER,
    "alnum": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64_url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
FALSE_DISCOVERIES = 0.1
BINS = 100
#: Matches of a text whose spans are gathered one by one.
BLOCK = 128
KINDS = ("assign", "access", "hex", "random")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and not overlapping; code points, end
    exclusive. Each match is read together with the gap before it, so places are sums of lengths."""
    both = F.lit(rf"([\s\S]*?)({pattern}|\z)")
    found = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, both, F.lit(1)), lambda g: F.length(g)).alias("gap"),
        F.regexp_extract_all(text, both, F.lit(2)).alias("value"),
    )
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.length(m["value"])
        return F.struct(
            end.alias("at"),
            F.when(F.length(m["value"]) == 0, state["out"])
            .otherwise(F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))))
            .alias("out"),
        )

    # An array that grows by one is copied each time, so it grows within blocks of matches only, whose spans
    # are then moved by the length before the block. `array(x)` binds x: a lambda evaluates it once.
    def walk(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def blocks(f: Column) -> Column:
        count = F.floor((F.size(f) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda k: walk(F.slice(f, k * BLOCK + 1, BLOCK)))

    def before(walked: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        add = lambda s, w: F.struct((s["at"] + w["at"]).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(walked, start, add, lambda s: s["out"])

    def moved(w: Column, at: Column) -> Column:
        return F.transform(w["out"], lambda v: F.struct((v["start"] + at).alias("start"), (v["end"] + at).alias("end"), v["value"].alias("value")))

    walked = F.get(F.transform(F.array(found), blocks), F.lit(0))
    walked = F.get(F.transform(F.array(walked), lambda w: F.flatten(F.zip_with(w, before(w), moved))), F.lit(0))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the base kinds by start, then kind (its place in KINDS)."""
    parts = []
    for kind, pattern in BASE.items():
        found = spans(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 2)) >= VALUE_CHARS)
        parts.append(_tagged(found, KINDS.index(kind)))
    return F.array_sort(F.concat(*parts))


def _tagged(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


# ---------------------------------------------------------------- test battery


def _upper_tail(z: str) -> str:
    """1 - Phi(z) by a polynomial of 1 / (1 + 0.2316419 |z|), good to 1e-7."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"exp(-({z}) * ({z}) / 2) * 0.3989422804014327D * {poly}"
    return f"(case when {z} >= 0 then {tail} else 1 - {tail} end)"


def encoding(value: str) -> str:
    """SQL for the smallest alphabet that holds all characters of a token."""
    tests = {"hex_lower": "0-9a-f", "hex_upper": "0-9A-F", "base32": "A-Z2-7", "alnum_lower": "0-9a-z", "alnum_upper": "0-9A-Z"}
    tests |= {"alnum": "0-9A-Za-z", "base64": "0-9A-Za-z+/", "base64_url": "0-9A-Za-z_-"}
    cases = " ".join(f"when {value} rlike '^[{c}]+$' then '{k}'" for k, c in tests.items())
    return f"case {cases} else 'mixed' end"


def tested(candidates: str) -> Column:
    """The candidates of a column (structs with value) that hold a letter and a digit, with stratum (encoding and half octave of
    the length) and p, the randomness battery's p-value: three times the smallest of the p-values of
    chi-squared uniformity over the alphabet, the number of runs of the alphabet's halves, and the
    correlation of neighbours. A token without two halves or without variance has p = 0."""

    letters = " ".join(f"when '{k}' then '{v}'" for k, v in ALPHABETS.items())
    sql = f"""
    transform(transform(transform(transform(
      filter(CANDIDATES, c -> c.value rlike '[0-9]' and c.value rlike '[A-Za-z]'),
      c -> named_struct('c', c, 'enc', {encoding("c.value")}, 'n', length(c.value))),
      c -> named_struct('c', c.c, 'enc', c.enc, 'n', c.n, 'abc', case c.enc {letters} end)),
      c -> named_struct('c', c.c, 'enc', c.enc, 'n', c.n, 'k', length(c.abc),
        'x', transform(sequence(1, c.n), i -> cast(instr(c.abc, substr(c.c.value, i, 1)) as double)),
        'squares', aggregate(array_distinct(split(c.c.value, '')), 0D,
          (a, ch) -> a + case when ch = '' then 0D else pow(c.n - length(replace(c.c.value, ch, '')), 2) end))),
      c -> named_struct('c', c.c, 'enc', c.enc, 'n', c.n, 'k', c.k,
        'chi', c.k * c.squares / c.n - c.n,
        'high', aggregate(c.x, 0D, (a, v) -> a + case when v > c.k / 2 then 1 else 0 end),
        'runs', 1 + aggregate(sequence(1, c.n - 1), 0D,
          (a, i) -> a + case when (c.x[i] > c.k / 2) <> (c.x[i - 1] > c.k / 2) then 1 else 0 end),
        'sum', aggregate(c.x, 0D, (a, v) -> a + v),
        'sq', aggregate(c.x, 0D, (a, v) -> a + v * v),
        'next', aggregate(sequence(1, c.n - 1), 0D, (a, i) -> a + c.x[i] * c.x[i - 1]),
        'ends', c.x[0] + c.x[c.n - 1]))
    """
    # Means, variances and normal scores of the three statistics.
    scored = f"""
    transform(transform({sql},
      c -> named_struct('c', c.c, 'stratum', concat(c.enc, ':', cast(floor(2 * log2(c.n)) as int)),
        'z1', (pow(greatest(c.chi, 0D) / (c.k - 1), 1 / 3D) - (1 - 2 / (9D * (c.k - 1)))) / sqrt(2 / (9D * (c.k - 1))),
        'z2', (c.runs - (2 * c.high * (c.n - c.high) / c.n + 1)) / nullif(sqrt(greatest(0D,
          2 * c.high * (c.n - c.high) * (2 * c.high * (c.n - c.high) - c.n) / (pow(c.n, 2) * (c.n - 1)))), 0D),
        'z3', sqrt(c.n) * (1D / c.n + (c.next - c.sum / c.n * (2 * c.sum - c.ends) + (c.n - 1) * pow(c.sum / c.n, 2))
          / nullif(c.sq - c.sum * c.sum / c.n, 0D)))),
      c -> named_struct('c', c.c, 'stratum', c.stratum, 'p', coalesce(least(1D, 3 * least({_upper_tail("c.z1")},
        2 * {_upper_tail("abs(c.z2)")}, 2 * {_upper_tail("abs(c.z3)")})) * case when c.z2 is null or c.z3 is null then 0 else 1 end, 0D)))
    """
    return F.expr(scored.replace("CANDIDATES", candidates))


def cutoffs(tests: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[str, float]:
    """Per stratum the smallest p above which tokens count as random, from a table with stratum and p.

    Random tokens have p spread evenly (at least so above one half), others pile up near 0. The number of
    random tokens of a stratum is told from those with p of at least one half; what lies above a cutoff
    beyond their even share is false. The cutoff is the smallest at which at most `rate` of the tokens above are
    false. Strata are by length, so short tokens, which pass tests more easily, answer for themselves.
    """
    bins = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    counts: dict[str, list[int]] = {}
    for r in tests.groupBy("stratum", bins).count().collect():
        counts.setdefault(r["stratum"], [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for stratum, held in counts.items():
        random = 2 * sum(held[BINS // 2 :])
        for j in range(BINS // 2 + 1):
            above = sum(held[j:])
            if above and max(0.0, above - min(random, sum(held)) * (1 - j / BINS)) <= rate * above:
                out[stratum] = j / BINS
                break
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """All columns of docs and `secrets`: array<struct<start, kind, end, value>> by start, then kind (a
    place in KINDS); code points of text, end exclusive. A column `secrets` of docs is replaced.

    A null text is empty and has none; equal rows have equal secrets; an empty table gives no rows.
    Random tokens that touch a base span are not added. The corpus is read twice: for the histogram of
    p-values over all documents, and for the result; rows meet nowhere else.
    """
    names = docs.columns
    wide = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"_in{names.index('text')}"), F.lit(""))
    with_tokens = wide.withColumn("_text", text).withColumn("_cand", spans(F.col("_text"), _CANDIDATE))
    with_tests = with_tokens.withColumn("_tests", tested("_cand"))
    exploded = with_tests.select(F.explode("_tests").alias("t")).select("t.stratum", "t.p")
    limits = cutoffs(exploded, rate)
    base = with_tests.withColumn("_base", base_spans(F.col("_text")))
    if limits:
        table = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
        chosen = F.filter("_tests", lambda t: F.floor(t["p"] * BINS) >= F.coalesce(F.try_element_at(table, t["stratum"]), F.lit(2.0)) * BINS)
        chosen = F.transform(chosen, lambda t: t["c"])
    else:
        chosen = F.filter("_cand", lambda c: F.lit(False))
    alone = F.filter(chosen, lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    out = base.withColumn("secrets", F.array_sort(F.concat("_base", _tagged(alone, KINDS.index("random")))))
    kept = [i for i, n in enumerate(names) if n != "secrets"]
    return out.select(*[f"_in{i}" for i in kept], "secrets").toDF(*[names[i] for i in kept], "secrets")


def joined(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rate: float = FALSE_DISCOVERIES, mask: str = "[SECRET]") -> DataFrame:
    """Rows of docs with every secret in text replaced by a mask (overlapping ones by one); n_chars, where
    docs has it, follows a changed text. Other columns, and rows without secrets, stay as they are, columns
    named `secrets` or like `text` but for case included."""
    names = docs.columns
    at = names.index("text")
    found = find_secrets(docs.toDF(*["text" if i == at else f"_kept{i}" for i in range(len(names))]), rate)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr("text", s["at"] + 1, x["start"] - s["at"])
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(gap, F.lit(mask))).alias("out"))
        )

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substr("text", s["at"] + 1))
    clean = F.when(F.size("secrets") > 0, F.aggregate("secrets", start, step, rest)).otherwise(F.col("text"))
    out = found.withColumn("_clean", clean)
    changed = {"text": F.col("_clean")}
    if "n_chars" in names:
        size = f"_kept{names.index('n_chars')}"
        kind = found.schema[size].dataType
        changed[size] = F.when(F.size("secrets") > 0, F.length("_clean").cast(kind)).otherwise(F.col(size))
    return out.withColumns(changed).drop("_clean", "secrets").toDF(*names)
