"""What the driver holds while stages are planned: short plans and short tables."""

import math

import pytest
from pyspark.sql.group import GroupedData

from gridcast.llm import mixing
from gridcast.llm import words as W


def plain_exponent(tokens, below):
    logs, low, high = [math.log(t / sum(tokens)) for t in tokens], 0.0, 1.0
    for _ in range(mixing.PASSES * mixing.LEVELS):
        mid = (low + high) / 2
        powers = [math.exp(mid * x) for x in logs]
        if below(mid, sum(powers), sum(p * x for p, x in zip(powers, logs, strict=True)), logs):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def test_exponents_are_sought_with_few_columns(spark, monkeypatch):
    widths, agg = [], GroupedData.agg

    def counted(self, *exprs):
        widths.append(len(exprs))
        return agg(self, *exprs)

    monkeypatch.setattr(GroupedData, "agg", counted)
    tokens = [900_000, 40_000, 3_000, 500, 7]
    sources = spark.createDataFrame([(f"s{i}", 1, t) for i, t in enumerate([*tokens, 0])], "source string, docs long, tokens long")
    flat = plain_exponent(tokens, lambda a, z, s, _: math.log(z) - a * s / z >= 0.6 * math.log(len(tokens)))
    assert 0.01 < flat < 0.99 and mixing.exponent(sources, entropy=0.6) == pytest.approx(flat, abs=1e-9)
    often = plain_exponent(tokens, lambda a, z, s, logs: math.exp((1 - a) * (max(logs) - min(logs))) > 4)
    assert 0.01 < often < 0.99 and mixing.exponent(sources, repetition=4.0, budget_ratio=None) == pytest.approx(often, abs=1e-9)
    twice = plain_exponent(tokens, lambda a, z, s, logs: 2 * math.exp((a - 1) * min(logs)) / z > 5)
    assert 0.01 < twice < 0.99 and mixing.exponent(sources, repetition=5.0, budget_ratio=2.0) == pytest.approx(twice, abs=1e-9)
    assert max(widths) <= 8


def test_tables_of_powers_fit_the_texts(monkeypatch):
    monkeypatch.setattr(W, "_POWERS", {})
    (short,) = W.chunks([b"a short text of some words"])
    before = W.word_hashes(short)
    assert sum(len(up) + len(down) for up, down in W._POWERS.values()) < 1000
    (long,) = W.chunks([b"word " * 300_000 + b"a short text of some words"])
    assert (W.word_hashes(long)[-6:] == before).all()
    assert (W.word_hashes(short) == before).all()
    assert all(len(up) <= W.CHUNK_BYTES + (W.CHUNK_BYTES >> 2) for up, _ in W._POWERS.values())
