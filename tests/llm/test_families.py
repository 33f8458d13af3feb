"""Near-duplicate groups where many variants of one text are below the similarity to each other."""

import random

from gridcast.llm import simhash_similar as similar
from tests.llm.test_similar import changed, plain_groups


def test_pairs_of_a_family_do_not_grow_with_its_square(spark, monkeypatch):
    rng, counts, members = random.Random(17), {}, 600
    base = ["w%d" % rng.randrange(10**6) for _ in range(150)]
    texts = [" ".join(changed(rng, base, rng.randrange(1, 9))) for _ in range(members)] + [" ".join(base)]
    # Variants of variants: similar to each other, not to the first text.
    for i in range(0, 120, 4):
        texts.append(" ".join(changed(rng, texts[i].split(), 1)))
    staged = similar.staged

    def counted(df, purpose):
        out = staged(df, purpose)
        counts[purpose] = counts.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(similar, "staged", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in similar.one_per_group(docs, dense=16).collect()}
    want = {i for i, x in enumerate(plain_groups(texts)) if i == x}
    assert len(want) > members // 4
    assert want <= kept and len(kept - want) <= 0.03 * (len(texts) - len(want))
    assert counts["similar-pairs"] + counts.get("similar-within", 0) < 20 * len(texts)
