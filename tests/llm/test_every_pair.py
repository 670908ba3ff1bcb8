"""The near-duplicate stage finds every pair of similarity 0.8, also those that no bucket holds."""

import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import shingle_dedup


def apart_in_all_bands(rng):
    """Two texts of 0.8 and more whose keys differ in every band: words are exchanged where the least shingles are."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    own, least = list(words), np.full(shingle_dedup.BANDS * shingle_dedup.ROWS, 2**64 - 1, dtype=np.uint64)
    where = np.zeros(len(least), dtype=int)
    for at in range(len(words) - shingle_dedup.SHINGLE + 1):
        new = (shingle_dedup.shingle_set(" ".join(words[at : at + shingle_dedup.SHINGLE])) * shingle_dedup._MUL + shingle_dedup._ADD).min(axis=1)
        where, least = np.where(new < least, at, where), np.minimum(least, new)
    for at in where[:: shingle_dedup.ROWS].tolist():
        own[at + 2] = "other"
    return " ".join(words), " ".join(own)


def test_pair_that_meets_in_no_bucket(spark):
    rng = random.Random(4)
    a, b = apart_in_all_bands(rng)
    sets = [shingle_dedup.shingle_set(t) for t in (a, b)]
    assert shingle_dedup.similarity(*sets) >= shingle_dedup.SIMILARITY
    assert not {*shingle_dedup.band_keys(sets[0])} & {*shingle_dedup.band_keys(sets[1])}
    c = " ".join(b.split()[:-90])  # near b, not near a
    assert shingle_dedup.similarity(sets[1], shingle_dedup.shingle_set(c)) >= shingle_dedup.SIMILARITY
    rows = [(7, a), (3, b), (5, c), (9, "something else altogether and so on"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.classes(docs).collect()} == {7: 3, 3: 3, 5: 3, 9: 9, 8: 8}
    assert sorted(r["doc_id"] for r in shingle_dedup.keep_one(docs).collect()) == [3, 8, 9]


def test_links_beyond_are_all_pairs(spark, monkeypatch):
    """Without any bucket, against all pairs; a line that most texts have, small sets, sizes at the edge of 0.8."""
    monkeypatch.setattr(shingle_dedup, "PART_TOKENS", 64)
    monkeypatch.setattr(shingle_dedup, "TILE", 3)
    rng, texts = random.Random(6), []
    line = " ".join(f"common{k}" for k in range(12))
    for family in range(60):
        base = [f"{family}x{rng.randrange(60 if family % 3 else 4)}" for _ in range(rng.choice([1, 3, 5, 6, 8, 9, 20, 60, 200]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"y{rng.randrange(9)}"
            own = own[rng.randint(0, len(own) // 8) :] + [f"z{rng.randrange(9)}"] * rng.choice([0, 0, 1])
            texts.append(" ".join(own) + (f" {line}" if rng.random() < 0.7 else ""))
    texts += [line, None, "", *[f"{line} {k}" for k in range(3)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    prints = shingle_dedup.sign_documents(docs).cache()
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(shingle_dedup.shingle_set(t or "").tobytes(), i)
    nodes = [(i, np.frombuffer(s, np.uint64)) for s, i in sets.items()]
    near = {(i, j) for i, a in nodes for j, b in nodes if i < j and shingle_dedup.similarity(a, b) >= shingle_dedup.SIMILARITY}
    none = spark.createDataFrame([], "node long, root long")
    got = [tuple(r) for r in shingle_dedup.links_beyond(docs, prints, none, "doc_id", "text").collect()]
    assert len(near) > 60 and sorted(got) == sorted(near)
    # Under one root nothing is looked for; sets that share little with others do not stay.
    u, v = min(near)
    one = spark.createDataFrame([(u, u), (v, u)], "node long, root long")
    left = {tuple(r) for r in shingle_dedup.links_beyond(docs, prints, one, "doc_id", "text").collect()}
    assert left == near - {(u, v)}
    own = prints.groupBy("sig").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.col("sig").alias("label"))
    assert 0 < shingle_dedup.may_have_more(own, 5).count() < own.count()
