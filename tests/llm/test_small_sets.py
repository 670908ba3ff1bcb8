"""Small sets go through pivots and fingerprints like any other, with a radius that loses none."""

import numpy as np

from threadloom.llm import shingle_dedup


def test_small_sets_have_a_radius():
    rng = np.random.default_rng(8)
    most = 0
    for _ in range(4000):
        n = int(rng.integers(5, 9))
        own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        a, b = (np.array(shingle_dedup.fingerprint(x), dtype=np.int64).view(np.uint64) for x in (own, own[1:]))
        most = max(most, int(np.bitwise_count(a ^ b).sum()))
    print("most bits", most)
    assert most < shingle_dedup.SMALL_RADIUS - 8
    prints = np.array([[0, 0], [2**64 - 1, 2**64 - 1], [1, 0]], dtype=np.uint64)
    left, right = shingle_dedup._pairs_apart(np.arange(3), prints, np.ones(3, dtype=bool), shingle_dedup.pivots())
    assert list(zip(left.tolist(), right.tolist())) == [(0, 2)]  # the others are 127 bits and more apart


def test_stars_go_through_pivots(spark):
    """Pivots discard no pair within the radius, and what they discard is over it."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63, (200, 2))
    rows = []
    for i, (lo, hi) in enumerate(base.tolist()):
        flips = rng.permutation(64)[: i % 64]
        rows.append(((20, lo, hi), (6 if i % 2 else 20, lo ^ int(np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)).astype(np.int64)) if len(flips) else lo, hi), i % 64))
    df = spark.createDataFrame(rows, "a struct<n: long, lo: long, hi: long>, b struct<n: long, lo: long, hi: long>, bits int")
    got = [(r["b"]["n"], r["bits"], r["near"]) for r in df.withColumn("near", shingle_dedup.close_prints("a.", "b.")).collect()]
    assert all(near == (bits <= (shingle_dedup.SMALL_RADIUS if n < shingle_dedup.SMALL else shingle_dedup.RADIUS)) for n, bits, near in got)
