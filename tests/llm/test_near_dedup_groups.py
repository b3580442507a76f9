"""Verification of candidate pairs: as many texts as a group has are sent, not as many as it has pairs."""

import random

from tarnlake.llm import simhash


def test_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(50)}" for _ in range(80)]
    texts = [" ".join(w if rng.random() > 0.04 else "edit" for w in base) for _ in range(60)]
    texts += ["", None, "one two", "one two", "w1 " * 9]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if rng.random() < 0.8]
    raw = [None if t is None else t.encode() for t in texts]
    want = {(i, j) for i, j in pairs if simhash.jaccard(raw[i], raw[j], 3) >= 0.6}
    assert 100 < len(want) < len(pairs) - 100
    seen = []
    p = spark.createDataFrame([*pairs, (1, 900), (901, 902)], "u long, v long")  # those nodes have no text
    d = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(raw)], "node long, text binary")
    monkeypatch.setattr(simhash, "drop_written", lambda *t: seen.extend(t))
    for block in (simhash.BLOCK, 2000):
        got = {(r["u"], r["v"]) for r in simhash._verified(p, d, 3, 0.6, block).collect()}
        assert got == want
    # Places of the first call: each text is at few of them, whatever its pairs.
    split = seen[1]
    at = split.selectExpr("place", "u as node").union(split.selectExpr("place", "v")).distinct().count()
    assert at <= 6 * len(texts) < len(pairs)


def test_sets_in_slabs():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = {k - 5: np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for k in range(20)}
    u, v = (x.ravel() for x in np.meshgrid(np.arange(-5, 15), np.arange(-5, 15), indexing="ij"))
    plain = [len(x & y) / len(x | y) if x | y else 1.0 for x, y in ((set(sets[a].tolist()), set(sets[b].tolist())) for a, b in zip(u.tolist(), v.tolist()))]
    for slab in (1, 70, 1_000_000):
        assert (simhash._Sets(sets).alike(u, v, 0.4, slab) == (np.array(plain) >= 0.4)).all()
