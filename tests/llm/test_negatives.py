import math

import numpy as np
import pytest

from clausefold.llm import negatives as N


def brute(rows, is_anchor, relabel=None, positives=5, negatives=3, window=(50, 95), scale=256):
    own = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.add((i, relabel(i, label) if relabel else label, tuple(N.scaled(float(np.float32(x)), scale) for x in v)))
    out = []
    for a in own:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in own if b != a)
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            near = [s for s in scored if s[2] != a[1] and window[0] * -p <= 100 * -s[0] <= window[1] * -p][:negatives]
            out.extend((a[0], pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(near))
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS id", "1 AS v")
    out = N.hard_negatives(df, lambda i: i % 10 == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(seed, n=900, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    which = rng.integers(0, 12, size=n)
    v = (centres[which] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), v[i].tolist(), int(which[i] % 4)) for i in range(n)]


@pytest.mark.parametrize("block", [7, N.BLOCK])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "TREE", 200)
    rows = clustered(1)
    rows += [(2000 + i, rows[0][1], i % 3) for i in range(40)]  # ties
    rows += rows[:30]  # repeated rows
    rows += [(3000, None, 1), (3010, [None, 1.0], 1), (3020, [float("nan")] * 6, 1), (3030, [float("inf")] * 6, 1), (3040, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(3050, [], 0), (3060, [0.0] * 6, 1), (3070, [1.0, 2.0], 2), (50, rows[7][1], 3)]
    assert found(spark, rows, block=block) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** float(rng.integers(0, 7))).tolist(), i % 2) for i in range(120)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [6e29, 0.0], 1), (3, [-1e30, 0.0], 1), (4, [3e38, 0.0], 0)]
    got = found(spark, rows)
    assert got == [(a, p, k, i, N.MOST, N.MOST) for a, p, k, i, _, _ in brute(rows, lambda i: i % 10 == 0)]


def test_few_rows_and_relabelling(spark):
    assert found(spark, [(0, [1.0], 0)]) == [] == found(spark, [])
    rows = clustered(5, n=200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in N.negative_digest(df).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)


def test_boxes_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    rows = np.floor(256 * (rng.normal(size=(40, 4))[rng.integers(0, 40, size=4000)] + 0.02 * rng.normal(size=(4000, 4))))
    tree = N.Tree(np.arange(4000), [b"%d" % i for i in range(4000)], np.zeros(4000, int), rows)
    opened = 0
    for a in range(0, 4000, 100):
        anchor = rows[a]
        low, high = tree.intervals(anchor[None])
        w = N.Best(5, -math.inf, math.inf)
        opened += N.search(tree, anchor, b"%d" % a, low[0], high[0], lambda x: True, [w])
        scores = rows @ anchor
        assert [(-s, i) for s, i, _ in w.found] == [(scores[i], i) for i in sorted((i for i in range(4000) if i != a), key=lambda i: (-scores[i], i))[:5]]
    assert opened < 40 * 63 * 0.4


def test_tiles_cover_all_rows():
    rng = np.random.default_rng(6)
    for n, dim in ((1, 3), (64, 2), (65, 2), (1000, 3), (5000, 64), (300, 0)):
        leaves = N.tiles(rng.normal(size=(n, dim)), 64)
        assert sorted(np.concatenate(leaves).tolist()) == list(range(n))
        assert max(map(len, leaves)) <= 64 and len(leaves) <= 2 * -(-n // 64)
