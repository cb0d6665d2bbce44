import numpy as np
import pytest

from clausefold.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in ids[ids % 50 == 0]:
        s = (x * good[i]).sum(axis=1) / (length * np.sqrt((good[i] ** 2).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def ask(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], SCHEMA)
    return answers(neighbours.nearest(table, lambda i: i % 50 == 0, **options))


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    counts = rng.integers(0, 3, 63)
    walk = neighbours.visit(a, b, counts, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in walk]
    assert sorted(walk) == list(range(63)) and sums == sorted(sums)
    short = neighbours.visit(a, b, counts, 20)
    assert counts[short].sum() >= 20 > counts[short[:-1]].sum() and short == walk[: len(short)]


def test_parts_are_bounded():
    counts = np.array([0, 3, 9, 1, 1, 25, 2, 2, 7])
    first, number = neighbours.parts_of(counts, size=10)
    held = {}
    for f, n, c in zip(first, number, counts, strict=True):
        for p in range(f, f + n):
            held.setdefault(p, []).append(c / n)
    assert max(sum(v) for v in held.values()) <= 10 and list(number) == [1, 1, 1, 1, 1, 3, 1, 1, 1]


def test_few_candidates_ties_and_invalid_vectors(spark):
    e = [[float(j == k) for j in range(8)] for k in range(8)]
    rows = [(0, e[0]), (50, e[0]), (7, e[0]), (7, e[0]), (3, e[0]), (1, [2 * x for x in e[0]]), (100, e[1]), (4, [0.0] * 8), (150, [0.0] * 8),
            (5, None), (6, [1.0, None] + [0.0] * 6), (8, [float("nan")] + [1.0] * 7), (9, [float("inf")] + [1.0] * 7), (200, [1.0]), (None, e[2])]
    got = ask(spark, rows)
    assert got == brute(rows) and [i for i, _ in got[50]] == [0, 1, 3, 7, 100]
    assert ask(spark, []) == {} and ask(spark, [(4, None), (0, [0.0] * 8)]) == {} and ask(spark, [(0, e[0])]) == {}


@pytest.mark.parametrize("part", [4096, 37])
def test_recall_and_exact_scores(spark, monkeypatch, part):
    """Clouds, and one vector that a third of the rows share."""
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "LEAST", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 8))).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = ask(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert hits >= 0.9
    for q in want:
        for i, s in got[q]:
            a, b = x[q].astype(float), x[i].astype(float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_very_large_and_small_vectors_have_a_cosine():
    import numpy as np

    rows = np.array([[1e200, 1e200], [1e-200, -1e-200], [3.0, 4.0]])
    got = neighbours.cosine(np.array([1e250, 0.0]), rows)
    assert np.allclose(got, [0.5 ** 0.5, 0.5 ** 0.5, 0.6])
    plain = np.random.default_rng(1).normal(size=(50, 64))
    length = np.sqrt((plain * plain).sum(axis=-1))
    assert (neighbours.cosine(plain[0], plain) == (plain * plain[0]).sum(axis=-1) / (length * length[0])).all()
