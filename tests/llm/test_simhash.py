import numpy as np
import pytest
import xxhash

from clausefold.llm import simhash

DOCS = "doc_id bigint, text string, fp string, component_id string"


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    """Labels by repeated passes over all pairs."""
    fp = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprint_against_brute_force():
    rng = np.random.default_rng(0)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "É é 🙂\x85x", "x\xa0y z w"] + [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(20)]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 3) == brute_fingerprint(t)


def test_masks_meet_every_near_pair():
    masks = [m % (1 << 64) for m in simhash._masks(3)]
    rng = np.random.default_rng(1)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(flip & m == 0 for m in masks)


@pytest.mark.parametrize("chunk, small", [(4096, 16), (7, 3)])
def test_components_against_brute_force(spark, monkeypatch, chunk, small):
    """Chains and a dense cloud of fingerprints; with small limits every group
    is split and searched."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "_SMALL", small)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    fps = {0, 1 << 63, centre}
    for _ in range(150):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(8, 3)))
    walk = int(rng.integers(1 << 62))
    for _ in range(60):
        walk ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
        fps.add(walk)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct)).collect()}
    label = brute_components(fps)
    roots = {}
    for x, k in zip(signed, label, strict=True):
        roots.setdefault(k, set()).add(got.get(x, x))
        assert got.get(x, x) <= x
    assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)


BODY = " ".join(f"word{i} and{i % 7} more{i % 11}" for i in range(200))
ROWS = [(5, BODY, "x", "y"), (3, BODY.upper(), "x", "y"), (9, BODY + " tail", "x", "y"), (9, BODY + " tail", "x", "y"), (20, "", "x", "y"),
        (21, None, "x", "y"), (30, "quite another text", "x", "y"), (None, "quite another text", "x", "y"), (None, "alone here", "x", "y")]


def test_documents_nulls_ties_and_repeats(spark):
    got = simhash.near_duplicate_digest(spark.createDataFrame(ROWS, DOCS)).collect()
    label = brute_components([brute_fingerprint(t) for _, t, _, _ in ROWS])
    least = {}
    for (i, *_), k in zip(ROWS, label, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = sorted((str(i), f"{brute_fingerprint(t):016x}", str(least[k])) for (i, t, _, _), k in zip(ROWS, label, strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert got[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(spark.createDataFrame(ROWS, DOCS))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["20", "3", "30", "None"]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicate_digest(empty).count() == 0


def test_one_row_of_each_component_whatever_its_doc_id(spark):
    a, b, c, d = (" ".join(f"{x}{i} {x}{i % 13}" for i in range(60)) for x in ("mo", "ra", "ku", "ti"))
    rows = [(None, a, "x", None), (None, b, "x", None), (None, c, None, "x"), (None, c, None, "x"), (1, d, "x", "y"), (7, d, "a", "y"), (7, "unique " + a[::-1], "b", "y"),
            (8, "first of eight " + b[::-1], "x", "y"), (8, "second of eight " + c[::-1], "x", "y")]
    label = brute_components([brute_fingerprint(t) for _, t, _, _ in rows])
    assert len(set(label)) == 7
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted((str(i), t) for i, t in {(i, t) for i, t, _, _ in rows if (i, t) != (7, d)})
