import re

import numpy as np
import pytest

from clausefold.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        x = words(item)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), decontam.item_hash(list(found)), bool(hit)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, size=int(rng.integers(1, 300)))
    text = np.concatenate([text, text[: len(text) // 2]])
    full = np.append(text, 0).tolist()
    assert decontam.suffix_array(np.array(full)).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    index = decontam.FMIndex(text, sample=5)
    for size in (1, 2, 5):
        patterns = rng.integers(1, 6, size=(20, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "Short ITEM"), (2, PASSAGE), (3, ""), (4, None), (None, "élan vital 9"), (10, "one two three four five six seven eight nine ten")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


TEXTS = [
    None, "", "...", "nothing here", "x " + PASSAGE.upper() + " y", PASSAGE.replace(" ", "-\n"),
    "one two three four five six seven eight nine", "short item short item", "a short\titem, b", "ÉLAN vital 9", "élan vital 9!",
    "two three four five six seven eight nine ten eleven and " + PASSAGE + " short item " * 3,
    "shortitem short_item", PASSAGE + " " + PASSAGE, "w " * 3000 + PASSAGE + " w" * 3000,
]


def test_digest_against_brute_force(spark, benchmark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, PASSAGE)]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id bigint, text string, spans string, n_words int")
    got = decontam.contamination_digest(docs, benchmark).collect()
    want = sorted((str(i), *brute(t, ITEMS)) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_blocks_of_phrases_add_up(spark, benchmark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    one = sorted(map(str, decontam.contamination_digest(docs, benchmark).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert sorted(map(str, decontam.contamination_digest(docs, benchmark).collect())) == one


def test_removal_and_empty_tables(spark, benchmark):
    docs = spark.createDataFrame([(1, f"Keep this. {PASSAGE}! And that.", 99, "x"), (2, "clean", 5, "y"), (3, None, None, "z")],
                                 "doc_id bigint, text string, n_chars bigint, __n_words string")
    got = {r["doc_id"]: r for r in decontam.remove_contamination(docs, benchmark).collect()}
    assert got[1]["text"] == "Keep this. ! And that." and got[1]["n_chars"] == 22
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 5 and got[3]["text"] is None
    none = benchmark.limit(0)
    assert decontam.remove_contamination(docs, none).select("text").collect() == docs.select("text").collect()
    assert [r["n_hit"] for r in decontam.contamination_digest(docs, none).collect()] == [0, 0, 0]
    assert decontam.contamination_digest(docs.limit(0), benchmark).count() == 0


def test_merge_spans():
    a, b = np.array([[1, 3], [8, 9]]), np.array([[3, 5], [2, 4], [20, 21]])
    assert decontam.merge_spans(a, b).tolist() == [[1, 5], [8, 9], [20, 21]]
