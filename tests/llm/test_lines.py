import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from clausefold.llm import lines

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, min_chars, keep):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, own in docs for k in {key(x) for x in own} if len(k) >= min_chars)
    gone = {k for k, n in seen.items() if n >= min_docs}
    first = {}
    for i, own in docs:
        for x in own:
            if key(x) in gone:
                at = (i is not None, i)
                first[key(x)] = min(first.get(key(x), at), at)
    out = []
    for (i, own), (_, text) in zip(docs, rows, strict=True):
        stay, done = [], set()
        for x in own:
            k = key(x)
            if k in gone and not (keep == "first" and first[k] == (i is not None, i) and k not in done):
                continue
            done.add(k)
            stay.append(x)
        out.append((i, len(own), len(own) - len(stay), None if text is None else "\n".join(stay)))
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n_lines", T.StringType()), T.StructField("meta.url", T.StringType())])


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    common = ["Share this", " share THIS\t", "Été ", "été", "ÉTÉ", "a", "", "  ", "x" * 3000, "Cookie policy\r", "日本", "A" * 5]
    rows = [(int(i), "\n".join(str(rng.choice(common)) if rng.random() < 0.5 else f"own line {i} {k}" for k in range(int(rng.integers(1, 9))))) for i in range(n)]
    return rows + [(None, None), (None, "share this\nshare this"), (1000, ""), (1001, "\n\n"), (1002, None), (1003, "long " * 200_000 + "\nshare this")]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("sent_keys", [lines.SENT_KEYS, 0])
@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 4)])
def test_against_brute_force(spark, keep, sent_keys, min_docs, min_chars):
    rows = corpus(min_docs)
    docs = spark.createDataFrame([(i, t, "old", "u") for i, t in rows], SCHEMA).repartition(7)
    out = lines.dedup_lines(docs, min_docs, min_chars, keep, sent_keys=sent_keys)
    assert out.columns == ["doc_id", "text", "n_lines", "meta.url", "n_dropped"]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], str(r["text"])) for r in out.collect())
    assert got == sorted((str(i), n, d, str(t)) for i, n, d, t in brute(rows, min_docs, min_chars, keep))


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "Same\nother")] * 10 + [(2, "same")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(docs, 10).collect()}
    assert got == {(1, "", 2), (2, "", 1)}
    got = {(r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(docs, 11).collect()}
    assert got == {(1, "other", 1), (2, "", 1)}


def test_digest_of_empty_and_null(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in lines.line_digest(docs).collect()} == {(1, 1, 0, nothing), (2, 1, 0, nothing)}
    assert lines.line_digest(docs.limit(0)).count() == 0


def test_merged_filter_holds_every_shared_hash():
    rng = np.random.default_rng(3)
    words = 1 << 12
    parts = [rng.integers(0, 1 << 63, size=3000, dtype=np.uint64) for _ in range(6)]
    shared = rng.integers(0, 1 << 63, size=500, dtype=np.uint64)
    parts[1], parts[4] = np.concatenate([parts[1], shared]), np.concatenate([parts[4], shared])
    rows = []
    for p in parts:
        f = lines.Filters(words)
        f.add(p[: len(p) // 2])
        f.add(p[len(p) // 2 :])
        rows.extend(f.segments())
    twice = np.zeros(words, np.uint64)
    for segment, at, bits in lines._merged(iter(sorted(rows))):
        twice[segment * lines.SEGMENT + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(bits, np.uint64)
    assert lines.held(twice, shared).all()
    # and few others
    assert lines.held(twice, np.concatenate([parts[0], parts[2]])).mean() < 0.15


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "old", "u") for i, t in rows], SCHEMA)
    monkeypatch.setattr(lines, "filter_words", lambda *a: 1)
    got = sorted((str(r["doc_id"]), r["n_dropped"], str(r["text"])) for r in lines.dedup_lines(docs, 10).collect())
    assert got == sorted((str(i), d, str(t)) for i, _, d, t in brute(rows, 10, 1, "none"))


def test_bad_parameters(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in ({"min_docs": 1}, {"min_chars": 0}, {"keep": "last"}):
        with pytest.raises(ValueError):
            lines.dedup_lines(docs, **bad)
