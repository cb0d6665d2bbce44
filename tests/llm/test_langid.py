import zlib

import numpy as np
import pytest

from clausefold.llm import langid

VOWELS = {"xx": ["la", "mo", "ti"], "yy": ["zu", "keß", "grö"]}


def text(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(VOWELS[lang], 3)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(("xx", "yy")[i % 2], i, 5 + i % 40), ("xx", "yy")[i % 2], "s", 1.5) for i in range(300)]
    rows += [(1000, None, "xx", "s", 1.5), (1001, "12 !?", "yy", "s", 1.5), (1002, "", None, "s", 1.5), (None, text("xx", 7, 30), None, None, None),
             (0, rows[0][1], "xx", "s", 1.5), (1003, text("yy", 9, 9000), "yy", "s", 1.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = langid._new_network(["a", "b", "c"], 4, rng)
    symbols, labels = rng.integers(0, 5, (6, 9)), rng.integers(0, 3, 6)
    symbols[0, 5:] = langid.PAD
    _, slopes = langid.gradients(net, symbols, labels)
    for w, slope in zip((net.inputs, net.recurrent, net.output, net.bias), slopes, strict=True):
        for _ in range(8):
            at = tuple(int(rng.integers(0, min(k, 5))) for k in w.shape)
            old, e = w[at], 1e-5
            w[at] = old + e
            up = langid.gradients(net, symbols, labels)[0]
            w[at] = old - e
            down = langid.gradients(net, symbols, labels)[0]
            w[at] = old
            assert abs((up - down) / (2 * e) - slope[at]) < 1e-6


def test_reader_agrees_with_the_training_form():
    rng = np.random.default_rng(1)
    net = langid._new_network(["a", "b"], 5, rng)
    texts = [b"Abc \xc3\xa9x", b"q" * 300, b"", b"zz"]
    symbols, first = langid._windows(texts, langid.LENGTH)
    states, _ = langid._forward(net, langid._FOLD[symbols])
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
    p = langid._softmax(both @ net.output + net.bias).transpose(1, 0, 2)
    p = np.where((symbols != langid.PAD)[..., None], p, 0).sum(axis=1)
    p = np.add.reduceat(p, first, axis=0)
    got = langid.Reader(net).documents(texts)
    for i in (0, 1, 3):
        assert np.allclose(got[i], p[i] / p[i].sum(), atol=1e-4)


def test_held_out_accuracy_and_odd_rows(docs):
    got = langid.language_digest(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == docs.count()
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(right) > 30 and np.mean(right) > 0.97
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[1003]["lang_pred"] == "yy" and by[None]["lang_pred"] == "xx"
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


def test_stage_keeps_columns_and_drops_unidentified(docs):
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3 and kept.where("score = 1.5").count() == 302


def test_nothing_to_learn_from(docs):
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.language_digest(blank).collect()} == {"und"}
    assert langid.language_digest(docs.limit(0)).count() == 0
    one = docs.selectExpr("doc_id", "text", "'only' as lang")
    assert {r["lang_pred"] for r in langid.language_digest(one).collect()} == {"only", "und"}


def test_every_language_is_learned(spark):
    """More languages than a fixed few dozen, some of them rare."""
    rng = np.random.default_rng(11)
    words = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) * 2 for j in range(4)] for k in range(72)}
    rows = [(i, " ".join(rng.choice(words[c], 25)), c) for i, c in enumerate(c for c in words for _ in range(4 if c < "l08" else 9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    windows, labels, languages = langid.training_windows(docs)
    assert languages == sorted(words) and set(labels) == set(range(72))
    assert min(labels.count(c) for c in range(72)) > 0
    assert langid.train(windows, labels, languages, steps=2).languages == languages
    assert langid.schedule(3) == (64, 200) and langid.schedule(72)[0] == 12 and langid.schedule(72)[1] > 600


def test_stage_keeps_letters_without_a_model(docs):
    """An unlabelled corpus loses only texts without a letter."""
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    net = langid.fit(blank)
    assert net.languages == []
    assert langid.keep_identified(blank, net).count() == docs.count() - 3
