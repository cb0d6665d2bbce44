import corpus_pipeline
import __spark_entry__ as entry

from clausefold.llm import decontam, queries

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_stages_on_planted_cases(spark, tmp_dir):
    base = [" ".join(f"{w}{(i * 7 + j) % 23}x" for j, w in enumerate(["lo", "ma", "ti", "re"] * 30)) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s0", 1), (101, "123 ...", "en", "s1", 1), (102, None, None, None, None), (103, f"{base[4][::-1]} {PASSAGE} end", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'u' AS `meta.url`", "1 AS __lang0")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["identify_language", "drop_near_duplicates", "decontaminate", "mix_sources", "shard"]
    kept = stage["identify_language"](spark, docs, tmp_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 100, 103]
    single = stage["drop_near_duplicates"](spark, kept, tmp_dir)
    left = {r["doc_id"] for r in single.collect()}
    assert 3 in left and 100 not in left and 103 in left
    clean = stage["decontaminate"](spark, single, tmp_dir)
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text.keys() == left and PASSAGE not in text[103] and text[103].endswith(" end") and text[3] == base[3]
    assert decontam.contamination_digest(clean, spark.read.parquet(f"{tmp_dir}/benchmark.parquet")).where("contaminated").count() == 0
    for made in (kept, single, clean, stage["mix_sources"](spark, clean, tmp_dir)):
        assert made.columns == docs.columns
    out = corpus_pipeline.run(spark, tmp_dir).collect()
    assert out and {r["doc_id"] for r in out} <= left
    empty = docs.limit(0)
    for step in stage.values():
        assert step(spark, empty, tmp_dir).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_the_network_names_unlabelled_languages(spark, tmp_dir):
    """The language stage is more than a test for letters."""
    words = {"en": ["the", "thing", "which", "then", "with"], "zz": ["qux", "zzop", "xaqq", "quzz", "jox"]}
    rows = [(i, " ".join(words[lang][(i * 3 + k) % 5] for k in range(60)), lang if i % 4 else None, "s", 1) for i in range(120) for lang in [("en", "zz")[i % 2]]]
    docs = spark.createDataFrame([*rows, (500, "12 34", None, "s", 1), (501, "12 34", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["identify_language"](spark, docs, tmp_dir).collect()}
    assert got.keys() == set(range(120)) and all(got[i] is not None for i in got)
    assert all(got[i] == lang for i, _, lang, *_ in rows if lang) and sum(got[i] == ("en", "zz")[i % 2] for i in range(120)) > 110
    plain = docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert {(r["doc_id"], r["lang"]) for r in dict(corpus_pipeline.STAGES)["identify_language"](spark, plain, tmp_dir).collect()} == {(i, None) for i in range(120)}
