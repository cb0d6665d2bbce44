from pyspark.sql import functions as F

from clausefold.operators import balance as B


def data(spark):
    rows = [(i, "big" if i % 4 else "small", " ".join(f"w{i}_{k}" for k in range(1 + i % 5))) for i in range(60)]
    return spark.createDataFrame(rows, "id long, label string, text string")


def test_random_oversample_equalises(spark):
    out = B.random_oversample(data(spark), "label", "id", seed=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts["big"] == counts["small"] == 45
    # copies point at real rows of their class
    assert out.where("copy > 0").join(data(spark), ["id", "label"], "left_anti").count() == 0


def test_genetic_pairs_band(spark):
    p = B.genetic_pairs(data(spark), "label", "id").collect()
    small = [r for r in p if r.label == "small"]
    # ratio 45/15 = 3 -> K = 2 partners per row, fewer at the end of the class
    assert len(small) == 2 * 15 - 3
    assert all(0 < r.b_rn - r.a_rn <= 2 for r in small)


def test_crossover_keeps_words(spark):
    df = spark.createDataFrame([("a b c", "d e f g h", "1", "2"), ("x y", "z", "3", "4")], "ta string, tb string, ka string, kb string")
    out = B.crossover(df, "ta", "tb", "ka", "kb", seed=5).collect()
    for r in out:
        before = sorted((r.ta + " " + r.tb).split(" "))
        after = sorted((r.child_a + " " + r.child_b).split(" "))
        assert before == after


def test_genetic_size_law(spark):
    df = data(spark)
    out = B.genetic_oversample(df, "label", "id", "text", generations=2, seed=1, spark=spark)
    got = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    m = {"big": 45, "small": 15}
    for _ in range(2):
        mx = max(m.values())
        new = {}
        for k, v in m.items():
            K = int((mx / v) // 2) + 1
            new[k] = v + 2 * sum(min(d, K) for d in range(v))
        m = new
    assert got == m


def test_crossover_ordered_and_packs(spark):
    df = spark.createDataFrame([("a b c d", "e f g h i j", "1", "2")], "ta string, tb string, ka string, kb string")
    for kw in ({"ordered": True}, {"nb_pack": 2}, {"ordered": True, "nb_pack": 3}):
        r = B.crossover(df, "ta", "tb", "ka", "kb", seed=9, **kw).first()
        assert sorted((r.ta + " " + r.tb).split(" ")) == sorted((r.child_a + " " + r.child_b).split(" ")), kw


def test_pack_words(spark):
    from pyspark.sql import functions as F
    from clausefold.functions.text import pack_words
    df = spark.createDataFrame([("a b c d e",)], "t string")
    assert df.select(pack_words(F.col("t"), 2).alias("p")).first().p == ["a b", "c d e"]
    assert df.select(pack_words(F.col("t"), 9).alias("p")).first().p == ["a", "b", "c", "d", "e"]
    assert df.select(pack_words(F.col("t")).alias("p")).first().p == ["a", "b", "c", "d", "e"]


def test_text_ids_and_tiny_classes(spark, monkeypatch):
    """Text ids are drawn from too; the copies of a class of one row are
    dealt over salts and none is lost."""
    monkeypatch.setattr(B, "COPY_CHUNK", 7)
    rows = [(f"{i}_0", "a") for i in range(100)] + [("x_1", "b"), ("y_1", "c"), ("y_2", "c")]
    out = B.random_oversample(spark.createDataFrame(rows, "id string, label string"), "label", "id", seed=2)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 100, "b": 100, "c": 100}
    assert out.where("label = 'c' AND copy > 0").select("id").distinct().count() == 2


def test_pairs_of_a_rare_class_stay_in_the_band(spark):
    rows = [(i, "a") for i in range(3000)] + [(2**40, "b"), (2**40 + 1, "b")]
    p = B.genetic_pairs(spark.createDataFrame(rows, "id long, label string"), "label", "id")
    assert [(r.a_rn, r.b_rn) for r in p.where("label = 'b'").collect()] == [(1, 2)]


def test_genetic_rounds_take_large_keys_in_order(spark):
    rows = [(2**33 + i // 5, i % 5, "ab"[i % 3 == 0], f"w{i} v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv long, turn long, label string, text string")
    one = B.genetic_oversample(df, "label", ["conv", "turn"], "text", generations=1, seed=1, spark=spark)
    again = B.genetic_oversample(df.repartition(5), "label", ["conv", "turn"], "text", generations=1, seed=1, spark=spark)
    assert one.exceptAll(again).count() == 0 and one.count() == again.count()
    # plain row numbers give the same pairs: every child holds its parents' words
    assert one.where("size(__key) = 3 AND element_at(__key, 3) = 0").count() == 40
