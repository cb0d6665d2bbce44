import itertools
import random

from clausefold.operators import vote as V


def ballots_df(spark, rows):
    return spark.createDataFrame(rows, "g int, v string, pos int, w double")


def run(spark, rows, **kw):
    df = ballots_df(spark, rows)
    out = V.elect(df, ["g"], "v", ["pos"], **kw)
    return out


def test_not_mode_hand_case(spark):
    rows = [(1, str(x), i, None) for i, x in enumerate([0, 1, 2, 0, 0, 1])]
    r = run(spark, rows, mode="not", default="0", priority="last", level="min").first()
    assert r["winner"] == "1"


def test_not_mode_only_default(spark):
    rows = [(1, "0", 0, None), (1, "0", 1, None)]
    r = run(spark, rows, mode="not", default="0", level="ful").collect()
    assert [(x["value"], x["pcount"]) for x in r] == [("0", 2.0)]


def test_ato_absent_gives_null(spark):
    rows = [(1, "a", 0, None), (1, "b", 1, None)]
    assert run(spark, rows, mode="ato", default="z", level="min").first()["winner"] is None


def test_weighted_first_tie_broken_by_count(spark):
    rows = [(1, "a", 0, None), (1, "b", 1, None), (1, "b", 2, None)]
    assert run(spark, rows, mode="pnd", priority="first", level="min").first()["winner"] == "b"


def _brute(ballots, mode, default, priority, weights=None):
    """Brute force: count, then order candidates by the documented key."""
    n = len(ballots)
    if mode == "pnd":
        weights = weights or (list(range(n, 0, -1)) if priority == "first" else list(range(1, n + 1)))
    cands = {}
    for i, b in enumerate(ballots):
        if mode == "ato" and b != default:
            continue
        if mode == "not" and b == default:
            continue
        c = cands.setdefault(b, [0, 0.0, i])
        c[0] += 1
        c[1] += weights[i] if mode == "pnd" else 1
    if mode == "not" and not cands:
        cands = {default: [ballots.count(default), float(ballots.count(default)), 0]}
    if not cands:
        return None
    items = list(cands.items())
    if priority == "last":
        items.sort(key=lambda kv: (-kv[1][1], -kv[1][0], -kv[1][2]))
    else:
        items.sort(key=lambda kv: (-kv[1][1], -kv[1][0], 0 if kv[0] == default else 1, kv[1][2]))
    return items[0][0]


def test_votes_match_brute_force(spark):
    rnd = random.Random(7)
    rows, cases = [], []
    g = 0
    for mode, prio in itertools.product(["std", "ato", "pnd", "not"], [None, "first", "last"]):
        for _ in range(15):
            g += 1
            n = rnd.randint(1, 7)
            b = [rnd.choice("xyz") for _ in range(n)]
            cases.append((g, mode, prio, b))
    expected = {}
    got = {}
    for mode, prio in itertools.product(["std", "ato", "pnd", "not"], [None, "first", "last"]):
        sel = [c for c in cases if c[1] == mode and c[2] == prio]
        rows = [(c[0], v, i, None) for c in sel for i, v in enumerate(c[3])]
        df = ballots_df(spark, rows)
        out = V.elect(df, ["g"], "v", ["pos"], mode=mode, default="y", priority=prio, level="min").collect()
        for r in out:
            got[r["g"]] = r["winner"]
        for c in sel:
            expected[c[0]] = _brute(c[3], mode, "y", prio)
    assert got == expected


def test_group_positions_split_by_bucket_equals_plain(spark):
    from pyspark.sql import functions as F, Window
    from clausefold.operators.ordering import group_positions
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    a = group_positions(df, ["g"], ["o"], F.floor(F.col("o") / 97), pos_col="p")
    b = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert a.select("g", "o", "p").exceptAll(b.select("g", "o", "p")).count() == 0
    assert a.count() == 5000


def test_two_level_positions_match_row_number(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from clausefold.operators import ordering as O

    monkeypatch.setattr(O, "STRETCH", 3)
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("id"), (F.col("id") % 3 == 0).alias("g"))
    got = O.group_positions(df, ["g"], ["id"], O.id_bucket("id", 8), size_col="n")
    w = Window.partitionBy("g").orderBy("id")
    want = df.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    assert got.select("id", "g", "pos", "n").exceptAll(want.select("id", "g", "pos", "n")).count() == 0 and got.count() == 500
