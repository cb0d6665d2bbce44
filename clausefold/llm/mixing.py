"""Mixing sources to target weights by a splitting tree.

1. Words are counted per source, and targets are filled like water: sources
   share the words by weight, none above ``max_epochs`` times its size.
2. A source is laid end to end along a word axis, which is cut into at most
   ``blocks`` equal stretches; a block is the run of documents whose first
   words lie in one stretch.  Only a document of more than ``LONG_WORDS``
   words that is also longer than a stretch is split, into runs of its words.
   A quota is a number of blocks: all of them for each full pass, and for the
   rest blocks in random order, by their real words, as long as they fit.
3. The quotas are dealt to the output shards down a binary tree: a node's
   left half takes an exact share of the node's blocks, and how many of them
   come from each source is one multivariate-hypergeometric draw, made source
   by source by inverting the hypergeometric distribution.  Every quota and
   every shard's share is met exactly.
4. A source's blocks are permuted at random and the shards take disjoint runs
   of the permuted list, pass after pass; pieces are then put in random order
   inside their shard.

All of it is DataFrame operations and Column expressions, and all draws are
hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.llm.common import SPACED_WORD, bucket_count, let, named, uniform, written

#: Beyond so many entries the permutation table is joined, not broadcast.
BROADCAST_ENTRIES = 1 << 20
#: No document of up to so many words is split, however small its source.
LONG_WORDS = 1 << 12
#: Rows that a stretch of the shards' local order has on average.
ROWS_PER_STRETCH = 1 << 14
#: Blocks on either side that are traded to meet a target.
TRADED = 64


def word_count(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, so that it can be joined and grouped on."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def targets(sizes: DataFrame, weights: list[float], max_epochs: int) -> DataFrame:
    """From (source, source_size) to (source, source_size, idx, target).

    Sources are numbered by code point, null last, and weigh ``weights``,
    repeating.  They share all words by weight; a target stops at
    ``max_epochs`` times its source's size and the excess is shared anew until
    none is above.  In ascending order of size by weight, a source is full
    exactly if its share of what is left exceeds its limit.
    """
    # one row per source: these windows never see documents
    idx = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - F.lit(1)
    table = sizes.withColumn("idx", idx.cast("long"))
    table = table.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")))
    table = table.withColumn("limit", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("idx").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    table = table.withColumn("w_left", F.sum("w").over(after))
    table = table.withColumn("full", F.col("w") * F.col("left") / F.col("w_left") >= F.col("limit"))
    # the first source that is not full fixes the share of all that follow
    rate = F.first(F.when(~F.col("full"), F.struct("left", "w_left")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = table.withColumn("rate", rate)
    target = F.when(F.col("full") | F.col("rate").isNull(), F.col("limit").cast("double")).otherwise(
        F.col("w") * F.col("rate.left") / F.col("rate.w_left"))
    return table.select("source", "source_size", "idx", target.alias("target"))


def hypergeometric(u: Column, total: Column, marked: Column, draws: Column) -> Column:
    """The number of marked items among ``draws`` of ``total``, for u in (0, 1].

    Inverts the distribution from its mode: weights follow by the ratio of
    neighbouring terms, first upwards, then downwards, over 12 standard
    deviations (plus 12) to either side, beyond which less than 1e-30 lies.
    """

    def walk(state: Column, way: int, steps: Column, goal: Column) -> Column:
        """state x, weight, sum: adds up neighbours' weights, and stops moving
        once the sum reaches the goal."""
        big, k, n = total, marked, draws

        def step(s: Column, _: Column) -> Column:
            x = s["x"]
            if way > 0:
                ratio = (k - x) * (n - x) / ((x + 1) * (big - k - n + x + 1))
            else:
                ratio = x * (big - k - n + x) / ((k - x + 1) * (n - x + 1))
            return F.when(s["sum"] >= goal, s).otherwise(F.struct(
                (x + F.lit(way)).cast("long").alias("x"), (s["weight"] * ratio).alias("weight"), (s["sum"] + s["weight"] * ratio).alias("sum")))

        turns = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(turns, state, step)

    low = F.greatest(F.lit(0).cast("long"), draws - (total - marked))
    high = F.least(draws, marked)
    share = marked / F.greatest(total, F.lit(1).cast("long"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), draws * share * (1 - share)))
    mode = F.least(high, F.greatest(low, F.floor((draws + 1.0) * (marked + 1.0) / (total + 2.0)).cast("long")))
    facts = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), (F.ceil(deviation * 12) + 12).cast("long").alias("reach"))

    def start(x: Column, weight: Column, sum_: Column) -> Column:
        return F.struct(x.cast("long").alias("x"), weight.alias("weight"), sum_.alias("sum"))

    def drawn(f: Column) -> Column:
        up, down = F.least(f["high"] - f["mode"], f["reach"]), F.least(f["mode"] - f["low"], f["reach"])
        one, never = F.lit(1.0), F.lit(float("inf"))
        above = walk(start(f["mode"], one, one), 1, up, never)["sum"]
        below = walk(start(f["mode"], one, F.lit(0.0)), -1, down, never)["sum"]
        return let(F.struct(above.alias("above"), (u * (above + below)).alias("goal")), lambda s: F.when(
            s["goal"] <= s["above"], walk(start(f["mode"], one, one), 1, up, s["goal"])["x"],
        ).otherwise(walk(start(f["mode"], one, F.lit(0.0)), -1, down, s["goal"] - s["above"])["x"]))

    return let(facts, drawn)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal quotas (idx, quota) to shards: (idx, bounds), where shard k takes
    the ranks from ``bounds[k]`` to below ``bounds[k + 1]`` of the source's
    permuted blocks.

    A tree node is one row that holds an array with one entry per source; the
    table of sources is the only thing that is ever gathered.
    """
    z = F.lit(0).cast("long")
    level = quotas.agg(F.sort_array(F.collect_list(F.struct("idx", "quota"))).alias("have")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("last"), "have",
        F.aggregate("have", z, lambda a, q: a + q["quota"]).alias("total"))
    level = level.withColumn("all", F.col("total"))

    def fold(u_key: Column) -> Column:
        def take(s: Column, q: Column) -> Column:
            x = hypergeometric(uniform(F.lit(seed), u_key, q["idx"]), s["pop"], q["quota"], s["draws"])
            return let(x, lambda v: F.struct(
                (s["pop"] - q["quota"]).alias("pop"), (s["draws"] - v).alias("draws"),
                F.concat(s["out"], F.array(F.struct(q["idx"].alias("idx"), v.alias("quota")))).alias("out")))

        nothing = F.array().cast("array<struct<idx:bigint,quota:bigint>>")
        return F.aggregate("have", F.struct(F.col("total").alias("pop"), F.col("share").alias("draws"), nothing.alias("out")), take)["out"]

    def edge(k: Column) -> Column:
        return F.floor(F.col("all") * k / F.lit(shards)).cast("long")

    for _ in range(max(0, shards - 1).bit_length()):
        middle = F.floor((F.col("first") + F.col("last") + 1) / 2).cast("int")
        node = level.withColumn("mid", middle).withColumn("share", edge(F.col("mid")) - edge(F.col("first")))
        node = node.withColumn("left", F.when(F.col("mid") == F.col("last"), F.col("have")).otherwise(fold(F.concat_ws(":", "first", "last"))))
        left = F.struct(F.col("first"), F.col("mid").alias("last"), F.col("left").alias("have"), F.col("share").alias("total"))
        right = F.struct(
            F.col("mid").alias("first"), F.col("last"),
            F.zip_with("have", "left", lambda a, b: F.struct(a["idx"].alias("idx"), (a["quota"] - b["quota"]).alias("quota"))).alias("have"),
            (F.col("total") - F.col("share")).alias("total"))
        halves = node.select("all", F.explode(F.array(left, right)).alias("n")).select("n.*", "all")
        level = written(halves.where("first < last"), "mix-level")
    dealt = level.select(F.col("first").alias("shard"), F.explode("have").alias("q")).select("shard", "q.idx", "q.quota")
    by_shard = dealt.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("parts"))
    bounds = F.aggregate("parts", F.array(z), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["quota"])))
    return by_shard.select("idx", bounds.alias("bounds"))


def _parts(at: Column, size: Column, words: Column, blocks: int) -> Column:
    """The parts (block, word_from, word_to) of a document of ``size`` words
    that begins at word ``at`` of the ``words`` of its source.

    One part, the whole document, in the block of its first word; a document
    that is longer than ``LONG_WORDS`` and than a stretch has as few equal runs
    of words as are not.
    """
    z = F.lit(0).cast("long")
    stretches = F.least(words, F.lit(blocks).cast("long"))
    facts = F.struct(at.alias("at"), size.alias("size"), words.alias("words"), stretches.alias("n"),
                     F.greatest(F.lit(LONG_WORDS).cast("long"), F.call_function("div", words + stretches - 1, stretches)).alias("most"))

    def cut(f: Column) -> Column:
        runs = F.call_function("div", f["size"] + f["most"] - 1, f["most"])

        def part(i: Column) -> Column:
            lo, hi = F.call_function("div", f["size"] * i, runs), F.call_function("div", f["size"] * (i + 1), runs)
            return F.struct(F.call_function("div", (f["at"] + lo) * f["n"], f["words"]).alias("block"), lo.alias("word_from"), hi.alias("word_to"))

        return F.transform(F.sequence(z, runs - 1), part)

    nothing = F.array().cast("array<struct<block:bigint,word_from:bigint,word_to:bigint>>")
    return F.when(size > 0, let(facts, cut)).otherwise(nothing)


def _fit(drawn: Column, goal: Column) -> Column:
    """The numbers of the blocks of ``drawn`` (h, b, words) that share
    ``goal`` words: in their order, every block that still fits; then, if the
    sum comes nearer to the goal, one of the last ``TRADED`` of these goes, one
    of the first ``TRADED`` others comes, or both.  The sum misses the goal by
    less than the smallest block not taken."""
    z = F.lit(0).cast("long")
    # blocks up to the first that does not fit, found without copying arrays
    start = F.struct(goal.alias("left"), z.alias("k"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        return F.when(s["on"] & (x["words"] <= s["left"]), F.struct(
            (s["left"] - x["words"]).alias("left"), (s["k"] + 1).alias("k"), s["on"].alias("on"))).otherwise(
            F.struct(s["left"].alias("left"), s["k"].alias("k"), F.lit(False).alias("on")))

    def fill(s: Column) -> Column:
        blocks = F.transform(drawn, lambda x: F.struct(x["words"].alias("words"), x["b"].alias("b")))
        head, tail = F.slice(blocks, F.lit(1), s["k"].cast("int")), F.slice(blocks, (s["k"] + 1).cast("int"), F.size(drawn))
        none = F.array().cast("array<struct<words:bigint,b:bigint>>")
        some = F.aggregate(tail, F.struct(s["left"].alias("left"), none.alias("out")), lambda t, x: F.when(
            x["words"] <= t["left"], F.struct((t["left"] - x["words"]).alias("left"), F.concat(t["out"], F.array(x)).alias("out"))).otherwise(t))
        return let(some, lambda t: let(F.struct(
            F.concat(head, t["out"]).alias("taken"), F.array_except(tail, t["out"]).alias("rest"), t["left"].alias("left")), trade))

    def trade(f: Column) -> Column:
        nobody = F.array(F.struct(z.alias("words"), F.lit(-1).cast("long").alias("b")))
        n = F.size(f["taken"])
        goes = F.concat(nobody, F.slice(f["taken"], F.greatest(F.lit(1), n - F.lit(TRADED - 1)), F.lit(TRADED)))
        comes = F.concat(nobody, F.slice(f["rest"], F.lit(1), F.lit(TRADED)))
        pairs = F.flatten(F.transform(goes, lambda g: F.transform(comes, lambda c: F.struct(
            F.abs(f["left"] + g["words"] - c["words"]).alias("error"), g["b"].alias("goes"), c["b"].alias("comes")))))
        return let(F.array_min(pairs), lambda m: F.filter(
            F.concat(F.transform(f["taken"], lambda x: x["b"]), F.array(m["comes"])), lambda b: (b >= 0) & (b != m["goes"])))

    return let(F.aggregate(drawn, start, step), fill)


def mix(docs: DataFrame, carry: list[str], shards: int = 8, weights: tuple[float, ...] = (1.0, 2.0, 3.0),
        max_epochs: int = 3, blocks: int = 4096, seed: int = 20) -> DataFrame:
    """One row per document: the columns ``carry``, then ``size``,
    ``source_size``, ``target`` and ``pieces``.

    A piece (pass, block, word_from, word_to, rank, shard, order_key) is a run
    of the document's words that goes to a shard in one pass over its source:
    all of them, unless the document is split.  A document that is not taken
    has none.  Null texts and texts without words
    have size 0 and no pieces; null sources form one source; repeated rows are
    documents like any other; an empty table gives no rows.  Columns named
    like the new ones are replaced.  Positions along a source come from two
    levels of running sums, so a source that holds most rows is still worked
    on by many tasks.
    """
    made = ["size", "source_size", "target", "pieces"]
    carry = [c for c in carry if c not in made]
    buckets = bucket_count(docs.count())
    key, bucket = "__key", "__bucket"
    base = docs.select(*[F.col(c) for c in dict.fromkeys([*carry, "source"])], F.xxhash64(F.lit(seed), "doc_id").alias("__h"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("__crc"), word_count(F.col("text")).alias("size"))
    base = base.withColumn(key, _source_key(F.col("source"))).withColumn(bucket, F.pmod("__h", F.lit(buckets)))
    starts = base.groupBy(key, bucket).agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    starts = written(starts, "mix-buckets")
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = starts.select(key, bucket, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__first"),
                          F.sum("words").over(Window.partitionBy(key)).alias("__words"))
    inside = Window.partitionBy(key, bucket).orderBy("__h", "size", "__crc").rowsBetween(Window.unboundedPreceding, -1)

    def laid_out(rows: DataFrame) -> DataFrame:
        at = F.col("__first") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        return rows.join(first, [key, bucket]).withColumn("parts", _parts(at, F.col("size"), F.col("__words"), blocks))

    sizes = starts.groupBy(key).agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    plan = targets(sizes, list(weights), max_epochs).withColumn(key, _source_key(F.col("source")))
    narrow = laid_out(base.select(key, bucket, "__h", "size", "__crc")).select(key, F.explode("parts").alias("p"))
    filled = narrow.groupBy(key, F.col("p.block").alias("b")).agg(F.sum(F.col("p.word_to") - F.col("p.word_from")).alias("words"))
    drawn = filled.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), key, "b").alias("h"), "b", "words"))).alias("drawn"))
    plan = plan.join(drawn, key, "left").withColumn("drawn", F.coalesce("drawn", F.array().cast(drawn.schema["drawn"].dataType)))
    # whole passes take all blocks; what is left of the target takes some
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("n_blocks", F.size("drawn").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.call_function("div", F.col("goal"), F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    plan = plan.withColumn("passes", passes)
    plan = written(plan.withColumn("fit", _fit(F.col("drawn"), F.col("goal") - F.col("passes") * F.col("source_size"))), "mix-plan")
    plan = plan.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.size("fit"))
    n_sources = plan.count()
    plan = plan.join(split_quotas(plan.select("idx", "quota"), shards, seed), "idx")
    # ranks[b] is the place of block b in the source's permuted list, in which
    # the blocks of the last, partial pass come first; null if b holds nothing
    every = F.transform("drawn", lambda s: s["b"])
    order = F.concat(F.col("fit"), F.array_except(every, "fit"))
    listed = F.transform(order, lambda b, r: F.struct(b.alias("b"), r.cast("long").alias("r")))
    stretches = F.least(F.col("source_size"), F.lit(blocks).cast("long"))
    unused = F.when(stretches > 0, F.array_except(F.sequence(F.lit(0).cast("long"), stretches - 1), every)).otherwise(F.array().cast("array<bigint>"))
    unused = F.transform(unused, lambda b: F.struct(b.alias("b"), F.lit(None).cast("long").alias("r")))
    ranks = F.transform(F.array_sort(F.concat(listed, unused)), lambda s: s["r"])
    plan = written(plan.select(key, "source_size", "target", "n_blocks", "quota", "bounds", ranks.alias("ranks")), "mix-ranks")

    small = n_sources * blocks <= BROADCAST_ENTRIES
    laid = laid_out(base).join(F.broadcast(plan) if small else plan, key)

    def pieces_of(part: Column) -> Column:

        def piece(p: Column) -> Column:
            t = F.element_at(F.col("ranks"), (part["block"] + 1).cast("int")) + p * F.col("n_blocks")
            shard = F.size(F.filter("bounds", lambda e: e <= t)) - 1
            return F.struct(
                p.cast("int").alias("pass"), part["block"].alias("block"), part["word_from"].alias("word_from"), part["word_to"].alias("word_to"),
                t.alias("rank"), shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed), shard, F.col(key), t, F.col("__h")).alias("order_key"))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long")), piece)

    pieces = F.filter(F.flatten(F.transform("parts", pieces_of)), lambda p: p["rank"] < F.col("quota"))
    return laid.select(*carry, "size", "source_size", "target", pieces.alias("pieces"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards of every row.

    ``taken`` are the words that the mix takes of a document, repeats counted;
    ``shards`` lists its pieces as pass:shard:order, comma-joined: the shard
    that the splitting tree gives each, and its key in the shard's local order.
    Rows without words, or not taken, have none; nulls and repeats as in
    ``mix``.
    """
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"])
    listed = F.array_sort(F.transform("pieces", lambda p: F.struct(p["pass"].alias("pass"), p["word_from"].alias("at"), p["shard"].alias("shard"), p["order_key"].alias("key"))))
    shards = F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p["pass"].cast("string"), p["shard"].cast("string"), p["key"].cast("string"))), ",")
    return mix(docs, ["doc_id"], **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes a document, with
    the columns of ``docs`` and the text as it is, in files that hold the
    splitting tree's shards one after the other, each in its local random
    order.  Of a split document, each run of words that lie
    together and go to one shard is a row, joined by spaces unless it is the
    whole.  ``n_chars``, if there is such a column, follows the text.  Nulls,
    texts without words, repeated rows and empty tables as in ``mix``."""
    columns = docs.columns
    kept = [named(c).alias(f"c{i}") for i, c in enumerate(columns)]
    inner = docs.select("doc_id", "source", "text", *kept)
    laid = mix(inner, inner.columns, **options)

    def runs(s: Column) -> Column:
        """From sorted pieces: where one begins and where one ends without a
        neighbour in the same pass."""

        def apart(a: Column, b: Column) -> Column:
            return (a["pass"] != b["pass"]) | (a["word_to"] != b["word_from"]) | (a["shard"] != b["shard"])

        heads = F.filter(s, lambda p, i: F.when(i == 0, True).otherwise(apart(F.get(s, i - 1), p)))
        tails = F.filter(s, lambda p, i: F.when(i == F.size(s) - 1, True).otherwise(apart(p, F.get(s, i + 1))))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a["word_from"].alias("begin"), b["word_to"].alias("end"), a["shard"].alias("shard"), a["order_key"].alias("order_key")))

    placed = F.array_sort(F.transform("pieces", lambda p: F.struct(p["pass"].alias("pass"), p["word_from"].alias("word_from"), p["word_to"].alias("word_to"),
                                                                           p["shard"].alias("shard"), p["order_key"].alias("order_key"))))
    rows = laid.select("size", "text", *[f"c{i}" for i in range(len(columns))], F.explode(let(placed, runs)).alias("__run"))
    words = F.regexp_extract_all(F.col("text"), F.lit(SPACED_WORD), F.lit(0))
    run = F.col("__run")
    cut = F.array_join(F.slice(words, (run["begin"] + 1).cast("int"), (run["end"] - run["begin"]).cast("int")), " ")
    rows = rows.withColumn("text", F.when(run["end"] - run["begin"] == F.col("size"), F.col("text")).otherwise(cut))
    out = []
    for i, c in enumerate(columns):
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"c{i}").alias(c))
    whole = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(out)], run["shard"].alias("shard"), run["order_key"].alias("order_key"))
    return shuffled_shards(whole, docs.count()).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def shuffled_shards(pieces: DataFrame, rows: int) -> DataFrame:
    """Pieces (one row each, with ``shard`` and ``order_key``) spread over
    tasks by shard and stretches of the order, each sorted: in local random
    order, ready to be written.  Stretches and tasks follow the number of rows,
    so no task holds a shard, nor more rows at a larger scale."""
    bits = bucket_count(rows, ROWS_PER_STRETCH).bit_length() - 1
    stretch = F.shiftrightunsigned("order_key", 64 - bits) if bits else F.lit(0).cast("long")
    return pieces.repartition(-(-max(rows, 1) // ROWS_PER_STRETCH), "shard", stretch).sortWithinPartitions("shard", "order_key")
