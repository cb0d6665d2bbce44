"""Class balancing.

Randomness is replaced by md5-based draws so that every run, retry and
engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.operators.features import hash60, unit_random
from clausefold.operators.ordering import group_positions, order_bucket

COPY_CHUNK = 4096


def _class_sizes(df: DataFrame, label_col: str) -> DataFrame:
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("max_n", F.max("n").over(Window.partitionBy()))


def random_oversample(df: DataFrame, label_col: str, id_col: str, seed: int = 1,
                      bucket: Column | None = None) -> DataFrame:
    """G1: every class is topped up to the majority size with copies drawn
    with replacement: copy k of class c is the row at position
    ``hash60(seed, c, k) mod n_c + 1``.  Positions are ordered by id; text
    ids, which have no even buckets, by their md5 and then the id.

    Output: the input rows with ``copy = 0`` plus the copies (``copy = k``).
    The copies are generated in chunks of ``COPY_CHUNK`` so a class needing
    many copies is spread over many tasks.  They are joined back on (class,
    position, salt): the copies of one row, which are many in a tiny class,
    are dealt over as many salts as there are ``COPY_CHUNK``s of them.
    """
    source, order = df, [id_col]
    if bucket is None and isinstance(df.schema[id_col].dataType, T.StringType):
        source, order = df.withColumn("__md5", F.md5(id_col)), ["__md5", id_col]
    bucket = bucket if bucket is not None else order_bucket(source, order[0])
    pos = group_positions(source, [label_col], order, bucket, pos_col="__rn")
    sizes = _class_sizes(df, label_col).where(F.col("max_n") > F.col("n"))
    need = sizes.select(label_col, "n", (F.col("max_n") - F.col("n")).alias("need"))
    need = need.withColumn("salts", F.ceil(F.col("need") / F.col("n") / COPY_CHUNK).cast("bigint"))
    chunks = need.select(label_col, "n", "need", "salts", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("need") - 1) / COPY_CHUNK))).alias("chunk"))
    chunks = chunks.repartition(label_col, "chunk")
    copies = chunks.select(label_col, "n", "salts", F.explode(F.sequence(
        F.col("chunk") * COPY_CHUNK + 1, F.least((F.col("chunk") + 1) * COPY_CHUNK, F.col("need")))).alias("copy"))
    copies = copies.select(label_col, "copy", (F.pmod(hash60(F.lit(seed), F.col(label_col), F.col("copy")), F.col("n")) + 1).alias("__rn"),
                           F.pmod(F.col("copy"), F.col("salts")).alias("__salt"))
    rows = pos.join(need.select(label_col, "salts"), label_col).select(
        label_col, "__rn", *[c for c in df.columns if c != label_col],
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("__salt"))
    drawn = copies.join(rows, [label_col, "__rn", "__salt"], "inner").drop("__rn", "__salt")
    base = df.withColumn("copy", F.lit(0).cast("bigint"))
    return base.unionByName(drawn.withColumn("copy", F.col("copy").cast("bigint")))


# ---------------------------------------------------------------------------
# G2 genetic oversampling: pairs (J10), crossover (G3), rounds with checkpoints
def partner_count(ratio: Column) -> Column:
    """Partners per row for a class with ``ratio = max / count``: pairs are
    added two children at a time until more than ``ratio`` were made."""
    return (F.floor(ratio / 2) + 1).cast("int")


def _pairs_from_positions(pos: DataFrame, sizes: DataFrame, label_col: str) -> DataFrame:
    # only offsets that a partner lies at: none for the last row of a class
    reach = F.least(F.col("K").cast("bigint"), F.col("n") - F.col("rn")).cast("int")
    offs = F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>"))
    a = pos.join(sizes, label_col).select(label_col, F.col("rn").alias("a_rn"), F.explode(offs).alias("off"))
    b = pos.select(label_col, F.col("rn").alias("b_rn"))
    return a.join(b, (a[label_col] == b[label_col]) & (b["b_rn"] == a["a_rn"] + a["off"]), "inner").select(
        a[label_col].alias(label_col), "a_rn", "b_rn", "off")


def _partners(df: DataFrame, label_col: str) -> DataFrame:
    return _class_sizes(df, label_col).select(
        label_col, partner_count(F.col("max_n") / F.col("n")).alias("K"), "n")


def genetic_pairs(df: DataFrame, label_col: str, order_col: str, bucket: Column | None = None) -> DataFrame:
    """Each row paired with the next K rows of its class (K =
    ``partner_count``).  The band ``a.rn < b.rn <= a.rn + K`` becomes an
    equi-join on ``(class, rn + offset)`` for offsets 1..K, so the work is
    linear in rows x K and a large class is spread by its positions."""
    bucket = bucket if bucket is not None else order_bucket(df, order_col)
    pos = group_positions(df.select(label_col, order_col), [label_col], [order_col], bucket, pos_col="rn")
    return _pairs_from_positions(pos, _partners(df, label_col), label_col)


def crossover(pairs: DataFrame, ta: str, tb: str, ka: str, kb: str, seed: int = 1, rate: float = 0.25,
              out_a: str = "child_a", out_b: str = "child_b", ordered: bool = False,
              nb_pack: int = 0) -> DataFrame:
    """G3 on every pair row: adds the two children ``out_a``, ``out_b``.

    Words are single-space splits.  A is the text with fewer words (A first
    on ties).  B is put in a random order (md5 keys); the first |A| words of
    that order are matched with A's words, the rest are leftovers kept in B's
    original order.  Each A position exchanges its word with its matched B
    word with probability ``rate`` (the matched word goes to the other child
    otherwise); each leftover goes to child A with probability ``rate``,
    else to child B.  ``ka``/``kb`` are string keys of the parents that seed
    the draws.  Each step is its own projection and lambdas only read their
    arguments and plain row attributes.
    """
    from clausefold.functions.text import pack_words
    keep = pairs.columns
    wa, wb = pack_words(F.col(ta), nb_pack), pack_words(F.col(tb), nb_pack)
    s1 = pairs.withColumn("__swap", F.size(wa) > F.size(wb)).select(
        *keep, F.when(F.col("__swap"), wb).otherwise(wa).alias("__A"),
        F.when(F.col("__swap"), wa).otherwise(wb).alias("__B"))
    k_a, k_b = F.col(ka), F.col(kb)
    if ordered:
        # matched word = B's word at the same position; leftovers = B's tail
        s3 = s1.select(*keep, "__A", F.slice("__B", F.lit(1), F.size("__A")).alias("__picks"),
                       F.transform(F.slice("__B", F.size("__A") + 1, F.size("__B")),
                                   lambda w, j: F.struct((j + F.size("__A")).alias("j"), w.alias("w"))).alias("__left"))
        return _crossover_out(s3, keep, k_a, k_b, seed, rate, out_a, out_b)
    s2 = s1.select(*keep, "__A", F.size("__B").alias("__nB"), F.size("__A").alias("__nA"), F.array_sort(
        F.transform("__B", lambda w, j: F.struct(
            F.md5(F.concat_ws("|", F.lit(seed), k_a, k_b, F.lit("p"), j.cast("string"))).alias("k"),
            j.alias("j"), w.alias("w")))).alias("__perm"))
    s3 = s2.select(*keep, "__A",
                   F.transform(F.slice("__perm", F.lit(1), F.col("__nA")), lambda x: x["w"]).alias("__picks"),
                   F.array_sort(F.transform(F.slice("__perm", F.col("__nA") + 1, F.col("__nB")),
                                            lambda x: F.struct(x["j"].alias("j"), x["w"].alias("w")))).alias("__left"))

    return _crossover_out(s3, keep, k_a, k_b, seed, rate, out_a, out_b)


def _crossover_out(s3: DataFrame, keep: list[str], k_a: Column, k_b: Column, seed: int, rate: float,
                   out_a: str, out_b: str) -> DataFrame:
    def coin(tag, i):
        return unit_random(F.lit(seed), k_a, k_b, F.lit(tag), i) < F.lit(rate)

    zipped = F.arrays_zip(F.col("__A").alias("a"), F.col("__picks").alias("p"))
    main_a = F.transform(zipped, lambda z, i: F.when(coin("a", i), z["p"]).otherwise(z["a"]))
    main_b = F.transform(zipped, lambda z, i: F.when(coin("a", i), z["a"]).otherwise(z["p"]))
    to_a = F.transform(F.filter("__left", lambda x: coin("b", x["j"])), lambda x: x["w"])
    to_b = F.transform(F.filter("__left", lambda x: ~coin("b", x["j"])), lambda x: x["w"])
    return s3.select(*keep, F.array_join(F.concat(main_a, to_a), " ").alias(out_a),
                     F.array_join(F.concat(main_b, to_b), " ").alias(out_b))


def key_string(c: Column) -> Column:
    return F.concat_ws(".", F.transform(c, lambda x: x.cast("string")))


def genetic_round(df: DataFrame, label_col: str, key_col: str, text_col: str, seed: int = 1,
                  bucket: Column | None = None) -> DataFrame:
    """One G2 round: originals plus two children per pair.  ``key_col`` is
    an array<bigint> order key; a child's key is its first parent's key plus
    ``[2*off - 1]`` / ``[2*off]`` (originals get ``[0]``), so the next
    round's order is the reference's order: each original followed by its
    children."""
    bucket = bucket if bucket is not None else key_bucket(F.col(key_col))
    # positions and pairs are worked out on the keys; a text is joined twice,
    # once as each parent
    pos = group_positions(df.select(label_col, key_col), [label_col], [key_col], bucket, pos_col="rn")
    pairs = _pairs_from_positions(pos, _partners(df, label_col), label_col)
    a = pos.select(label_col, F.col("rn").alias("a_rn"), F.col(key_col).alias("a_key"))
    b = pos.select(label_col, F.col("rn").alias("b_rn"), F.col(key_col).alias("b_key"))
    keys = pairs.join(a, [label_col, "a_rn"]).join(b, [label_col, "b_rn"]).select(label_col, "a_key", "b_key", "off")
    texts = df.select(F.col(label_col).alias("__l"), F.col(key_col).alias("__k"), F.col(text_col).alias("__t"))
    j = keys.join(texts, (F.col(label_col) == F.col("__l")) & (F.col("a_key") == F.col("__k"))).withColumnRenamed("__t", "ta").drop("__l", "__k")
    j = j.join(texts, (F.col(label_col) == F.col("__l")) & (F.col("b_key") == F.col("__k"))).withColumnRenamed("__t", "tb").drop("__l", "__k")
    j = j.select(label_col, "a_key", "off", "ta", "tb", key_string(F.col("a_key")).alias("ka"),
                 key_string(F.col("b_key")).alias("kb"))
    j = crossover(j, "ta", "tb", "ka", "kb", seed)
    kids = j.select(label_col, F.explode(F.array(
        F.struct(F.concat("a_key", F.array(2 * F.col("off").cast("bigint") - 1)).alias(key_col), F.col("child_a").alias(text_col)),
        F.struct(F.concat("a_key", F.array(2 * F.col("off").cast("bigint"))).alias(key_col), F.col("child_b").alias(text_col)))).alias("k"))
    kids = kids.select(label_col, F.col(f"k.{key_col}").alias(key_col), F.col(f"k.{text_col}").alias(text_col))
    orig = df.select(label_col, F.concat(F.col(key_col), F.array(F.lit(0).cast("bigint"))).alias(key_col), text_col)
    return orig.unionByName(kids)


def key_bucket(key: Column) -> Column:
    """An order-preserving bucket of an order key: its first two parts, the
    second coarsened; a key of one part stands before longer ones."""
    second = F.coalesce(F.floor(F.try_element_at(key, F.lit(2)) / F.lit(16)), F.lit(-1))
    return F.struct(F.element_at(key, 1).alias("first"), second.alias("second"))


def genetic_oversample(df: DataFrame, label_col: str, order_cols: str | list[str], text_col: str, generations: int = 1,
                       seed: int = 1, spark: SparkSession | None = None) -> DataFrame:
    """``generations`` rounds; each round is cut from its lineage with
    ``checkpoint()`` into the cluster's checkpoint folder.  ``order_cols``
    are one or more integer columns that number the rows."""
    from clausefold.session import checkpoint_dir
    order_cols = [order_cols] if isinstance(order_cols, str) else order_cols
    cur = df.select(label_col, F.array(*[F.col(c).cast("bigint") for c in order_cols]).alias("__key"), text_col)
    for g in range(generations):
        cur = genetic_round(cur, label_col, "__key", text_col, seed + g)
        if spark is not None:
            checkpoint_dir(spark)
            cur = cur.checkpoint(eager=True)
    return cur


def genetic_size_law(m: Column, ratio: Column) -> Column:
    """Rows of a class after one round: m + 2 * sum_{d=0}^{m-1} min(d, K)."""
    K = partner_count(ratio).cast("long")
    m1 = m - 1
    s = F.when(m1 <= K, m1 * m / 2).otherwise(K * (K + 1) / 2 + (m1 - K) * K)
    return (m + 2 * s).cast("long")
