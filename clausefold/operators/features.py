"""Text features.

Two forms of each vectorizer: the MLlib pipeline stages used for model
fitting, and a relational twin ``(id, term, value)`` that is plain
aggregation (partial + final), checkable against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.functions import text as X
from clausefold.functions.arrays import explode_rows

MD5_32 = 4294967296.0  # 2^32: md5 prefix of 8 hex digits mapped to [0, 1)


def hash32(*parts) -> Column:
    """Deterministic 32-bit hash: first 8 hex digits of md5('a|b|...')."""
    s = F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash60(*parts) -> Column:
    """As ``hash32`` with 15 hex digits, for draws from more than 2^32."""
    s = F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def unit_random(*parts) -> Column:
    """Deterministic uniform draw in [0, 1) (never ``rand()``)."""
    return hash32(*parts) / F.lit(MD5_32)


# ---------------------------------------------------------------------------
# F1 bag of character n-grams (relational twin of a count vectorizer)
def char_bag(df: DataFrame, id_col: str, text_col: str, min_n: int = 4, max_n: int = 5) -> DataFrame:
    """``(id, gram, cnt)`` counts of char_wb n-grams (min_df 1)."""
    g = explode_rows(df, [id_col], X.char_wb_grams(F.col(text_col), min_n, max_n), "gram")
    return g.groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def gram_counts(df: DataFrame, text_col: str, min_n: int = 4, max_n: int = 5) -> DataFrame:
    """``(gram, cnt, df)`` over all texts.  Grams lie inside words: ``cnt``
    follows from the counts of the words, and for ``df`` a text gives each gram
    of its distinct words once."""
    words = df.select(X.ws_split(F.lower(F.col(text_col))).alias("w"))
    said = explode_rows(words, [], F.col("w"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    cnt = explode_rows(said, ["n"], X.char_wb_grams("word", min_n, max_n), "gram").groupBy("gram").agg(F.sum("n").alias("cnt"))
    held = F.array_distinct(X.char_wb_grams(F.array_join(F.array_distinct("w"), " "), min_n, max_n))
    docs = explode_rows(words, [], held, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    both = cnt.select("gram", "cnt", F.lit(0).cast("bigint").alias("df")).unionByName(docs.select("gram", F.lit(0).cast("bigint").alias("cnt"), "df"))
    return both.groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


# ---------------------------------------------------------------------------
# F2 TF-IDF (relational twin): tf * (ln((1+n)/(1+df)) + 1), L2-normalised
def tfidf(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, weight)``.  Terms: runs of two or more word characters on
    lower-cased text.  n and df come from aggregates (no driver round trip);
    the document count is a one-row aggregate joined to every term."""
    toks = explode_rows(df, [id_col], X.word_tokens(F.col(text_col)), "term")
    tf = toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    idf = dfreq.crossJoin(F.broadcast(n)).select(
        "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("raw") / norm).alias("weight"))


def term_scores(weights: DataFrame, term_col: str = "term", value_col: str = "weight") -> DataFrame:
    """Total score per term, highest first."""
    return weights.groupBy(term_col).agg(F.sum(value_col).alias("score")).orderBy(F.col("score").desc(), term_col)


# ---------------------------------------------------------------------------
# F5 exact, repeatable split without a global sort
def hash_split(df: DataFrame, id_col: str, frac: float = 0.25, seed: int = 1,
               bucket_bits: int = 16, flag_col: str = "is_test") -> DataFrame:
    """Flag exactly ``ceil(frac * n)`` rows as test: the rows with the
    smallest ``(hash32(seed, id), id)``.

    A row-number over the whole table would run in one task.  Instead the
    largest test row is found from the ids alone: the hash's top
    ``bucket_bits`` bits form buckets, bucket counts (at most 2^bucket_bits
    rows) tell which bucket holds the cut, and only that bucket is ranked.
    The result is one row, a proven bound, so it is broadcast and every row
    is flagged in one pass that moves nothing.  Rows that share an id share
    their side.
    """
    h = hash32(F.lit(seed), F.col(id_col))
    ids = df.select(F.col(id_col).alias("__id"), h.alias("__h")).withColumn("__b", F.shiftright("__h", 32 - bucket_bits))
    counts = ids.groupBy("__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.select(
        "__b", (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__before"), "__cnt",
        F.ceil(F.sum("__cnt").over(Window.partitionBy()) * F.lit(frac)).alias("__k"))
    cut = cum.where((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__before") + F.col("__cnt")))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "__id"))
    last = (ids.join(F.broadcast(cut), "__b").withColumn("__r", F.col("__before") + rank)
            .where(F.col("__r") == F.col("__k")).agg(F.max(F.struct("__h", "__id")).alias("__last")))
    flag = F.coalesce(F.struct(h.alias("__h"), F.col(id_col).alias("__id")) <= F.col("__last"), F.lit(False))
    return df.crossJoin(F.broadcast(last)).select(*df.columns, flag.alias(flag_col))


# ---------------------------------------------------------------------------
# MLlib stages (used for fitting)
# Terms are hashed: no vocabulary is gathered on the driver and no term is
# dropped.  The space follows the number of distinct terms, HASH_ROOM places
# for each, so as few terms share a feature at any size; LARGEST_SPACE is the
# largest power of two that MLlib can number.
HASH_ROOM, LARGEST_SPACE = 2, 1 << 30


def hashed_counts(input_col: str, output_col: str):
    """An estimator that counts the distinct terms and gives the
    ``HashingTF`` of that many times ``HASH_ROOM`` places."""
    from pyspark.ml import Estimator
    from pyspark.ml.feature import HashingTF

    class HashedCounts(Estimator):
        def _fit(self, dataset):
            n = dataset.select(F.explode(input_col).alias("term")).distinct().count()
            places = min(LARGEST_SPACE, 1 << max(8, (HASH_ROOM * n - 1).bit_length()))
            return HashingTF(inputCol=input_col, outputCol=output_col, numFeatures=places)

    return HashedCounts()


def smooth_idf(input_col: str, output_col: str):
    """An estimator of ``tf * (ln((1 + n) / (1 + df)) + 1)``: MLlib's idf has
    no ``+ 1``, so its fitted weights are raised by one."""
    from pyspark.ml import Estimator
    from pyspark.ml.feature import IDF, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    class SmoothIDF(Estimator):
        def _fit(self, dataset):
            idf = IDF(inputCol=input_col, outputCol="__unused").fit(dataset).idf
            return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol=input_col, outputCol=output_col)

    return SmoothIDF()


def tfidf_stages(text_col: str, out_col: str = "features"):
    """F2 as MLlib stages: tokens -> hashed counts -> smoothed idf -> L2; the
    weights of ``tfidf``."""
    from pyspark.ml.feature import Normalizer, RegexTokenizer
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="[\\p{L}\\p{N}_]{2,}", gaps=False)
    return [tok, hashed_counts("__tok", "__tf"), smooth_idf("__tf", "__idf"), Normalizer(inputCol="__idf", outputCol=out_col, p=2.0)]


def count_stages(text_col: str, out_col: str = "features"):
    """F1 as MLlib stages: char_wb n-grams, then hashed counts."""
    from pyspark.ml.feature import SQLTransformer
    grams = SQLTransformer(statement=(
        "SELECT *, flatten(transform(filter(split(lower(" + text_col + "), '[\\\\t\\\\n\\\\x0B\\\\f\\\\r\\\\x1C-\\\\x1F ]+'), "
        "w -> w <> ''), w -> CASE WHEN length(' ' || w || ' ') <= 4 THEN array(' ' || w || ' ') ELSE concat("
        "transform(sequence(0, length(' ' || w || ' ') - 4), i -> substring(' ' || w || ' ', i + 1, 4)), "
        "CASE WHEN length(' ' || w || ' ') >= 5 THEN transform(sequence(0, length(' ' || w || ' ') - 5), "
        "i -> substring(' ' || w || ' ', i + 1, 5)) ELSE array() END) END)) AS __grams FROM __THIS__"))
    return [grams, hashed_counts("__grams", out_col)]


def hashing_stages(text_col: str, out_col: str = "features", num_features: int | None = 1 << 20):
    """hashing vectorizer (2^20 buckets by default, L2); without a number
    the space follows the distinct terms, as in the other stages."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="[\\p{L}\\p{N}_]{2,}", gaps=False)
    htf = HashingTF(inputCol="__tok", outputCol="__htf", numFeatures=num_features) if num_features else hashed_counts("__tok", "__htf")
    return [tok, htf, Normalizer(inputCol="__htf", outputCol=out_col, p=2.0)]


def doc2vec_stages(text_col: str, out_col: str = "features", partitions: int = 8):
    """document embedding = average of word vectors (30 dims, window 2,
    min count 2, 10 iterations), trained on words in ``partitions`` tasks whose
    vectors are averaged after each iteration."""
    from pyspark.ml.feature import RegexTokenizer, Word2Vec
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="\\s+", gaps=True)
    w2v = Word2Vec(inputCol="__tok", outputCol=out_col, vectorSize=30, windowSize=2, minCount=2, maxIter=10, seed=1,
                   numPartitions=partitions)
    return [tok, w2v]


TRANSFORMERS = {"count": count_stages, "tfidf": tfidf_stages, "hash": hashing_stages, "doc2vec": doc2vec_stages}


def vectorizer_stages(name: str, text_col: str, out_col: str = "features", **kw):
    """F6 dispatcher; unknown names fall back to counts (F1)."""
    return TRANSFORMERS.get(name, count_stages)(text_col, out_col, **kw)
