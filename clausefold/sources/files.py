"""Readers and writers for the label / text / annotation file formats
(S1-S3, S9-S12, S14).

Every reader is a Spark scan (CSV, text, binaryFile) over a folder, so a
folder of any size is read in parallel; order-dependent rules (last row of
a key wins) use the file position carried by ``_metadata`` instead of the
input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.functions import ids as I
from clausefold.functions import text as X


def _file_order() -> Column:
    """Position of a row in its file: (path, split start, row id).  Row ids
    grow with the row order inside a split."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                    F.monotonically_increasing_id())


# ---------------------------------------------------------------------------
# Multi-level label CSVs
def read_labels(spark: SparkSession, path: str, columns: list[str], id_col: str = "id") -> DataFrame:
    """One label level: CSV without header; cells after the key stripped, empty
    or missing ones empty; rows with fewer than two fields dropped; a repeated
    key keeps its last row (file order)."""
    schema = T.StructType([T.StructField(id_col, T.StringType())] +
                          [T.StructField(c, T.StringType()) for c in columns])
    lines = spark.read.text(path).select("value", _file_order().alias("__ord"))
    # a second field begins at a comma; its cell may be empty
    rows = lines.where(F.col("value").contains(",")).select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " ")).alias("r"), "__ord")
    stripped = rows.select(F.col(f"r.{id_col}").alias(id_col), *[
        F.coalesce(X.strip_ws(F.col(f"r.{c}")), F.lit("")).alias(c) for c in columns], "__ord")
    last = stripped.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.col("__ord")).alias("__row"))
    return last.select(id_col, *[F.col(f"__row.{c}").alias(c) for c in columns])


def read_label_levels(spark: SparkSession, folder: str, files: list[str], columns: list[list[str]]) -> list[DataFrame]:
    """One DataFrame per level; file names are a parameter."""
    return [read_labels(spark, f"{folder}/{f}", cols) for f, cols in zip(files, columns)]


# ---------------------------------------------------------------------------
# Text files, one per id
def read_texts(spark: SparkSession, folder: str, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """S3: ``(id, text)`` from ``<folder>/<id>.txt`` (whole file = one text);
    when ``ids`` is given only those ids are kept (semi join)."""
    t = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.txt$", 1).alias(id_col), F.col("value").alias("text"))
    t = t.where(F.col(id_col) != "")
    if ids is not None:
        t = t.join(ids.select(id_col), id_col, "left_semi")
    return t


def read_flat_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``classes.csv`` (id, label) and ``texts/*.txt``; returns
    ``(rows, mismatches)`` where mismatches are ids present on one side only."""
    labels = read_labels(spark, f"{folder}/classes.csv", ["label"])
    texts = read_texts(spark, f"{folder}/texts")
    rows = labels.join(texts, "id", "inner")
    mism = labels.select("id", F.lit("label_only").alias("side")).join(texts.select("id"), "id", "left_anti").unionByName(
        texts.select("id", F.lit("text_only").alias("side")).join(labels.select("id"), "id", "left_anti"))
    return rows, mism


# ---------------------------------------------------------------------------
# Several datasets as one, ids prefixed with the dataset number
def read_many_label_sets(spark: SparkSession, folders: list[str], file: str, columns: list[str],
                         width: int = 5) -> DataFrame:
    """The label file of every dataset folder in one scan; datasets are
    numbered by sorted folder path (dense rank over the distinct folders,
    a small table), header rows whose id is ``id`` are skipped, and ids
    become ``<number>_<id>``."""
    schema = T.StructType([T.StructField("id", T.StringType())] + [T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv([f"{f}/{file}" for f in folders])
    raw = raw.select("*", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dataset"))
    raw = raw.where(F.col("id") != "id")
    nums = raw.select("dataset").distinct().withColumn("docno", F.dense_rank().over(Window.orderBy("dataset")))
    j = raw.join(nums, "dataset")
    return j.select(F.concat_ws("_", I.zfill(F.col("docno"), width), F.col("id")).alias("id"),
                    *[X.strip_ws(F.col(c)).alias(c) for c in columns], "dataset")


# ---------------------------------------------------------------------------
# Encoding repair
# what ISO-8859-1 reads as control characters, and what windows-1252 means
# (its five undefined bytes stay as they are)
_CONTROLS = [bytes([b]) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS_1252 = ("".join(b.decode("latin-1") for b in _CONTROLS), "".join(b.decode("cp1252") for b in _CONTROLS))


def read_repaired_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text, repaired)``: valid UTF-8 is kept, anything else is
    read as windows-1252: decoded as ISO-8859-1, which Spark knows, and the 27
    code points in which the two differ are put right."""
    b = spark.read.format("binaryFile").load(folder).select("path", "content")
    r = repaired_text(F.col("content"))
    return b.select("path", r["text"].alias("text"), r["repaired"].alias("repaired"))


def repaired_text(content: Column) -> Column:
    """S10 on bytes: ``struct(text, repaired)``."""
    as_utf8 = content.cast("string")
    ok = F.is_valid_utf8(as_utf8)
    windows = F.translate(F.decode(content, "ISO-8859-1"), *WINDOWS_1252)
    return F.struct(F.when(ok, as_utf8).otherwise(windows).alias("text"), (~ok).alias("repaired"))


# ---------------------------------------------------------------------------
# Clause listing
def list_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """``(contract, contract_path, clause_path)`` for every file below
    ``folder/<contract>/``; contents are not read (binaryFile prunes them)."""
    p = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return p.select(F.regexp_extract(parent, "([^/]*)$", 1).alias("contract"), parent.alias("contract_path"),
                    F.col("path").alias("clause_path"))


# ---------------------------------------------------------------------------
# Annotation sink
def annotation_outputs(clauses: DataFrame, sentences: DataFrame, clause_label_cols: list[str],
                       sent_label_cols: list[str]) -> dict[str, DataFrame]:
    """The four outputs of an annotation batch.

    ``clauses``: (clause_no, contract, title, <clause labels>)
    ``sentences``: (clause_no, sent_no, suppressed, text, <sentence labels>)
    Clause ids are 4 digits, sentence ids ``<clause>_<3 digits>``; commas in
    titles become spaces; suppressed sentences are skipped.
    """
    cid = I.zfill(F.col("clause_no"), 4)
    kept = sentences.where(~F.coalesce(F.col("suppressed"), F.lit(False)))
    sid = F.concat_ws("_", cid, I.zfill(F.col("sent_no"), 3))
    return {
        "clause_props": clauses.select(cid.alias("id"), "contract", X.title_commas(F.col("title")).alias("title")),
        "clause_labels": clauses.select(cid.alias("id"), *clause_label_cols),
        "sentence_labels": kept.select(sid.alias("id"), *sent_label_cols),
        "sentence_texts": kept.select(sid.alias("id"), "text"),
    }


def write_annotations(outputs: dict[str, DataFrame], folder: str) -> None:
    """Append each output under ``folder/<name>`` (CSV without header, like
    the label files)."""
    for name, df in outputs.items():
        df.write.mode("append").option("header", "false").csv(f"{folder}/{name}")


def read_annotations(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """One output of ``write_annotations``; empty cells stay empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", "false").csv(f"{folder}/{name}")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


# ---------------------------------------------------------------------------
# Document store
def store_documents(texts: DataFrame, documents: DataFrame, folder: str) -> None:
    """``Texts`` (instances) and ``Documents`` (metadata), appended and
    partitioned by domain."""
    texts.write.mode("append").partitionBy("domain").parquet(f"{folder}/Texts")
    documents.write.mode("append").partitionBy("domain").parquet(f"{folder}/Documents")
