"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.session import checkpoint_dir

#: Maps every byte that is not part of a `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` word
#: to a space and A-Z to a-z, so `.split()` yields the words.
WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)

#: Words that are separated by white space only, for `regexp_count`.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one numbering bucket holds on average, at any table size.
ROWS_PER_BUCKET = 1 << 11


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage
    ends there, and a lost executor costs no more than a file read."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column) -> Column:
    """A double in (0, 1] from the hash of ``parts``: 53 bits, never zero."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(1)) * F.lit(2.0 ** -53)


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """The power of two that keeps buckets at about ``per_bucket`` rows."""
    return 1 << max(0, (rows // per_bucket).bit_length())


def numbered(df: DataFrame, group: list[str], order: list[Column | str], spread: Column, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, in column ``out``.

    Rows go to hash buckets of ``spread`` whose number follows the row count,
    so no task sorts a whole group: buckets are counted first, a running sum
    over a group's buckets gives each bucket its first number, and rows are
    numbered inside their bucket.  Groups may be null.
    """
    buckets = bucket_count(df.count())
    b, first = "__b", "__first"
    rows = df.withColumn(b, F.pmod(spread, F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    start = start.select(*[F.col(c).alias(f"__{c}") for c in group], F.col(b).alias("__sb"),
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first))
    same = F.col(b) == F.col("__sb")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*group, b).orderBy(*order)
    return (rows.join(start, same)
            .withColumn(out, F.col(first) + F.row_number().over(inside) - F.lit(1))
            .drop(b, "__sb", first, *[f"__{c}" for c in group]))


#: Bytes of a batch that goes to a Python worker; Spark's own bound is 64 MB,
#: of which a worker holds several copies.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give back what this worker's allocators hold unused.  Workers outlive
    their tasks and wait, several to an executor, for the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)


def append_columns(df: DataFrame, needs: list[str], new: list[T.StructField],
                   work: Callable[[Iterator[list[pa.Array]]], Iterator[list[pa.Array]]]) -> DataFrame:
    """All rows and columns of ``df`` with the columns that ``work`` makes.

    ``work`` gets, batch by batch, the columns ``needs`` and yields, batch by
    batch, the arrays of the ``new`` fields, one value per row.  One narrow
    pass: no shuffle, no key, and rows keep all other columns whatever they
    are called.  A new field replaces a column of the same name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df.sparkSession)
    names = {f.name for f in new}
    # inside, columns go by place: Spark would read a dot in a name as a field
    at = {f.name: k for k, f in enumerate(df.schema.fields)}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate([*kept, *new])])
    arrow = to_arrow_schema(schema)
    needed, stay = [at[c] for c in needs], [at[f.name] for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[list[pa.Array]]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    yield [batch.column(k) for k in needed]

        for arrays in work(feed()):
            batch = held.pop(0)
            columns = [batch.column(k) for k in stay] + list(arrays)
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    placed = df.toDF(*(f"c{k}" for k in range(len(at))))
    return placed.mapInArrow(run, schema).toDF(*(f.name for f in [*kept, *new]))
