"""Approximate nearest neighbours with an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half is
quantised by its own k-means, fitted on a bounded sample, so ``K`` centroids a
half make ``K * K`` cells.  Every distinct vector is indexed under its cell.
A query visits cells in the order of the summed distances of their two
centroids to its own halves, found with a heap over the two sorted lists,
until the cells hold enough entries; these are reranked by exact cosine.

How many entries are enough is measured, not guessed: for a bounded sample of
indexed vectors the true neighbours are found by brute force, and the budget
is what the multi-index needs to reach ``recall`` of them.

Equal vectors are one entry with its smallest ids (more can never be among
the nearest), and equal queries are searched once.  Entries lie in parts of
bounded size, large cells in several; queries travel in blocks to the parts
they visit, where a task holds one part and streams the blocks past it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.llm.common import written

#: Centroids of a half, vectors the centroids are fitted on, vectors the
#: budget is measured on.
K, SAMPLE, PROBES = 64, 8192, 128
#: Entries of a part, queries of a block.
PART, BLOCK = 4096, 256
#: At least so many entries are reranked.
LEAST = 256


@dataclass
class Quantiser:
    left: np.ndarray
    right: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.left), len(self.right)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to the centroids, less a constant."""
        h = self.left.shape[1]
        return tuple((c * c).sum(axis=1) - 2 * part @ c.T for c, part in ((self.left, unit[:, :h]), (self.right, unit[:, h:])))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)


def k_means(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids of ``rows``; no more than there are distinct rows."""
    rows_ = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centre = rows_[np.sort(rng.choice(len(rows_), min(k, len(rows_)), replace=False))].copy()
    for _ in range(rounds):
        own = ((centre * centre).sum(axis=1) - 2 * rows @ centre.T).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        there, start = np.unique(own[order], return_index=True)
        centre[there] = np.add.reduceat(rows[order], start, axis=0) / np.diff(np.append(start, len(own)))[:, None]
    return centre


def unit(rows: np.ndarray) -> np.ndarray:
    # the largest component is scaled out first, so that no square overflows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def visit(a: np.ndarray, b: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """The multi-sequence walk: cells by ascending sum of ``a`` and ``b``
    until they hold ``budget`` entries or none is left."""
    i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    x, y = np.sort(a, kind="stable").tolist(), np.sort(b, kind="stable").tolist()
    width, held, out = len(y), 0, []
    heap = [(x[0] + y[0], 0, 0)]
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = i_of[i] * width + j_of[j]
        out.append(cell)
        held += int(counts[cell])
        # each pair is pushed once: along its row, or down from a row's start
        if j + 1 < width:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each row summed alike.  A power of two
    is taken out of each first, which rounds nothing, so that no square
    overflows or vanishes."""
    def scaled(v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])

    query, rows = scaled(query), scaled(rows)

    def length(v: np.ndarray) -> np.ndarray:
        return np.sqrt((v * v).sum(axis=-1))

    return (rows * query).sum(axis=-1) / (length(rows) * length(query))


def _doubles(column: pa.Array) -> np.ndarray:
    """A column of packed doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v) of the vectors that take part: not null, not zero, all
    components finite, and of the table's most common length (the smaller of
    two equally common ones)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce(~bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0)).distinct()


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``v`` as the bytes of its doubles, beside other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // max(1, batch.num_rows)
            raw = pa.array([r.tobytes() for r in flat.reshape(-1, width)] if batch.num_rows else [], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], raw], names=[*columns, "v"])

    kinds = dict(rows.dtypes)
    return rows.select(*columns, "v").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "v binary"]))


def _sample(entries: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ``n`` entries of smallest hash: ids and vectors."""
    h = F.xxhash64(F.lit("sample"), "entry")
    share = min(1.0, (4 * n + 64) / max(1, total))
    drawn = entries.where(F.shiftrightunsigned(h, 11) * F.lit(2.0 ** -53) <= share)
    rows = drawn.select("entry", "v").orderBy(h, "entry").limit(n).collect()
    return np.array([r["entry"] for r in rows], dtype=np.int64), np.array([np.frombuffer(bytes(r["v"])) for r in rows])


def _best(entries: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, quantiser: Quantiser) -> list[tuple[int, int]]:
    """(probe, cell) of the ``k`` nearest entries of each probe but itself, by
    brute force: one pass, ``k`` rows a probe from each batch."""
    queries = unit(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(_doubles(batch.column("v")))
            entry, cell = batch.column("entry").to_numpy(), quantiser.cells(rows)
            score = queries @ rows.T
            score[ids[:, None] == entry[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(entry)) - 1, axis=1)[:, :k]
            probe = np.repeat(np.arange(len(ids)), top.shape[1])
            flat = top.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe), pa.array(score[probe, flat]), pa.array(cell[flat].astype(np.int64))], names=["probe", "score", "cell"])

    found = entries.select("entry", "v").mapInArrow(run, "probe long, score double, cell long").where(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cell"))
    return [(r["probe"], r["cell"]) for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect()]


def measured_budget(quantiser: Quantiser, counts: np.ndarray, vectors: np.ndarray, truth: list[tuple[int, int]], recall: float) -> int:
    """The entries that must be visited so that ``recall`` of the true
    neighbours are among them."""
    a, b = quantiser.distances(unit(vectors))
    wanted: dict[int, list[int]] = {}
    for probe, cell in truth:
        wanted.setdefault(probe, []).append(cell)
    needed = []
    for probe, cells in wanted.items():
        walk = np.array(visit(a[probe], b[probe], counts, int(counts.sum()) + 1))
        held = np.empty(len(counts), dtype=np.int64)
        held[walk] = np.cumsum(counts[walk])
        needed.extend(held[cells].tolist())
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


def parts_of(counts: np.ndarray, size: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell: a large cell has parts of
    its own, small neighbours share one."""
    first, number = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    at, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > size:
            at, held = at + (held > 0), 0
            first[cell], number[cell] = at, -(-n // size)
            at += int(number[cell])
            continue
        if held + n > size:
            at, held = at + 1, 0
        first[cell] = at
        held += n
    return first, number


def nearest(table: DataFrame, is_query: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest
    rows but its own, by cosine in double precision, ties to the smaller id.

    ``is_query`` tells from the id column which rows ask.  Rows whose id is null, and vectors that are null, zero, not finite or of
    an unusual length take no part, as query or candidate.  Repeated rows
    count once.  With fewer candidates all are returned; a table without
    valid vectors gives no rows.  ``recall`` is the share of true neighbours
    that the budget is set for.
    """
    spark = table.sparkSession
    rows = written(valid_vectors(table, key, vector), "vectors")
    # of equal vectors the k + 1 smallest ids suffice: one may be the query's
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = written(_packed(entries, ["entry", "ids"]), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    sample = unit(_sample(entries, SAMPLE, total)[1])
    half = max(1, sample.shape[1] // 2)
    quantiser = Quantiser(k_means(sample[:, :half], K), k_means(sample[:, half:], K))
    cells = quantiser.shape[0] * quantiser.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = quantiser.cells(unit(_doubles(batch.column("v")))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    index = written(entries.mapInArrow(assign, "entry long, ids array<long>, v binary, cell long"), "multi-index")
    counts = np.zeros(cells, dtype=np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most K * K rows
        counts[r["cell"]] = r["n"]
    ids, vectors = _sample(index, PROBES, total)
    budget = max(LEAST, measured_budget(quantiser, counts, vectors, _best(index, ids, vectors, k, quantiser), recall))
    first, number = parts_of(counts)

    asked = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "v")
    # queries are searched by distinct vector, under the entry's id
    keyed = written(asked.join(rows.groupBy("v").agg(F.min("id").alias("entry")), "v").select("query_id", "entry"), "queries")
    searched = index.join(keyed.select("entry").distinct(), "entry", "left_semi").select("entry", "v")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of queries and each part that one visits."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                entry, v = piece.column("entry").to_numpy(), _doubles(piece.column("v"))
                a, b = quantiser.distances(unit(v))
                seen = np.zeros((len(entry), cells), dtype=bool)
                for row in range(len(entry)):
                    seen[row, visit(a[row], b[row], counts, budget)] = True
                wanted: dict[int, np.ndarray] = {}
                for cell in np.flatnonzero(seen.any(axis=0) & (counts > 0)):
                    for part in range(first[cell], first[cell] + number[cell]):
                        wanted[part] = wanted.get(part, False) | seen[:, cell]
                out = [(part, entry[who].tobytes() + v[who].tobytes() + np.packbits(seen[who], axis=1).tobytes(), int(who.sum())) for part, who in wanted.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], names=["part", "block", "n"])

    places = spark.createDataFrame([(c, int(first[c]), int(number[c])) for c in range(cells) if counts[c]], "cell long, first long, number long")
    none = F.lit(None)
    stored = index.join(F.broadcast(places), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("entry"), F.col("number"))).alias("part"), F.lit(0).alias("kind"),
        F.col("cell").alias("n"), F.col("ids"), F.col("v").alias("data"))
    asking = searched.mapInArrow(blocks, "part long, block binary, n long").select(
        "part", F.lit(1).alias("kind"), "n", none.cast("array<bigint>").alias("ids"), F.col("block").alias("data"))
    met = stored.unionByName(asking).repartition("part").sortWithinPartitions("part", "kind")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, entries_, packed = None, [], None
        for batch in batches:
            result: tuple[list, list, list] = ([], [], [])
            for p, kind, n, own, data in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "n", "ids", "data")), strict=True):
                if p != part:
                    part, entries_, packed = p, [], None
                if kind == 0:
                    entries_.append((n, own, data))
                    continue
                if packed is None:
                    rows_ = np.frombuffer(b"".join(e[2] for e in entries_), dtype=np.float64).reshape(len(entries_), -1)
                    packed = np.array([e[0] for e in entries_]), rows_, unit(rows_)
                where, rows_, units = packed
                width = rows_.shape[1]
                query = np.frombuffer(data, dtype=np.int64, count=n)
                v = np.frombuffer(data, dtype=np.float64, count=n * width, offset=8 * n).reshape(n, width)
                bits = np.frombuffer(data, dtype=np.uint8, offset=8 * n * (1 + width)).reshape(n, -1)
                seen = np.unpackbits(bits, axis=1)[:, where].astype(bool)
                score = np.where(seen, unit(v) @ units.T, -np.inf)
                # products round in their own way: what is near the last place is scored exactly
                last = min(k + 1, score.shape[1]) - 1
                bound = -np.partition(-score, last, axis=1)[:, last] - 1e-9
                for row in range(n):
                    near = np.flatnonzero((score[row] >= bound[row]) & seen[row])
                    exact = cosine(v[row], rows_[near])
                    found = sorted((-s, i) for s, e in zip(exact.tolist(), near.tolist(), strict=True) for i in entries_[e][1])[: k + 1]
                    for s, i in found:
                        result[0].append(int(query[row]))
                        result[1].append(i)
                        result[2].append(-s)
            if result[0]:
                yield pa.RecordBatch.from_arrays([pa.array(result[0], pa.int64()), pa.array(result[1], pa.int64()), pa.array(result[2], pa.float64())], names=["entry", "vec_id", "score"])

    found = met.mapInArrow(rerank, "entry long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("entry").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    # of each query's list its own row goes, and the first k stay
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = keyed.join(best, "entry").select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

