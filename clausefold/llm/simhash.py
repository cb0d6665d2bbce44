"""SimHash near-duplicates with pivot distance tables.

1. Each text gets a 64-bit fingerprint from the XXH64 hashes of its shingles.
2. Fingerprints are reduced to the distinct ones, so exact copies, however
   many, cost one row from here on.
3. Two fingerprints that differ in at most ``distance`` bits agree on at least
   ``BLOCKS - distance`` of ``BLOCKS`` bit blocks.  For every choice of that
   many blocks, fingerprints that agree on them meet in one group; a group
   that is too large for one task is met chunk against chunk.
4. In a group each fingerprint has a row in a pivot table: its Hamming
   distances to ``PIVOTS`` reference fingerprints.  By the triangle inequality
   a pair whose rows differ by more than ``distance`` in any coordinate is no
   link and is discarded; survivors are verified on all 64 bits.  Only a
   spanning forest of a group's links is emitted, never all its pairs.
5. Links become components by alternating stars, each round a written table.

The blocks bring pairs together because pivots alone can't: the distances of
unrelated fingerprints to any pivot lie within 3 of each other almost every
second time, so no key made of them is both selective and complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import append_columns, binary, written

SEED = 42
BLOCKS = 6
PIVOTS = 16
#: Fingerprints of a group that one task meets; more are split into chunks.
CHUNK = 4096
#: Pivots: fixed pseudo-random fingerprints, by a rule.
_PIVOT_BITS = np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(PIVOTS)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included; of
    the whole sequence if it has fewer words; 0 if it has none."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """All rows and columns of ``docs`` with the fingerprint as a signed long;
    a null text has no words."""

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (text,) in batches:
            found = np.fromiter((fingerprint(t or b"", shingle) for t in binary(text)), dtype=np.uint64, count=len(text))
            yield [pa.array(found.view(np.int64))]

    return append_columns(docs, ["text"], [T.StructField(name, T.LongType())], work)


def _masks(distance: int) -> list[int]:
    """For each choice of blocks that must agree, the mask of their bits."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ _PIVOT_BITS).astype(np.int8)


def _linked(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of rows link, element by element: the pivot coordinates
    discard, the survivors are verified."""
    near = np.abs(ta - tb).max(axis=-1) <= distance
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
    return near


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints:
    a breadth-first search that compares a node only with nodes not reached,
    first on their pivot coordinates, one pivot at a time."""
    table = _pivot_table(fp)
    # in the order of the first coordinate, near nodes lie in a narrow range
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    lead = table[:, 0]
    free = np.ones(len(fp), dtype=bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(fp)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            node = queue.pop()
            low, high = np.searchsorted(lead, lead[node] - distance), np.searchsorted(lead, lead[node] + distance, side="right")
            left = low + np.flatnonzero(free[low:high])
            for p in range(1, PIVOTS):
                if len(left) < 64:
                    break
                left = left[np.abs(table[left, p] - table[node, p]) <= distance]
            got = left[np.bitwise_count(fp[left] ^ fp[node]) <= distance]
            free[got] = False
            queue.extend(got.tolist())
            edges.extend((int(fp[node]), int(x)) for x in fp[got])
    return edges


#: Groups of up to so many rows are compared at all offsets at once.
_SMALL = 16


def _group_edges(unit: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many groups whose rows lie together (``unit`` numbers them)."""
    start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(start, len(unit)))
    left, right = [], []
    small = np.repeat(size <= _SMALL, size)
    at = np.flatnonzero(small)
    f, u, table = fp[at], unit[at], _pivot_table(fp[at])
    for step in range(1, _SMALL):
        same = np.flatnonzero(u[step:] == u[:-step])
        if not len(same):
            break
        link = same[_linked(f[same], table[same], f[same + step], table[same + step], distance)]
        left.append(f[link])
        right.append(f[link + step])
    for a, n in zip(start[size > _SMALL], size[size > _SMALL], strict=True):
        edges = _forest(np.unique(fp[a : a + n]), distance)
        if edges:
            pair = np.array(edges, dtype=np.uint64)
            left.append(pair[:, 0])
            right.append(pair[:, 1])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b), a < b, among the distinct fingerprints ``fp`` that keep
    every pair within ``distance`` bits connected."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(distance))])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp")
    sizes = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(sizes, ["choice", "key"])
    chunks = F.call_function("div", F.col("n") - 1, F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks + 1).cast("int")
    # a chunk meets itself and every other chunk of its group
    units = F.transform(F.sequence(F.lit(0), chunks), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j")))
    met = met.select("choice", "key", "fp", F.explode(units).alias("u")).select("choice", "key", "u.i", "u.j", "fp")
    met = met.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(columns[0]), dtype=bool)
            for c in columns[:4]:
                change[1:] |= c[1:] != c[:-1]
            a, b = _group_edges(np.cumsum(change), columns[4].view(np.uint64), distance)
            pair = np.stack([a, b]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair.min(axis=0)), pa.array(pair.max(axis=0))], names=["a", "b"])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate([r, c]) for r, c in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            # the last group may go on in the next batch
            other = np.zeros(len(columns[0]), dtype=bool)
            for c in columns[:4]:
                other |= c != c[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield found([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if rest is not None and len(rest[0]):
            yield found(rest)

    return met.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that
    it reaches.  Alternating large and small stars, until nothing changes; a
    round is two aggregations and a written table.  No star is gathered: a
    node's smallest neighbour is a partial aggregate that is joined back."""
    now, seen = written(edges, "links"), None

    def least(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u")

    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        met = least(down)
        small = met.where("v != m").select("m", "v").unionAll(met.select("m", "u")).toDF("a", "b").where("a < b").distinct()
        now = written(small, "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select("a", "a").distinct().toDF("node", "root"))


def _rooted(distinct: DataFrame, distance: int) -> DataFrame:
    """(fp, least) with the component's smallest fingerprint as ``root``."""
    distinct = written(distinct, "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), distance))
    return distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that a row reaches
    over links of at most ``distance`` differing bits.

    Null and blank texts have fingerprint 0 and link like any other.  Repeated
    rows are rows of one component.  A null doc_id is never the smallest
    unless a component has no other; an empty table gives no rows.
    """
    table = written(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    roots = _rooted(table.groupBy("fp").agg(F.min("doc_id").alias("least")), distance)
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("own"), "component_id")
    # the side with the rows of all documents is on the left: AQE may split it
    return table.join(named, table["fp"] == named["own"], "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays,
    that with the smallest doc_id, null last, and then the smallest row hash.

    A doc_id, null or not, may name rows of several components; each of them
    keeps a row.  Rows are told apart by doc_id and 128 bits of their hash, so
    equal rows are of one component, and one of them stays.
    """
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    # hashes pass over nulls, so where these are is hashed too
    parts = [x for c in plain for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    halves = ["__high", "__low"]
    rows = docs.select("*", *[F.xxhash64(F.lit(i), *parts).alias(h) for i, h in enumerate(halves)])
    table = fingerprints(rows.select("doc_id", "text", *halves), shingle).select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *halves).alias("row"))
    roots = _rooted(table.groupBy("fp").agg(F.min("row").alias("least")), distance)
    kept = roots.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.doc_id").alias("__id"), *[F.col(f"k.{h}").alias(f"{h}_kept") for h in halves])
    same = rows["doc_id"].eqNullSafe(kept["__id"])
    for h in halves:
        same = same & (rows[h] == kept[f"{h}_kept"])
    return rows.join(kept, same).dropDuplicates(["doc_id", *halves]).select(*[F.col(f"`{c}`") for c in docs.columns])
