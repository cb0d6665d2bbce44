"""Hard negatives by best-first search in STR-packed R-trees.

Vectors become integer vectors.  The rows are range-sorted by their first
coordinate and packed, some thousands at a time, into R-trees: inside each
label sort-tile-recursive cuts (one coordinate after the other) make leaves,
and consecutive leaves make the levels above.  The minimum bounding box of a
node gives, coordinate by coordinate, an interval for the inner product with
an anchor; a queue opens the node of the largest possible product first and
leaves out those outside the score windows or strictly below the kth best.

Anchors are taken in blocks of bounded size, each sent to all tasks; a task
goes through its trees one by one and keeps the best of each anchor, so its
answer does not grow with the rows.  Each block's answers are written before
the next block starts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import bound_batches, shared_folder, written

#: Rows of a leaf, children of a node, rows of a tree, anchors of a block.
LEAF, FANOUT, TREE, BLOCK = 64, 8, 4096, 1 << 14

#: Components that fit 32 bits travel as such; sums of products below this are
#: exact in doubles.
SMALL, EXACT = 1 << 31, 1 << 53

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), exact also where the product overflows a double."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * scale)


def integers(vector: list[float], scale: int) -> list[int]:
    return [scaled(float(x), scale) for x in vector]


def matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Integer vectors as rows, missing components 0: doubles if all inner
    products are exact in them, Python integers if not."""
    rows = [v + [0] * (width - len(v)) for v in vectors]
    largest = max((abs(x) for v in rows for x in v), default=0)
    kind = np.float64 if largest * largest * max(width, 1) < EXACT else object
    return np.array(rows, dtype=kind).reshape(len(rows), width)


def tiles(rows: np.ndarray, size: int, coordinate: int = 0) -> list[np.ndarray]:
    """Sort-tile-recursive: positions of ``rows`` in leaves of at most
    ``size``.  Each coordinate in turn cuts a slab into as many slabs as the
    coordinates left need."""
    def cut(own: np.ndarray, c: int) -> Iterator[np.ndarray]:
        pages = -(-len(own) // size)
        if pages <= 1:
            yield own
            return
        left = rows.shape[1] - c
        slabs = pages if left <= 1 else max(2, math.ceil(pages ** (1 / left) - 1e-9))
        if rows.shape[1]:
            own = own[np.argsort(rows[own, min(c, rows.shape[1] - 1)], kind="stable")]
        step = size * -(-pages // slabs)
        for at in range(0, len(own), step):
            yield from cut(own[at : at + step], c + 1)

    return list(cut(np.arange(len(rows)), coordinate)) if len(rows) else []


class Tree:
    """An R-tree over rows of any labels; each label has a subtree of its own."""

    def __init__(self, ids: np.ndarray, names: list[bytes], labels: np.ndarray, rows: np.ndarray) -> None:
        order, starts, tops = [], [], []
        self.low, self.high, self.child, self.label = [], [], [], []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            leaves = [own[t] for t in tiles(rows[own], LEAF)]
            level = []
            for leaf in leaves:
                at = sum(len(o) for o in order) if not starts else starts[-1][1]
                order.append(leaf)
                starts.append((at, at + len(leaf)))
                level.append(self._node(rows[leaf].min(axis=0), rows[leaf].max(axis=0), ("leaf", at, at + len(leaf)), int(label)))
            while len(level) > 1:
                groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
                level = [self._node(np.min([self.low[c] for c in g], axis=0), np.max([self.high[c] for c in g], axis=0), ("node", g), int(label)) for g in groups]
            tops.append(level[0])
        at = np.concatenate(order)
        self.ids, self.rows, self.names, self.roots = ids[at].tolist(), rows[at], [names[i] for i in at], tops
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self, low: np.ndarray, high: np.ndarray, child: tuple, label: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.child.append(child)
        self.label.append(label)
        return len(self.child) - 1

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest inner product that each node's box allows each
        anchor: every coordinate's interval, added up."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up.dot(self.low.T) + down.dot(self.high.T), up.dot(self.high.T) + down.dot(self.low.T)


class Best:
    """The best ``k`` of a window of scores: larger first, then smaller id."""

    def __init__(self, k: int, low: int | float, high: int | float) -> None:
        self.k, self.low, self.high = k, low, high
        self.found: list[tuple] = []  # (-score, id, name), ascending

    def kth(self) -> int | float:
        return -self.found[-1][0] if len(self.found) == self.k else -math.inf

    def wants(self, low: int | float, high: int | float) -> bool:
        """Whether a box of this interval may hold an entry."""
        return high >= self.low and low <= self.high and min(high, self.high) >= self.kth()

    def add(self, score: int, own_id: int, name: bytes) -> None:
        entry = (-score, own_id, name)
        if len(self.found) < self.k or entry < self.found[-1]:
            self.found = sorted([*self.found, entry])[: self.k]


def search(tree: Tree, anchor: np.ndarray, name: bytes, low: np.ndarray, high: np.ndarray, wanted: Callable[[int], bool], windows: list[Best]) -> int:
    """Best-first: put the tree's rows of wanted labels, but ``name``, into
    the windows.  Returns the leaves that were opened."""
    top = max((w.high for w in windows), default=0)
    queue = [(-min(high[r], top), r) for r in tree.roots if wanted(tree.label[r])]
    heapq.heapify(queue)
    opened = 0
    while queue:
        _, node = heapq.heappop(queue)
        here = [w for w in windows if w.wants(low[node], high[node])]
        if not here:
            continue
        if tree.child[node][0] == "node":
            for c in tree.child[node][1]:
                if any(w.wants(low[c], high[c]) for w in here):
                    heapq.heappush(queue, (-min(high[c], top), c))
            continue
        _, a, b = tree.child[node]
        opened += 1
        scores = tree.rows[a:b].dot(anchor)
        for w in here:
            least = max(w.low, w.kth())
            for i in np.flatnonzero((scores >= least) & (scores <= w.high)).tolist():
                if tree.names[a + i] != name:
                    w.add(int(scores[i]), tree.ids[a + i], tree.names[a + i])
    return opened


# ---------------------------------------------------------------------------
def valid_rows(table: DataFrame, key: str, vector: str, label: str, relabel: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Distinct (id, label, v, name) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(~bad, F.lit(False)))
    if relabel:
        rows = rows.withColumn("label", relabel(F.col("id"), F.col("label")))
    return rows.distinct()


def packed_trees(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """(ids, names, labels, rows): one row per tree of at most TREE entries,
    in the order of the leaves."""
    first = F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(0.0))
    dealt = rows.repartitionByRange(parts, first, "id").sortWithinPartitions(first, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[float]]] = []

        def tree() -> pa.RecordBatch:
            ids, labels, vectors = zip(*held, strict=True)
            held.clear()
            whole = [integers(v, scale) for v in vectors]
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(labels)], pa.list_(pa.int64())),
                                               pa.array([[vector_bytes(v) for v in whole]], pa.list_(pa.binary()))], names=["ids", "labels", "rows"])

        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.append(row)
                if len(held) == TREE:
                    yield tree()
        if held:
            yield tree()

    bound_batches(rows.sparkSession)
    return dealt.select("id", "label", "v").mapInArrow(run, "ids array<long>, labels array<long>, rows array<binary>")


def vector_bytes(v: list[int]) -> bytes:
    """32-bit integers, or decimals where one is larger."""
    if all(-SMALL <= x < SMALL for x in v):
        return b"\x00" + np.array(v, dtype=np.int32).tobytes()
    return b"\x01" + ",".join(map(str, v)).encode()


def vector_of(raw: bytes) -> list[int]:
    if raw[:1] == b"\x00":
        return np.frombuffer(raw, dtype=np.int32, offset=1).tolist()
    return [int(x) for x in raw[1:].decode().split(",")]


def row_name(own_id: int, label: int, raw: bytes) -> bytes:
    return b"%d,%d," % (own_id, label) + raw


def _visit(trees: DataFrame, anchors: list[tuple[bytes, int, bytes, list]], k: int, same_label: bool) -> DataFrame:
    """(anchor, slot, score, id, name): per task the best ``k`` of each slot of
    each anchor.  Anchors are (name, label, vector, windows by slot)."""
    sent = trees.sparkSession.sparkContext.broadcast(anchors)
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.string()), ("id", pa.int64()), ("name", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        vectors = [vector_of(a[2]) for a in asked]
        kept = [[Best(k, low, high) for low, high in a[3]] for a in asked]
        for batch in batches:
            for ids, labels, raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "rows")), strict=True):
                own = [vector_of(r) for r in raw]
                width = max(map(len, own + vectors))
                both = matrix(own + vectors, width)
                names = [row_name(i, x, r) for i, x, r in zip(ids, labels, raw, strict=True)]
                tree = Tree(np.array(ids), names, np.array(labels), both[: len(own)])
                for at in range(0, len(asked), 256):
                    piece = both[len(own) + at : len(own) + at + 256]
                    low, high = tree.intervals(piece)
                    low, high = low.tolist(), high.tolist()
                    for i in range(len(piece)):
                        name, label = asked[at + i][0], asked[at + i][1]
                        wanted = (lambda x, y=label: x == y) if same_label else (lambda x, y=label: x != y)
                        search(tree, piece[i], name, low[i], high[i], wanted, kept[at + i])
        out = [(i, slot, str(-s), own_id, name) for i, slots in enumerate(kept) for slot, w in enumerate(slots) for s, own_id, name in w.found]
        for at in range(0, len(out), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 8192], strict=True), schema, strict=True)], schema=schema)

    found = trees.mapInArrow(run, "anchor long, slot int, score string, id long, name binary")
    # products beyond 64 bits are told apart here as decimals of any length
    size = F.length("score")
    by_size = F.when(F.col("score").startswith("-"), -size).otherwise(size)
    digits = F.when(F.col("score").startswith("-"), F.translate("score", "0123456789", "9876543210")).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(by_size.desc(), digits.desc(), "id", "name"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(table: DataFrame, is_anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] | None = None,
                   positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score.

    Each component x counts as floor(scale * x), a row's score is its inner
    product with the anchor; higher scores come first, ties by smaller id.  An
    anchor's positives are its first other rows of the same label.  For each,
    the first rows of other labels are returned whose score is from
    ``window[0]`` to ``window[1]`` hundredths of the positive's.
    ``is_anchor`` tells from the id which rows ask, ``relabel`` gives a label
    from id and label beforehand.

    Rows with a null id or label, a null vector, or a null or non-finite
    component take no part.  Rows that agree in id, label and vector count
    once; rows of one id that differ are rows of their own.  A shorter vector
    counts as filled up with zeros.  Scores are exact integers; beyond 64 bits
    they are returned as the nearest long.  Without anchors, positives or rows
    in the window there are no rows; other columns play no part.
    """
    spark = table.sparkSession
    rows = written(valid_rows(table, key, vector, label, relabel), "labelled-vectors")
    parts = max(1, min(-(-rows.count() // TREE), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    trees = written(packed_trees(rows, scale, parts), "vector-trees")
    asked = rows.where(is_anchor(F.col("id")))
    blocks = max(1, -(-asked.count() // block))
    folder = shared_folder(spark, "hard-negatives")
    low, high = window
    result = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType())
                           for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])

    def as_long(x: int) -> int:
        return min(max(x, LEAST), MOST)

    for k in range(blocks):
        # blocks are dealt by hash, so each is near BLOCK anchors at any size
        own = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == k).collect()
        anchors = []
        for r in own:
            raw = vector_bytes(integers(r["v"], scale))
            anchors.append((row_name(r["id"], r["label"], raw), r["label"], raw, r["id"]))
        near = _visit(trees, [(*a[:3], [(-math.inf, math.inf)]) for a in anchors], positives, True)
        pairs: list[list[tuple[int, int]]] = [[] for _ in anchors]
        for r in sorted(near.collect(), key=lambda r: (r["anchor"], r["place"])):  # at most `positives` an anchor
            pairs[r["anchor"]].append((r["id"], int(r["score"])))
        windows = [[(-(-low * score // 100), high * score // 100) for _, score in own_pairs] for own_pairs in pairs]
        found = _visit(trees, [(*a[:3], w) for a, w in zip(anchors, windows, strict=True)], negatives, False)
        known = spark.createDataFrame(
            [(i, slot, a[3], p, as_long(s)) for i, (a, own_pairs) in enumerate(zip(anchors, pairs, strict=True)) for slot, (p, s) in enumerate(own_pairs)],
            "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        score = F.when(F.col("score").rlike("^-?[0-9]{1,18}$"), F.col("score").try_cast("long")).otherwise(
            F.coalesce(F.col("score").try_cast("long"), F.when(F.col("score").startswith("-"), F.lit(LEAST)).otherwise(F.lit(MOST))))
        found.join(known, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", score.alias("negative_score"),
        ).write.mode("overwrite").parquet(f"{folder}/block={k}")
    return spark.read.schema(result).parquet(*[f"{folder}/block={k}" for k in range(blocks)])


def negative_digest(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; ids divisible
    by 7 first get the next label of ten."""
    return hard_negatives(embeddings, lambda i: i % 50 == 0, lambda i, x: F.when(i % 7 == 0, (x + 1) % 10).otherwise(x))
