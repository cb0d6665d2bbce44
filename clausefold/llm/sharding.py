"""Sharding by a hierarchical weighted hash tree.

Shards hang below racks, racks below regions.  A row descends level by level:
at each node every child draws ``-ln(u) / weight`` with ``u`` from the hash of
the row's key and the child's name, and the smallest draw wins.  A child wins
in proportion to its weight, and its draw depends on nothing but its own name
and weight; so a row moves only when a weight on its way changes, and then
only into a subtree that has gained or out of one that has lost.

All of it is Column expressions; the tree is a literal whose size follows the
number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausefold.llm.common import numbered, uniform


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard; ``name`` is unique among its siblings and
    never changes.  An inner node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


#: Shards of the regions that are there from the start.
BASE = 8


def default_tree(shards: int, base: int = BASE) -> Node:
    """The tree for shards ``0 .. shards - 1``, all of weight 1.

    The first ``base`` shards fill two regions of two racks.  Every later
    shard comes as a region of its own: the other regions keep their weights,
    so the rows that move when it is added all move into it.
    """
    if shards < 1:
        raise ValueError("a tree needs at least one shard")

    def cut(ids: list[int], parts: int) -> list[list[int]]:
        edges = [len(ids) * k // parts for k in range(parts + 1)]
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def region(name: str, ids: list[int], racks: int) -> Node:
        return Node(name, tuple(Node(f"rack{r}", tuple(Node(str(s)) for s in own)) for r, own in enumerate(cut(ids, racks))))

    first = [region(f"region{k}", ids, 2) for k, ids in enumerate(cut(list(range(min(shards, base))), 2))]
    later = [region(f"added{s}", [s], 1) for s in range(base, shards)]
    return Node("root", tuple(first + later))


def _literal(node: Node, path: str, depth: int) -> Column:
    own = f"{path}/{node.name}"
    fields = [F.lit(own).alias("path"), F.lit(float(node.weight)).alias("weight")]
    if depth:
        fields.append(_children(node, own, depth - 1).alias("children"))
    else:
        fields.append(F.lit(int(node.name)).alias("shard"))
    return F.struct(*fields)


def _children(node: Node, path: str, depth: int) -> Column:
    alive = [c for c in node.children if c.weight > 0]
    if not alive:
        raise ValueError(f"{path} has no child of positive weight")
    return F.array(*[_literal(c, path, depth) for c in alive])


def shard_of(key: Column, tree: Node) -> Column:
    """The shard (int) that ``key`` descends to.  A null key hashes like any
    other value: all rows without a key share one shard.  Nodes of weight 0
    take no row."""

    def winner(children: Column) -> Column:
        draws = F.transform(children, lambda c: F.struct((-F.log(uniform(key, c["path"])) / c["weight"]).alias("draw"), c.alias("child")))
        return F.array_min(draws)["child"]

    alive = Node(tree.name, tuple(
        Node(r.name, tuple(k for k in r.children if k.weight > 0)) for r in tree.children if r.weight > 0))
    return winner(winner(winner(_children(alive, "", 2))["children"])["children"])["shard"].cast("int")


def place(rows: DataFrame, key: str, tree: Node, grown: Node | None = None) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and, if ``grown`` is given,
    ``grown_shard``.

    Slots number the rows of a shard from 0 without gaps, in an order that the
    whole row decides; no task sorts a whole shard.  Rows that agree in every
    column are interchangeable.  An empty table gives an empty result.
    """
    out = rows.withColumn("shard", shard_of(F.col(key), tree))
    out = out.withColumn("grown_shard", shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"))
    order = [F.col(c) for c in rows.columns]
    return numbered(out, ["shard"], order, F.xxhash64(*order), "slot")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place documents: doc_id, size (UTF-8 bytes of the text plus 1),
    text_crc32, law, shard, slot, grown_shard (the shard with one more).

    Only doc_id and the number of shards decide.  A null text has no bytes
    and the checksum 0; equal rows get different slots of one shard; columns
    other than doc_id and text are not read.  The law ``key`` holds from the
    tree's ``BASE`` shards on; fewer are an error.
    """
    if shards < BASE:
        raise ValueError(f"at least {BASE} shards")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + F.lit(1)).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = place(rows, "doc_id", default_tree(shards), default_tree(shards + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), "grown_shard")
