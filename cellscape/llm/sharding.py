"""Sharding by a weighted hash tree.

A shard is found by descending region, rack and shard level.  At every node each child gets an
exponential draw -ln(u)/weight from the hash of key and child name, and the least draw wins, so a
child is chosen in proportion to its weight.  A node's weight is the sum of its leaves.  When leaves
change, only draws of nodes on their paths change: rows move inside subtrees whose weight changed,
or into a subtree that grew, and nowhere else.  A shard that joins as a region of its own therefore
takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.llm.common import text_of, uniform
from cellscape.session import cut_lineage


@dataclass(frozen=True)
class Node:
    """A leaf holds a shard number and its weight; an inner node holds children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


@dataclass(frozen=True)
class TreeShape:
    """Shards fill racks, racks fill regions; shards beyond ``planned`` join as regions of their own."""

    shards_per_rack: int = 2
    racks_per_region: int = 2
    planned: int = 16
    weights: dict[int, float] = field(default_factory=dict)


def build_tree(shards: int, shape: TreeShape = TreeShape()) -> Node:
    """The tree of ``shards`` shards; node names depend on positions only, never on the number of shards."""
    if shards < 1:
        raise ValueError("a tree needs at least one shard")

    def leaf(s: int) -> Node:
        return Node(f"s{s}", shard=s, own_weight=shape.weights.get(s, 1.0))

    per_region = shape.shards_per_rack * shape.racks_per_region
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(min(shards, shape.planned)):
        regions.setdefault(s // per_region, {}).setdefault(s // shape.shards_per_rack, []).append(leaf(s))
    top = [
        Node(f"g{g}", tuple(Node(f"g{g}r{r}", tuple(leaves)) for r, leaves in racks.items()))
        for g, racks in regions.items()
    ]
    top += [Node(f"n{s}", (Node(f"n{s}r", (leaf(s),)),)) for s in range(shape.planned, shards)]
    return Node("root", tuple(top))


def descend(node: Node, key: Column) -> Column:
    """The shard number of a key below a node, as one expression."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no weight below {node.name}")
    if len(live) == 1:
        return descend(live[0], key)
    draws = [F.struct((-F.log(uniform(key, F.lit(c.name))) / F.lit(float(c.weight))).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(live)]
    won = F.least(*draws)["i"]
    chosen = F.when(won == 0, descend(live[0], key))
    for i, child in enumerate(live[1:], 1):
        chosen = chosen.when(won == i, descend(child, key))
    return chosen


def assign_shards(df: DataFrame, key: Column, trees: dict[str, Node]) -> DataFrame:
    """Add one shard column per tree.  A null key is a key like any other; equal keys share a shard."""
    fixed = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    return df.withColumns({name: descend(tree, fixed).cast("int") for name, tree in trees.items()})


def number_slots(df: DataFrame, shard: str, order: list[str], slot: str, rows_per_group: int = 50_000) -> DataFrame:
    """Add gapless numbers from 0 inside each shard without sorting a shard in one task.

    Rows of a shard are dealt into hashed groups, the groups' counts give each its first number by a
    running sum over the (small) count table, and only a group is sorted.  ``df`` is read twice, so
    it should be a written table.
    """
    rows = df.count()
    shards = max(1, df.select(shard).distinct().count())
    groups = max(1, -(-rows // (shards * rows_per_group)))
    dealt = df.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = dealt.groupBy(shard, "__group").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn(
        "__start",
        F.sum("__n").over(Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"),
    ).drop("__n")
    inside = Window.partitionBy(shard, "__group").orderBy(*order)
    return (
        dealt.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts, [shard, "__group"])
        .withColumn(slot, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__group", "__start", "__at")
    )


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", shape: TreeShape = TreeShape()) -> DataFrame:
    """One row per document: size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    Null text: size 1, CRC of nothing.  Null ids share one key.  Repeated rows keep a slot each.
    Other columns are dropped, so clashing names cannot matter.  An empty table gives no rows.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
    )
    placed = assign_shards(slim, F.col("doc_id"), {"shard": build_tree(shards, shape), "grown_shard": build_tree(shards + 1, shape)})
    placed = cut_lineage(placed.withColumn("law", F.lit("key")))
    numbered = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
