"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import attach, stored

BLOCK_ROWS = 50_000


class Node(NamedTuple):
    """A shard (no children) or an inner node; an inner node weighs as much as its shards."""

    name: str
    children: tuple = ()
    own: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, racks: int = 2, width: int = 2, base: int = 8, weights: dict[int, float] | None = None) -> Node:
    """Regions of `racks` racks of `width` shards for the first `base` shards; every later shard is a region of its own.

    So growth adds a region and touches no weight inside the old ones: rows move only into the new shard.
    """
    weights = weights or {}
    leaf = lambda i: Node(f"s{i}", (), weights.get(i, 1.0), i)
    first = min(base, shards)
    rack = [Node(f"k{i}", tuple(leaf(j) for j in range(i, min(i + width, first)))) for i in range(0, first, width)]
    region = [Node(f"r{i}", tuple(rack[i:i + racks])) for i in range(0, len(rack), racks)]
    region += [Node(f"r-s{i}", (Node(f"k-s{i}", (leaf(i),)),)) for i in range(first, shards)]
    return Node("root", tuple(region))


def descend(key: Column, node: Node) -> Column:
    """The shard that `key` falls into below `node`.

    At each level every child draws -ln(u) / weight, u being a hash of key and child name in (0, 1); the
    smallest draw wins.  A child whose weight grows can only win keys, so movement stays in its subtree.
    """
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(c.name)), 11).cast("double") + F.lit(0.5))
                              / F.lit(float(2**53))) / F.lit(float(c.weight))).alias("draw"), F.lit(i).alias("at"))
             for i, c in enumerate(node.children)]
    won = F.least(*draws)["at"]
    out = descend(key, node.children[-1])
    for i in range(len(node.children) - 2, -1, -1):
        out = F.when(won == i, descend(key, node.children[i])).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Law `key`: shard and grown_shard follow from doc_id and the number of shards alone, so repeated
    ids share a shard; a null id is hashed as a key of its own.  `size` is the text's UTF-8 bytes plus
    one; the crc32 of a null text is that of no bytes, 0.  `slot` numbers a shard's rows from 0 without gaps,
    in the order of (block, doc_id): rows are counted by hashed blocks of about BLOCK_ROWS, the counts are
    summed, and rows are numbered inside (shard, block), so no shard meets in one task.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    rows = stored(rows, "sizes")
    blocks = max(1, rows.count() // BLOCK_ROWS)
    placed = rows.select(
        "*", F.lit("key").alias("law"), descend(key, tree(shards, weights=weights)).cast("int").alias("shard"),
        descend(key, tree(shards + 1, weights=weights)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, "text_crc32"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "block", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before")), "starts")
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(inside))
    return attach(numbered, starts, ["shard", "block"], "inner").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard")
