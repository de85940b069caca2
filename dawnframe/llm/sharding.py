"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in a region and shards in a rack; a node's weight is the sum of the shards below it.  A key
descends level by level: each child draws ``ln(u) / weight`` with ``u`` in (0, 1] hashed from the key and the child's
name, and the greatest draw wins, so a child wins a share of the keys that equals its share of the weight.

What a change moves.  A draw depends on the key, the child's name and the child's own weight and nothing else.  Where
two shards of a rack change but the rack's weight doesn't, keys move within that rack alone; where two racks change but their
region's weight doesn't, within that region alone.  A child whose weight grows only wins keys and one whose weight shrinks only loses them.
``grown`` therefore gives a new shard a region of its own: no other node's weight changes, so the new shard takes keys
and no key moves between the others, whatever the tree was.

All of it is DataFrame functions on the key; the tree is a literal in the plan.  Nothing is broadcast or collected.
Slots are numbered by ranges of (shard, key), so a shard may hold any share of all rows.

Defined results: a null key is a key like any other (all its rows meet in one shard); repeated rows meet in one shard and
take neighbouring slots; null text has size 1 and checksum 0; an empty table gives an empty table; input columns named as
a result are replaced; weights of zero hold no keys; a tree without any positive weight is refused.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnframe.durable import written
from dawnframe.operators.topk import numbered


class Leaf(NamedTuple):
    """A shard and where it stands."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """A tree of equal shards, numbered from 0."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return [Leaf(f"region{r}", f"rack{k}", i) for i, (r, k) in enumerate(places)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, which takes keys only into itself."""
    number = 1 + max((x.shard for x in tree), default=-1)
    return [*tree, Leaf(f"region-of-{number}", "rack0", number, weight)]


def _children(leaves: Iterable[Leaf], *levels: str) -> Column:
    """Nodes as a literal: array of (node, weight, below), the last level with the shard in place of ``below``."""
    level, *deeper = levels
    groups: dict[str, list[Leaf]] = {}
    for x in leaves:
        groups.setdefault(str(getattr(x, level)), []).append(x)
    nodes = []
    for name, held in sorted(groups.items()):
        path = "/".join([held[0].region, held[0].rack, str(held[0].shard)][: 3 - len(deeper)])
        below = _children(held, *deeper).alias("below") if deeper else F.lit(held[0].shard).alias("below")
        nodes.append(F.struct(F.lit(path).alias("node"), F.lit(float(sum(x.weight for x in held))).alias("weight"), below))
    return F.array(*nodes)


def _winner(children: Column, key: Column) -> Column:
    """What is below the child with the greatest draw."""
    u = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c.node), 11) + 1) / F.lit(float(1 << 53))
    drawn = F.transform(children, lambda c: F.struct((F.log(u(c)) / c.weight).alias("draw"), c.alias("child")))
    return F.array_max(drawn).child.below


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard (int) of a key."""
    used = [x for x in tree if x.weight > 0]
    if not used:
        raise ValueError("no shard has a positive weight")
    if len({x.shard for x in used}) < len(used):
        raise ValueError("a shard stands in two places")
    regions = _children(used, "region", "rack", "shard")
    return _winner(_winner(_winner(regions, key), key), key).cast("int")


def assign(rows: DataFrame, tree: list[Leaf], key: str = "doc_id") -> DataFrame:
    """``rows`` with their ``shard``."""
    return rows.withColumn("shard", shard_of(F.col(key), tree))


def moves(keys: DataFrame, before: list[Leaf], after: list[Leaf], key: str = "doc_id") -> DataFrame:
    """How many rows go from one shard to another: (from, to, n), the unmoved included."""
    return keys.groupBy(shard_of(F.col(key), before).alias("from"), shard_of(F.col(key), after).alias("to")).agg(F.count("*").alias("n"))


def manifest(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Texts are read once for their size and checksum and never shuffled.  Slots follow the key, then size and checksum.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    facts = docs.select(key, size.alias("size"), F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"))
    facts = facts.withColumns({"law": F.lit("key"), "shard": shard_of(F.col(key), tree), "grown_shard": shard_of(F.col(key), grown(tree))})
    slots = numbered(written(facts, "shard-facts"), ["shard"], [key, "size", "text_crc32"], "slot")
    return slots.withColumn("slot", F.col("slot") - 1).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(docs: DataFrame, tree: list[Leaf], path: str, key: str = "doc_id") -> None:
    """The documents as Parquet, a folder for each shard; large shards are split into files by size."""
    assign(docs, tree, key).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
