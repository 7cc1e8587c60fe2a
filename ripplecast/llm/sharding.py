"""Sharding by a weighted hash tree of regions, racks and shards.

A key descends from the root: at each node every child draws ``-ln(u) / weight``, where ``u`` is a
hash of the key and the child's name, and the least draw wins. So a child is chosen in proportion
to its weight, and when one child's weight changes, keys move only to or from that child. A
subtree whose weights, and whose ancestors' weights, do not change keeps every key it had.

A new shard opens a region of its own (``grown``). At the root it is then the only new draw, so
rows move only into the new shard; a change inside a rack with ``reweighted(..., keep_total=True)``
moves rows only between the shards of that rack.

Edge cases: a null key falls back to a hash of the text; rows that repeat a key share a shard and
have slots of their own; a null text has size 8 and the checksum of no bytes; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import running, stored


@dataclass(frozen=True)
class Tree:
    """Shard weights by region and rack: ``regions[r][k]`` maps shard number to weight."""

    regions: tuple[tuple[Mapping[int, float], ...], ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Tree:
        """Shards of equal weight, numbered in order."""
        numbers = iter(range(regions * racks * shards))
        return Tree(
            tuple(
                tuple({next(numbers): 1.0 for _ in range(shards)} for _ in range(racks))
                for _ in range(regions)
            )
        )

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        number = 1 + max(s for region in self.regions for rack in region for s in rack)
        return Tree((*self.regions, ({number: weight},)))

    def reweighted(self, shard: int, weight: float, keep_total: bool = False) -> Tree:
        """With another weight for a shard; ``keep_total`` scales its rack back to its old total."""

        def change(rack: Mapping[int, float]) -> Mapping[int, float]:
            if shard not in rack:
                return rack
            fresh = {**rack, shard: weight}
            scale = sum(rack.values()) / sum(fresh.values()) if keep_total else 1.0
            return {number: w * scale for number, w in fresh.items()}

        return Tree(tuple(tuple(change(rack) for rack in region) for region in self.regions))


def _drawn(key: Column, node: Column, weight: Column) -> Column:
    """An exponential draw with the rate ``weight``: a hash of key and node in (0, 1]."""
    bits = F.shiftrightunsigned(F.xxhash64(key, node), 11)
    return -F.log((bits.cast("double") + 1) / F.lit(float(1 << 53))) / weight


def _choose(key: Column, children: Column) -> Column:
    """Place, in the list, of the child whose draw is least."""
    draws = F.transform(
        children, lambda c: F.struct(_drawn(key, c["node"], c["weight"]).alias("d"), c["at"].alias("at"))
    )
    return F.array_min(draws)["at"]


def _children(nodes: list[tuple[str, int, float]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("node"), F.lit(at).alias("at"), F.lit(w).alias("weight"))
            for name, at, w in nodes
        ]
    )


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: three draws, down the levels."""
    total = lambda rack: float(sum(rack.values()))
    roots = _children(
        [(f"r{r}", r, sum(map(total, racks))) for r, racks in enumerate(tree.regions)]
    )
    racks = F.array(
        *[
            _children([(f"r{r}k{k}", k, total(rack)) for k, rack in enumerate(region)])
            for r, region in enumerate(tree.regions)
        ]
    )
    shards = F.array(
        *[
            F.array(
                *[
                    _children([(f"s{s}", s, float(w)) for s, w in sorted(rack.items())])
                    for rack in region
                ]
            )
            for region in tree.regions
        ]
    )
    region = _choose(key, roots)
    rack = _choose(key, F.get(racks, region))
    return _choose(key, F.get(F.get(shards, region), rack))


def place(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` numbers the rows of a shard in id order.
    Texts are read once and never shuffled; the numbering moves narrow rows, in ranges of a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = F.col(id_col).isNotNull()
    key = F.when(known, F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(text))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("_key"),
    )
    moved = shard_of(F.col("_key"), grown) if grown else F.lit(None).cast("int")
    placed = keyed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        shard_of(F.col("_key"), tree).alias("shard"),
        moved.alias("grown_shard"),
    )
    one = F.lit(1).cast("long")
    slots = running(stored(placed, "placed"), ["doc_id", "text_crc32", "size"], {"slot": one}, by=["shard"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
