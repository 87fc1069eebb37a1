"""Sharding by a hierarchical weighted hash tree (regions, racks, shards). DataFrame functions only.

At each node every child draws -ln(u) / weight with u hashed from the key and the child's path, and the smallest
draw wins: a child wins with a chance in proportion to its weight, and raising one child's weight only moves keys
to that child. Movement is so confined to the subtrees on whose path a weight changed.

Law `key`: the key and the shard count alone decide. The first `base_shards` shards form regions of
racks_per_region * shards_per_rack shards; each later shard opens a region of its own, so growth by one shard
moves keys only into the new one.

Defined results: a null text counts as empty (size 1, crc32 0); a null key is hashed as a key of its own; repeated
rows get different slots; an empty table gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def default_tree(n_shards: int, base_shards: int = 16, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Leaf]:
    """The tree for a number of shards."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    per_region = racks_per_region * shards_per_rack
    return [
        Leaf(s, f"region{s // per_region}", f"rack{s % per_region // shards_per_rack}") if s < base_shards else Leaf(s, f"grown{s}", "rack0")
        for s in range(n_shards)
    ]


def _draw(key: Column, path: str, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(path), key), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _choose(key: Column, paths: list[tuple[str, float]], seed: int) -> Column:
    """Index of the child with the smallest draw."""
    if len(paths) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(_draw(key, p, w, seed).alias("d"), F.lit(i).alias("i")) for i, (p, w) in enumerate(paths)])).getField("i")


def _weight(leaves: list[Leaf]) -> float:
    return sum(x.weight for x in leaves)


def _split(leaves: list[Leaf], name) -> dict[str, list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for x in leaves:
        out.setdefault(name(x), []).append(x)
    return out


def place(key: Column, tree: list[Leaf], seed: int = 0) -> Column:
    """Shard of a key: descends region, rack and shard level."""
    tree = [x for x in tree if x.weight > 0]

    def level(prefix: str, leaves: list[Leaf], names: list) -> Column:
        if not names:
            return F.lit(leaves[0].shard)
        parts = _split(leaves, names[0])
        paths = [(f"{prefix}/{k}", _weight(v)) for k, v in parts.items()]
        below = [level(p, v, names[1:]) for (p, _), v in zip(paths, parts.values(), strict=True)]
        if len(below) == 1:
            return below[0]
        pick = _choose(key, paths, seed)
        # a lookup by index keeps the draw to one evaluation where the children are leaves
        if len(names) == 1:
            return F.element_at(F.array(*below), pick + 1)
        out = F.when(pick == 0, below[0])
        for i, b in enumerate(below[1:], 1):
            out = out.when(pick == i, b)
        return out

    return level("", tree, [lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)]).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tree: list[Leaf] | None = None, grown: list[Leaf] | None = None, seed: int = 0) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots are dealt in two steps, so that no shard has to meet in one task: rows are numbered within
    (shard, part) and offset by the sizes of the parts before; there are as many parts as shuffle partitions.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tree, grown = tree or default_tree(n_shards), grown or default_tree(n_shards + 1)
    key, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, tree, seed).alias("shard"),
        place(key, grown, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int").alias("part"),
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.withColumn("row", F.row_number().over(within)).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"), "grown_shard"
    )
