"""Hierarchical weighted hash tree: documents descend region, rack and shard levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import staged

#: Numbering buckets per shard. Offsets need shards x SLOT_BUCKETS rows, a fixed bound.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class ShardTree:
    """Leaves with weights, in racks of ``rack_size`` and regions of ``region_racks`` racks.

    Shard i sits in rack i // rack_size and that rack in region rack // region_racks. A weight
    of zero takes no rows. With full regions, one more shard opens a region of its own, so
    only the root sees a changed weight and rows move only into the new shard.
    """

    weights: tuple[float, ...]
    rack_size: int = 2
    region_racks: int = 2

    @classmethod
    def uniform(cls, shards: int, **kw) -> ShardTree:
        return cls((1.0,) * shards, **kw)

    def _levels(self) -> list[tuple[int, list[float]]]:
        racks = _sums(self.weights, self.rack_size)
        regions = _sums(racks, self.region_racks)
        return [(len(regions), regions), (self.region_racks, racks), (self.rack_size, list(self.weights))]

    def place(self, key: Column) -> Column:
        """The shard of a string key: at each level the child with the least -ln(u) / weight."""
        at = F.lit(0)
        for level, (fan, weights) in enumerate(self._levels()):
            padded = weights + [0.0] * fan
            table = F.array(*[F.lit(float(w)) for w in padded])
            draws = []
            for k in range(fan):
                child = at * fan + k
                h = F.xxhash64(F.concat(key, F.lit(f"/{level}/"), child.cast("string")))
                u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)
                w = F.element_at(table, (child + 1).cast("int"))
                cost = F.when(w > 0, -F.log(u) / F.greatest(w, F.lit(1e-300)))
                draws.append(F.struct(F.coalesce(cost, F.lit(float("inf"))).alias("cost"), child.alias("child")))
            at = (F.array_min(F.array(*draws)) if fan > 1 else draws[0])["child"]
        return at.cast("int")


def _sums(weights, size: int) -> list[float]:
    return [float(sum(weights[i:i + size])) for i in range(0, len(weights), size)]


def assign_shards(docs: DataFrame, tree: ShardTree, grown: ShardTree | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot[, grown_shard]), one per input row.

    ``shard`` depends on the id and the tree alone; ``slot`` numbers a shard's rows without
    gaps: rows are numbered inside (shard, hash bucket) windows, and bucket totals, at most
    shards x 1024 rows, give the offsets. Null ids share the key '' (one shard); null text has
    size 1 and checksum 0; repeated rows get the same shard and slots of their own; other
    columns are ignored; an empty table gives no rows. ``grown_shard`` is the place under
    ``grown`` (null without it).
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"),
                        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = keyed.select("doc_id", "size", "text_crc32", tree.place(F.col("key")).alias("shard"),
                          (grown.place(F.col("key")) if grown else F.lit(None).cast("int")).alias("grown_shard"),
                          F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"))
    placed = staged(placed, "placed")
    from pyspark.sql import Window as W
    totals = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(
        W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    numbered = placed.withColumn("within", within)
    return (numbered.join(F.broadcast(before), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard"))
