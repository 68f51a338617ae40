"""Relational building blocks shared by the report operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attach_scalars(base: DataFrame, *one_row_frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates (with distinct column names) into one row - one job, no join.

    The frames are stacked with ``unionByName`` (missing columns NULL) and folded with
    ``max``; each column is non-NULL in exactly one input row. Every branch scans for itself
    unless its pruned plan equals another's.
    """
    frames = [base, *one_row_frames]
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows by ``order`` (planned as TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def last_k_ascending(df: DataFrame, k: int, ts: str, tiebreak: list[str]) -> DataFrame:
    """The newest k rows, returned oldest first."""
    newest = top_k(df, k, F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak])
    return newest.orderBy(F.col(ts).asc(), *[F.col(c).asc() for c in tiebreak])


def stat(c: Column, digits: int = 6) -> Column:
    """Presentation rounding (half-even) of an unrounded floating-point statistic."""
    return F.bround(c.cast("double"), digits)


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str, partitions: int | None = None,
               total: str | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order`` without a global (single-task) window.

    1. range-partition on the order keys (balanced, contiguous ranges) and sort within partitions;
    2. checkpoint to the shared checkpoint folder, so the ranges are fixed for both uses below;
    3. per-partition totals -> exclusive offsets (one row per partition: a proven size bound,
       hence broadcast);
    4. running sum inside each partition plus its offset; ``total`` names a column for the whole sum.
    """
    from coldlake.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_t"))
    whole = [F.sum("_t").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(total)] if total else []
    offsets = totals.select("_pid", F.coalesce(
        F.sum("_t").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"), *whole)
    running = F.sum(value).over(W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, running + F.col("_off")).drop("_pid", "_off"))
