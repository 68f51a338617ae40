"""Helpers that the training-data operators share: staged tables, components, text bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.session import checkpoint_dir, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Lineage ends at files every executor can read, later plans see real sizes, and a lost
    executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark) or ensure_checkpoint_dir(spark)}/coldlake-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._coldlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    path = getattr(df, "_coldlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of finished steps' shuffle files: Spark deletes them when the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def utf8(c: Column) -> Column:
    """The text as bytes for Arrow; null is empty."""
    return F.coalesce(c, F.lit("")).cast("binary")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` as rows (node, component = least node).

    Alternating large-star and small-star rounds: every round only groups and joins edges, so
    no component, however large, is gathered anywhere. Minima are staged tables, so both join
    sides are plain scans and AQE can split the partition of a hub node. Nodes without an edge
    are not returned; null ends are ignored. Raises if ``max_rounds`` do not suffice (each
    round at least halves path lengths, so 60 cover any graph that fits on disk).
    """
    cur = staged(
        edges.select(_max(a, b).alias("u"), _min(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = _digest(cur)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", _min("u", "m").alias("m")), "low")
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = staged(large, "large")
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (large.join(low2, "u").select(_max("v", "m").alias("u"), _min("v", "m").alias("v"))
                 .where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = staged(small, "edges")
        new = _digest(nxt)
        for old in (cur, low, large, low2):
            discard(old)
        cur, done, state = nxt, new == state, new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _min(a: str, b: str) -> Column:
    return F.when(F.col(a) <= F.col(b), F.col(a)).otherwise(F.col(b))


def _max(a: str, b: str) -> Column:
    return F.when(F.col(a) <= F.col(b), F.col(b)).otherwise(F.col(a))


def _digest(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """``df`` with ``pos``: each row's place from 0 within its ``group`` by ``order``, staged.

    Rows are range-partitioned on (group, order) and numbered where they lie, so a group of any
    size is dealt over all partitions; what a group has in earlier partitions is one row per
    partition and group. Group columns must not be null. Rows that tie in all of ``order`` are
    numbered among each other in any order. ``discard()`` of the result deletes its table.
    """
    from pyspark.sql import Window as W

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    rows = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name)
    held = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select(*group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    out = rows.join(starts, [*group, "_part"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")
    out._coldlake_path = rows._coldlake_path
    return out
