"""Order lines stored by month and key bucket, so that a change rewrites only the partitions it touches.

A change set is resolved to partitions and to places in files through the key column alone; the
rows of those partitions are read, those at the places dropped by bitmaps of their files, and all
put back with Spark's dynamic partition overwrite, which keeps the old files until all new ones
are written. Whole rows are never shuffled: a task writes a file per partition it has rows of.
Partitions that lose all their rows are deleted, and all others keep their files. Every change
is idempotent by key, so a change set that fails half-way is simply applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.schemas import FACT_ORDER
from coldlake.sources.epochs import Folder
from coldlake.sources.tables import conform

KEY = "order_line_id"
PARTS = ["order_month", "bucket"]
PLACE = ["_file", "_at"]
#: Rows of a file that one bitmap marks, and the most bytes of bitmaps that are broadcast; more are joined.
CHUNK = 32_768
MOST_BYTES = 256 << 20
#: Stored bytes that a task of a rewrite takes, and about those of a row.
TASK_BYTES, ROW_BYTES = 64 << 20, 64


class OrderStore:
    """fact_order below ``root``, partitioned by order month and a hash bucket of the key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, Folder(spark, root), buckets

    def bucket(self, key: str = KEY) -> Column:
        return (F.conv(F.substring(F.sha2(F.col(key), 256), 1, 4), 16, 10).cast("int") % self.buckets).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return conform(rows, "fact_order").withColumns({"order_month": F.date_format("order_date", "yyyy-MM"), "bucket": self.bucket()})

    def _stored(self) -> DataFrame:
        schema = T.StructType([*FACT_ORDER.fields, T.StructField("order_month", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not self.folder.names("lines"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder.at("lines"))

    def read(self) -> DataFrame:
        return self._stored().drop(*PARTS)

    def months(self, since: str) -> DataFrame:
        """The lines of ``since`` ('yyyy-MM') and later months; other partitions are not listed."""
        return self._stored().where(F.col("order_month") >= since).drop(*PARTS)

    def files(self) -> DataFrame:
        """Rows (order_month, bucket, file): what the table's partitions consist of."""
        return self._stored().select(*PARTS, F.col("_metadata.file_name").alias("file")).distinct()

    def _lines(self) -> DataFrame:
        """The stored rows with their place: ``_file``, a hash of its path, and ``_at``, the row's number in it."""
        if not self.folder.names("lines"):
            return self._stored().withColumns({"_file": F.lit(0).cast("long"), "_at": F.lit(0).cast("long")})
        return self._stored().select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    def _write(self, placed: DataFrame) -> None:
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PARTS).parquet(self.folder.at("lines"))

    def load(self, rows: DataFrame) -> None:
        """Put rows into an empty store."""
        if self.folder.names("lines"):
            raise ValueError(f"{self.folder.root} holds order lines already")
        self._write(self._placed(rows))

    def work(self) -> str:
        """A new folder for the tables of one change; ``rewrite`` deletes it."""
        return f"work-{uuid.uuid4().hex}"

    def kept(self, work: str, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` as a table of the change."""
        path = self.folder.at(work, name)
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def find(self, work: str, name: str, keys: DataFrame, *columns: str) -> DataFrame:
        """Places (month, bucket, file, row number) of the stored rows with ``keys`` (unique), and ``columns`` of the keys."""
        return self.kept(work, name, self._lines().select(KEY, *PARTS, *PLACE).join(keys, KEY).select(*PARTS, *PLACE, *columns))

    def marked(self, work: str, rows: DataFrame, places: DataFrame, flag: str) -> DataFrame:
        """``rows`` with the boolean ``flag``: whether they lie at one of ``places``.

        The places are a bitmap per file and 32,768 rows, an eighth of a byte per stored row, and so are broadcast up to ``MOST_BYTES``.
        """
        chunk, bit = F.floor(F.col("_at") / CHUNK).alias("_chunk"), F.pmod("_at", F.lit(CHUNK))
        spots = places.select("_file", chunk, bit.alias("_bit")).repartition("_file", "_chunk")
        maps = self.kept(work, f"map{flag}", spots.groupBy("_file", "_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
        if maps.count() * CHUNK // 8 <= MOST_BYTES:
            maps = F.broadcast(maps)
        byte = F.conv(F.hex(F.expr(f"substring(_bits, int(pmod(_at, {CHUNK}) div 8) + 1, 1)")), 16, 10).cast("int")
        there = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
        return rows.withColumn("_chunk", chunk).join(maps, ["_file", "_chunk"], "left").withColumn(flag, there).drop("_chunk", "_bits")

    def rewrite(self, work: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the partitions ``touched`` (order_month, bucket) by ``change`` of their rows.

        ``change`` gets the rows of these partitions with their places, and gives all of their rows
        after it. The touched partitions are at most all partitions of the table, a bounded list.
        """
        touched = self.kept(work, "touched", touched.groupBy(*PARTS).agg(F.count("*").alias("n"))).toDF("_month", "_bucket", "_n")
        same = F.col("order_month").eqNullSafe(F.col("_month")) & (F.col("bucket") == F.col("_bucket"))
        found = touched.collect()
        places = [("lines", f"order_month={p['_month'] or '__HIVE_DEFAULT_PARTITION__'}", f"bucket={p['_bucket']}") for p in found]
        old = {p: set(self.folder.names(*p)) for p in places}
        rows = self._placed(change(self._lines().join(F.broadcast(touched), same, "left_semi").drop(*PARTS)))
        # every task writes a file per partition it has rows of: no more tasks than the bytes need
        size = sum(self.folder.size(*p) for p in places) + sum(p["_n"] for p in found) * ROW_BYTES
        self._write(rows.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
        for p in places:
            # a partition that got rows has other files now
            if old[p] & set(self.folder.names(*p)):
                self.folder.delete(*p)
        self.folder.delete(work)

    def places_of(self, rows: DataFrame) -> DataFrame:
        """The partitions (order_month, bucket) of ``rows`` (key, order_date)."""
        return rows.select(F.date_format("order_date", "yyyy-MM").alias("order_month"), self.bucket().alias("bucket"))

    def upsert(self, new: DataFrame) -> None:
        """A4: a stored line whose key is in ``new`` (unique by key) is replaced, whatever its month; other new lines are added."""
        work = self.work()
        gone = self.find(work, "gone", new.select(KEY).distinct())
        touched = gone.select(*PARTS).unionByName(self.places_of(new))
        self.rewrite(work, touched, lambda rows: self.without(work, rows, gone).unionByName(conform(new, "fact_order")))

    def without(self, work: str, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """The lines among ``rows`` that lie at none of the places ``gone``."""
        return conform(self.marked(work, rows, gone, "_gone").where("not _gone"), "fact_order")

    def cancel(self, keys: DataFrame) -> None:
        """The lines with these keys go."""
        work = self.work()
        gone = self.find(work, "gone", keys.select(KEY).distinct())
        self.rewrite(work, gone, lambda rows: self.without(work, rows, gone))

    def purge_before(self, cutoff: str) -> None:
        """Lines before the date ``cutoff`` ('yyyy-MM-dd') go: whole months by deleting their
        folders, the cutoff's own month by a rewrite."""
        for name in self.folder.names("lines"):
            month = name.partition("=")[2]
            if name.startswith("order_month=") and month < cutoff[:7] and month[:1].isdigit():
                self.folder.delete("lines", name)
        old = self._stored().where((F.col("order_month") == cutoff[:7]) & (F.col("order_date") < F.to_date(F.lit(cutoff))))
        if not old.isEmpty():
            keep = F.col("order_date").isNull() | (F.col("order_date") >= F.to_date(F.lit(cutoff)))
            self.rewrite(self.work(), old, lambda rows: rows.where(keep))
