"""Epoch tables: every micro-batch is one partition, and one marker publishes all of its tables.

``EpochLog`` holds the markers, ``FoldedTable`` a small mergeable state whose reading cost does
not grow with the number of epochs, ``EpochStore`` the tables of the sensor pipeline on both.
One writer commits epochs in rising order (a streaming query's epochs are that); readers take
the head once and see only epochs up to it, so a batch is visible as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.operators import partials
from coldlake.schemas import TABLES
from coldlake.sources.tables import conform, empty_table

#: Epochs between two merged snapshots of a folded table.
FOLD = 16
#: Markers of older epochs are deleted, so that finding the head lists a bounded folder.
KEPT_MARKERS = 8
SNAPSHOT = -1


class Folder:
    """A folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(*parts))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        path, fs = self.file(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def size(self, *parts: str) -> int:
        path, fs = self.file(*parts)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def delete(self, *parts: str) -> None:
        path, fs = self.file(*parts)
        fs.delete(path, True)


class EpochLog:
    """Published epochs: an empty marker file per epoch, created once all of its files are complete."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def head(self) -> int:
        """The newest published epoch; -1 before the first."""
        return max((int(n) for n in self.folder.names("_published")), default=-1)

    def publish(self, epoch: int) -> None:
        """Create the marker. A second writer of the same epoch fails here: the file is there already."""
        path, fs = self.folder.file("_published", f"{epoch:012d}")
        fs.create(path, False).close()
        for name in sorted(self.folder.names("_published"))[:-KEPT_MARKERS]:
            self.folder.delete("_published", name)


class FoldedTable:
    """Rows per epoch that ``merge`` can bring together, kept as a snapshot and the epochs since.

    Epochs share a folder ``base=b`` of at most ``fold`` epochs; the first epoch of a folder also
    writes what all earlier ones merge to. A reader merges one folder: the state's own rows and
    those of fewer than ``fold`` epochs, however long the history is. An epoch's files are
    overwritten when it is repeated, and are read only once its marker is there.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], fold: int = FOLD):
        self.spark, self.folder = spark, Folder(spark, root)
        self.schema, self.merge, self.fold = schema, merge, fold

    def base(self, epoch: int) -> int:
        return epoch // self.fold * self.fold

    def stored(self, head: int) -> DataFrame:
        """The stored rows that a reading at ``head`` merges, with their ``epoch``."""
        schema = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])
        if head < 0 or not self.folder.names(f"base={self.base(head)}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder.at(f"base={self.base(head)}")).where(F.col("epoch") <= head)

    def read(self, head: int) -> DataFrame:
        return self.merge(self.stored(head).drop("epoch"))

    def write(self, epoch: int, rows: DataFrame, head: int) -> None:
        """The rows of ``epoch``, and before them the snapshot of ``head`` if a new folder begins."""
        if 0 <= head and self.base(head) != self.base(epoch):
            self._put(self.read(head), epoch, SNAPSHOT)
        self._put(rows, epoch, epoch)

    def _put(self, rows: DataFrame, epoch: int, label: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder.at(f"base={self.base(epoch)}", f"epoch={label}"))

    def prune(self) -> None:
        """Delete folders before the previous one, which readers of the last head may still use."""
        keep = {f"base={b}" for b in sorted((int(n.split("=")[1]) for n in self.folder.names() if n.startswith("base=")))[-2:]}
        for name in self.folder.names():
            if name.startswith("base=") and name not in keep:
                self.folder.delete(name)


class EpochStore:
    """The sensor tables, one partition per epoch, with the reports' partial aggregates beside them."""

    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD):
        self.spark = spark
        self.log = EpochLog(spark, root)
        self.folder = Folder(spark, root)
        self.grains = partials.grains()
        self.folded = {name: FoldedTable(spark, f"{self.folder.root}/partials/{name}", partials.partial(empty_table(spark, g.source), g).schema,
                                         lambda df, g=g: partials.merged(df, g), fold) for name, g in self.grains.items()}

    def read(self, name: str, head: int | None = None) -> DataFrame:
        """The published rows of a table: a filter on its partition column, so nothing else is listed or read."""
        head = self.log.head() if head is None else head
        if head < 0 or not self.folder.names(name):
            return empty_table(self.spark, name)
        schema = T.StructType([*TABLES[name].fields, T.StructField("epoch", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.folder.at(name)).where(F.col("epoch") <= head).drop("epoch")

    def partial(self, name: str, head: int | None = None) -> DataFrame:
        """The merged partial aggregate of all published epochs."""
        return self.folded[name].read(self.log.head() if head is None else head)

    def count(self, name: str) -> DataFrame:
        return self.read(name).agg(F.count(F.lit(1)).alias("rows"))

    def commit(self, epoch: int, tables: dict[str, DataFrame], after: Callable[[str], None] | None = None, writers: int = 4) -> bool:
        """Write all tables and partials of ``epoch`` concurrently, then publish it; False if it is published already.

        A failure leaves files that no reader looks at: the retry overwrites them, and a later
        epoch that comes without a retry removes them first. ``after`` is told each written name.
        """
        head = self.log.head()
        if epoch <= head:
            return False
        if epoch > head + 1:
            self._forget(head, epoch, list(tables))

        def rows(name: str) -> None:
            conform(tables[name], name).write.mode("overwrite").parquet(self.folder.at(name, f"epoch={epoch}"))

        def partial(name: str) -> None:
            g = self.grains[name]
            self.folded[name].write(epoch, partials.partial(tables[g.source], g), head)

        jobs = [(n, rows) for n in tables] + [(n, partial) for n in self.grains if self.grains[n].source in tables]
        with ThreadPoolExecutor(max_workers=writers) as pool:
            def run(name: str, write: Callable[[str], None]) -> None:
                write(name)
                if after is not None:
                    after(name)
            for done in [pool.submit(run, *job) for job in jobs]:
                done.result()
        self.log.publish(epoch)
        for t in self.folded.values():
            t.prune()
        return True

    def _forget(self, head: int, epoch: int, names: list[str]) -> None:
        """Delete what epochs between the head and ``epoch`` left when they failed and did not come again."""
        for folder, parts in [(self.folder, [n]) for n in names] + [(t.folder, [b]) for t in self.folded.values() for b in t.folder.names()]:
            for name in folder.names(*parts):
                if name.startswith("epoch=") and head < int(name.split("=")[1]) < epoch:
                    folder.delete(*parts, name)


class KeyedSink:
    """Upsert target of an update-mode stream: a micro-batch brings the keys that changed, the newest version wins.

    A repeated epoch is published already and changes nothing; one that failed is overwritten.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], fold: int = FOLD):
        rest = [f.name for f in schema.fields if f.name not in keys]
        versioned = T.StructType([*schema.fields, T.StructField("version", T.LongType())])

        def newest(rows: DataFrame) -> DataFrame:
            best = rows.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("v"))
            return best.select(*[F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in (f.name for f in schema.fields)], "v.version")

        self.log = EpochLog(spark, root)
        self.table = FoldedTable(spark, f"{root.rstrip('/')}/rows", versioned, newest, fold)

    def put(self, rows: DataFrame, epoch: int) -> bool:
        head = self.log.head()
        if epoch <= head:
            return False
        self.table.write(epoch, rows.withColumn("version", F.lit(epoch).cast("long")), head)
        self.log.publish(epoch)
        self.table.prune()
        return True

    def read(self) -> DataFrame:
        return self.table.read(self.log.head()).drop("version")
