"""Table storage protocol on parquet folders.

Writes never overwrite a folder that is being read: a changed table is written as a
new snapshot folder and the caller switches to it (``TableStore.commit``), which is
also what makes a retried batch harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.schemas import KEYS, TABLES, not_null_columns


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform_column(df: DataFrame, name: str, field: T.StructField) -> Column:
    """A declared column of ``df``; one that is missing gets its default (``hour`` -> 12, A12) or NULL."""
    if field.name in df.columns:
        return F.col(field.name).cast(field.dataType)
    return F.lit(12 if name == "fact_order" and field.name == "hour" else None).cast(field.dataType)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared columns, in their order."""
    return df.select(*[conform_column(df, name, f).alias(f.name) for f in TABLES[name].fields])


def schema_matches(df: DataFrame, name: str) -> bool:
    """Same column names and types as declared (nullability ignored)."""
    want = [(f.name, f.dataType) for f in TABLES[name].fields]
    have = [(f.name, f.dataType) for f in df.schema.fields]
    return want == have


class SchemaMismatch(Exception):
    """A stored table whose columns are not the declared ones."""


def load_checked(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The stored table with its declared schema. A missing folder reads as empty; a column of
    another type, or a missing key or NOT NULL column, is refused; other missing columns get their
    default (A12). The stored schema comes from one file's footer, not from all."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return empty_table(spark, name)
    df = spark.read.parquet(path)
    have, needed = {f.name: f.dataType for f in df.schema.fields}, {*KEYS[name], *not_null_columns(TABLES[name])}
    wrong = [f.name for f in TABLES[name].fields if (f.name in needed and f.name not in have) or have.get(f.name, f.dataType) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"{name} at {path}: {', '.join(wrong)}")
    return conform(df, name)


class TableStore:
    """The eleven tables as parquet folders under ``root`` (one current snapshot each)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _file(self, *parts: str):
        """A Hadoop path below the root and its file system (local, HDFS or an object store)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str | None:
        """The current snapshot: the one that the highest version marker names.

        A marker is a small file created once, after its snapshot is complete, so that readers
        on any file system see either the old or the new snapshot.
        """
        version = self._version(name)
        return f"{self.root.rstrip('/')}/{name}/{version:012d}" if version else None

    def _version(self, name: str) -> int:
        folder, fs = self._file(name, "_versions")
        return max((int(st.getPath().getName()) for st in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def read(self, name: str) -> DataFrame:
        """A1 + A11 + A12: declared schema; a missing table reads as empty; ``hour`` defaults to 12."""
        p = self.path(name)
        if p is None:
            return empty_table(self.spark, name)
        # the declared schema: no footer is read to infer one, and a column a file lacks is NULL
        df = self.spark.read.schema(TABLES[name]).parquet(p)
        if name == "fact_order" and "hour" in df.columns:
            df = df.withColumn("hour", F.coalesce(F.col("hour"), F.lit(12)))
        return conform(df, name)

    def commit(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write ``df`` as a new snapshot and switch the table to it.

        Snapshot folder and marker are named by the version alone: of two writers that started
        from one version, the second finds the folder or the marker there and fails.
        """
        version = self._version(name) + 1
        path = f"{self.root.rstrip('/')}/{name}/{version:012d}"
        w = conform(df, name).write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        marker, fs = self._file(name, "_versions", f"{version:012d}")
        fs.mkdirs(marker.getParent())
        fs.create(marker, False).close()
        return path

    def append(self, name: str, new: DataFrame) -> None:
        """A5: plain append (run log, quality log)."""
        p = self.path(name)
        if p is None:
            self.commit(name, new)
        else:
            conform(new, name).write.mode("append").parquet(p)

    def insert_if_absent(self, name: str, new: DataFrame, order_col: str | None = None) -> DataFrame:
        """A3 (INSERT OR IGNORE): drop rows with a NULL in a NOT NULL column, keep the first row per key
        (by ``order_col`` when given, then by content), skip keys already stored, append the rest. Returns the inserted rows."""
        key = KEYS[name]
        columns = [F.col(f.name) for f in TABLES[name].fields]
        order = [F.col(order_col)] if order_col else []
        src = new.withColumns({f.name: conform_column(new, name, f) for f in TABLES[name].fields})
        for c in not_null_columns(TABLES[name]):
            src = src.filter(F.col(c).isNotNull())
        # the least row by (order_col, content): partial aggregation collapses a hot key
        first = src.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*columns).alias("kept"))).alias("least"))
        cand = conform(first.select("least.kept.*"), name)
        p = self.path(name)
        if p is not None:
            cand = cand.join(self.read(name).select(*key), key, "left_anti")
        self.append(name, cand)
        return cand

    def upsert(self, name: str, new: DataFrame) -> None:
        """A4 (INSERT OR REPLACE): existing rows whose key is in ``new`` are replaced."""
        key = KEYS[name]
        kept = self.read(name).join(new.select(*key), key, "left_anti")
        self.commit(name, kept.unionByName(conform(new, name)))

    def delete_keys(self, name: str, keys: DataFrame) -> None:
        """Remove rows whose key is listed in ``keys``."""
        key = KEYS[name]
        self.commit(name, self.read(name).join(keys.select(*key), key, "left_anti"))

    def count(self, name: str) -> DataFrame:
        """A10: one-row COUNT(*)."""
        return self.read(name).agg(F.count(F.lit(1)).alias("rows"))


def export_csv(df: DataFrame, path: str) -> None:
    """Header row, no index; a folder of part files written by the executors."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out = out.withColumn(f.name, F.col(f.name).cast("double"))
    out.write.mode("overwrite").option("header", True).csv(path)
