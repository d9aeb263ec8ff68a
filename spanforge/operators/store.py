"""Versioned Parquet snapshots in place of a database.

``<root>/v=N`` holds one snapshot, partitioned by model; ``<root>/CURRENT`` names it
and is replaced last, so a run that fails leaves the old snapshot in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of untouched paths and the fresh rows."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_orphans(rows: DataFrame, active: list[str]) -> DataFrame:
    """Rows of active models."""
    return rows.where(F.col("model").isin(active))


def orphans(rows: DataFrame, active: list[str]) -> DataFrame:
    return rows.where(~F.col("model").isin(active))


def stats(files: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
    """(model, n_files, n_chunks) at a version; files without chunks count."""
    f = files.where(F.col("version") == version)
    n = chunks.groupBy("path", "model").agg(F.count("*").alias("n"))
    return f.join(n, ["path", "model"], "left").groupBy("model").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chunks"))


def reuse_map(chunks: DataFrame) -> DataFrame:
    """(path, heading, text, embedding): the last chunk of each heading and text."""
    return chunks.groupBy("path", "heading", "text").agg(F.max_by("embedding", "ord").alias("embedding"), F.max("ord").alias("ord"))


class SnapshotStore:
    """Reads and writes snapshots through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return 0
        return int(self.spark.read.text(str(p)).first()[0])

    def read(self) -> DataFrame | None:
        n = self.current()
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/v={n}") if n else None

    def write(self, rows: DataFrame) -> int:
        """A new snapshot; it is in force once CURRENT is renamed into place."""
        n = self.current() + 1
        rows.repartition("path").write.mode("overwrite").partitionBy("model", "version").parquet(f"{self.root}/v={n}")
        fs, temp = self._fs(f"{self.root}/.CURRENT.{n}")
        out = fs.create(temp, True)
        out.write(bytearray(str(n).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/CURRENT")
        # one rename that replaces: CURRENT is never missing once it was there
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temp, final, how)
        return n

    def vacuum(self, keep: int = 1) -> None:
        """Delete snapshots older than the last ``keep``."""
        now = self.current()
        for n in range(1, now - keep + 1):
            fs, p = self._fs(f"{self.root}/v={n}")
            if fs.exists(p):
                fs.delete(p, True)
