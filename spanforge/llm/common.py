"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.batches import bound_batches, slices  # noqa: F401

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a folder is made if driver and executors are one
    process (tests); a cluster without one is refused, as its machines share no folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: list[str] = []


def materialize(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    ``sweep`` leaves what is ``lasting``.
    """
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/spanforge/{uuid.uuid4().hex}"
    if not lasting:
        _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame of ``materialize`` that nothing reads any more."""
    if df.written_path in _written:
        _written.remove(df.written_path)
    _delete(df.sparkSession, df.written_path)


@contextmanager
def sweep(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote within and was not discarded."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(spark, path)
            _written.remove(path)


def split_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; remainder 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(split_of(doc_id) == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def hash_fraction_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most about ``n`` rows, chosen by a hash of ``key`` (never by position)."""
    total = df.count()
    if total > n:
        cut = int(2**31 * (n / total))
        df = df.where(F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(2**31)) < cut)
    return df


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400, rate: float = 0.05, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) of a logistic regression, by full-batch Adam from zero."""
    n, d = x.shape
    x, y = np.ascontiguousarray(x, np.float32), np.asarray(y, np.float32)
    w, m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    sample = np.ones(n, np.float32) if weight is None else np.asarray(weight, np.float32)
    sample = sample / sample.sum()
    for t in range(1, steps + 1):
        err = (sigmoid(x @ w[:-1] + w[-1]) - y) * sample
        g = np.append(err @ x + np.float32(l2) * w[:-1], err.sum())
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * v + np.float32(0.001) * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def _roots(up: DataFrame) -> DataFrame:
    """(node, label): the end of each node's path in ``up`` (node, label), which is deleted."""
    while True:
        high = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = materialize(up.join(high, "label").select("node", F.col("top").alias("label"), F.col("label").alias("old")))
        discard(up)
        up = jumped
        if not up.where("label <> old").limit(1).count():
            return up


def connected_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the undirected edge list (a, b).

    Label = smallest node of the component. A round hooks every node to its smallest
    neighbour, follows these hooks to their ends, and replaces the edges by those
    between different ends: an edge inside a found part is read once, not again in each
    round. What is written goes to the shared folder, so neither lineage nor driver
    memory grows. Stops when no edge is left; ``max_rounds`` only guards against a defect.
    """

    def distinct(a: str, b: str, of: DataFrame) -> DataFrame:
        return materialize(of.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())

    rest, labels = distinct("a", "b", edges), None
    for _ in range(max_rounds):
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        up = _roots(materialize(ends.groupBy("node").agg(F.least(F.min("other"), "node").alias("label"))))
        left = rest.join(up.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        left = distinct("x", "y", left)
        discard(rest)
        rest = left
        if labels is None:
            labels = up
        else:
            top = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            grown = materialize(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
            discard(labels)
            discard(up)
            labels = grown
        if not rest.limit(1).count():
            discard(rest)
            out = labels.select("node", "label")
            out.written_path = labels.written_path
            return out
    raise RuntimeError("labels did not settle")
