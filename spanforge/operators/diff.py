"""What a run must do: tree against index, costs, gate, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import price_per_token, tokens

FORMAT_VERSION = 10


class CostGateError(RuntimeError):
    """The projected cost exceeds the cap; nothing was written."""


def touched(tree: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status): new, modified or deleted. ``tree`` holds candidates only."""
    t, i = tree.select("path", F.col("blob_sha").alias("t_sha")), indexed.select("path", F.col("blob_sha").alias("i_sha"))
    status = F.when(F.col("i_sha").isNull(), "new").when(F.col("t_sha").isNull(), "deleted").when(F.col("t_sha") != F.col("i_sha"), "modified")
    return t.join(i, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def action_plan(tree: DataFrame, indexed: DataFrame, version: int = FORMAT_VERSION) -> DataFrame:
    """(path, action) for all paths: embed, skip, delete; an old version is embedded anew."""
    t = tree.select("path", F.col("blob_sha").alias("t_sha"))
    i = indexed.select("path", F.col("blob_sha").alias("i_sha"), "version")
    same = (F.col("t_sha") == F.col("i_sha")) & (F.col("version") == version)
    return t.join(i, "path", "full_outer").select("path", F.when(F.col("t_sha").isNull(), "delete").when(same, "skip").otherwise("embed").alias("action"))


def deletions(tree: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.join(tree, "path", "left_anti").select("path")


def estimate(files: DataFrame, model: str) -> DataFrame:
    """One row: files, chunks (one per file), tokens and dollars of files with content."""
    agg = files.agg(F.count("*").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum(tokens(F.col("content"))), F.lit(0)).cast("long").alias("embed_tokens"))
    return agg.withColumn("dollars", F.col("embed_tokens") * F.lit(price_per_token(model)))


def gate(cost: DataFrame, cap: float) -> None:
    """Raises if the one-row estimate exceeds a positive cap."""
    dollars = cost.first()["dollars"]
    if 0 < cap < dollars:
        raise CostGateError(f"max reindex cost: ${dollars:.6g} exceeds ${cap:.6g}")


def sync_actions(artifacts: DataFrame, cached: DataFrame, active: list[str]) -> DataFrame:
    """(path, action) that bring the cache up to the artifacts of active models."""
    a = artifacts.where(F.col("model").isin(active)).select("path", "model", F.col("blob_sha").alias("a_sha"))
    c = cached.select("path", "model", F.col("blob_sha").alias("c_sha"))
    act = F.when(F.col("a_sha").isNull(), "evict").when(F.col("c_sha").isNull() | (F.col("a_sha") != F.col("c_sha")), "upsert").otherwise("keep")
    return a.join(c, ["path", "model"], "full_outer").select("path", "model", act.alias("action"))


def health_issues(expected: DataFrame, indexed: DataFrame, marker_files: int, marker_chunks: int, version: int = FORMAT_VERSION) -> DataFrame:
    """(path, msg), sorted: files and counts that disagree with the tree and the marker."""
    e, i = expected.select("path", F.col("blob_sha").alias("e_sha")), indexed.select("path", F.col("blob_sha").alias("i_sha"), "version")
    msg = (
        F.when(F.col("i_sha").isNull(), "expected file is missing from the index")
        .when(F.col("e_sha").isNull(), "indexed file is not expected")
        .when(F.col("e_sha") != F.col("i_sha"), "stale blob")
        .when(F.col("version") != version, "stale format version")
    )
    per_file = e.join(i, "path", "full_outer").select("path", msg.alias("msg")).where("msg is not null")
    n = indexed.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"))
    counts = n.select(F.lit("").alias("path"), F.explode(F.array(F.when(F.col("files") != marker_files, "file count differs from the marker"), F.when(F.col("n_chunks") != marker_chunks, "chunk count differs from the marker"))).alias("msg")).where("msg is not null")
    return per_file.unionByName(counts).orderBy("path", "msg")
