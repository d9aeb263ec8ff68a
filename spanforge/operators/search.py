"""Cosine k-nearest-neighbour search and what is shown of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import cosine
from spanforge.operators.batches import slices

DEFAULT_K = 5
#: Queries, and vectors, whose scores are held together: 8 MB of them.
TILE = 1024


def top_k(vectors: DataFrame, query: list[float], k: int = DEFAULT_K, ties: tuple[str, ...] = ("path", "ord"), column: str = "embedding") -> DataFrame:
    """The k rows nearest to one query; zero vectors have no score and come last.

    One pass with a heap per task; rows are joined with texts after this, not before.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", cosine(F.col(column), literal)).drop(column)
    return scored.orderBy(F.desc_nulls_last("score"), *ties).limit(k)


def merge_models(parts: list[DataFrame], k: int, ties: tuple[str, ...]) -> DataFrame:
    """Hits of several models by score; all of them if k is not positive."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.orderBy(F.desc_nulls_last("score"), *ties)
    return out.limit(k) if k > 0 else out


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal width as doubles; a null vector is one of zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all() and not vectors.null_count:
        return flat.reshape(len(sizes), width)
    if set(np.unique(sizes[vectors.is_valid().to_numpy(zero_copy_only=False)])) - {width}:
        raise ValueError("vectors of different widths")
    out = np.zeros((len(sizes), width))
    out[vectors.is_valid().to_numpy(zero_copy_only=False)] = flat.reshape(-1, width)
    return out


def _keep_best(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Puts the scores of a tile (queries by vectors) into each query's best ones, ties by id."""
    k = best_s.shape[1]
    least, last = best_s[:, -1:], best_i[:, -1:]
    if s.shape[1] > k and (least == -np.inf).any():
        # nothing below the tile's own k-th best can stay
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]])
    hit = (s > least) | ((s == least) & ((s > best_s[:, -1:]) | (ids < last)))
    row, col = np.nonzero(hit & (s > -np.inf))
    if not len(row):
        return
    touched = np.unique(row)
    row = np.concatenate((row, np.repeat(touched, k)))
    both_s, both_i = np.concatenate((s[row[: len(col)], col], best_s[touched].ravel())), np.concatenate((ids[col], best_i[touched].ravel()))
    order = np.lexsort((both_i, -both_s, row))
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    keep = rank < k
    best_s[row[keep], rank[keep]], best_i[row[keep], rank[keep]] = both_s[order[keep]], both_i[order[keep]]


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score) of the k nearest for every query, in blocks of queries.

    A block of queries goes to every task, which multiplies it by its vectors in tiles
    of at most ``TILE`` queries and vectors and keeps its own k best; only those are
    shuffled. More queries mean more blocks. All pairs are compared: time grows with the
    number of queries times that of vectors, memory does not.
    """
    rows = queries.select(F.col(id_col).alias("q"), F.col(column).alias("v")).orderBy("q").toLocalIterator()
    parts, block = [], []

    def searched(block: list) -> DataFrame:
        ids = np.array([r["q"] for r in block])
        m = np.array([r["v"] for r in block], float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, m / np.where(norm > 0, norm, np.nan)))

        def run(batches):
            qid, unit = shared.value
            best_s, best_i = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
            for b in slices(batches, TILE):
                v, ids = matrix(b.column(1)), b.column(0).to_numpy()
                n = np.linalg.norm(v, axis=1)
                v = v / np.where(n > 0, n, np.nan)[:, None]
                for low in range(0, len(qid), TILE):
                    s = np.round(unit[low : low + TILE] @ v.T, 9)
                    _keep_best(best_s[low : low + TILE], best_i[low : low + TILE], np.where(np.isnan(s), -np.inf, s), ids)
            found = best_s > -np.inf
            for low in range(0, len(qid), TILE):
                held = found[low : low + TILE]
                cols = [pa.array(np.repeat(qid[low : low + TILE], held.sum(axis=1))), pa.array(best_i[low : low + TILE][held]), pa.array(best_s[low : low + TILE][held])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "id", "score"])

        return vectors.select(F.col(id_col).cast("long"), column).mapInArrow(run, "query_id long, id long, score double")

    for r in rows:
        block.append(r)
        if len(block) == most_queries:
            parts.append(searched(block))
            block = []
    if block or not parts:
        parts.append(searched(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.where(F.col("score") > float("-inf")).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
