"""Documents that arrive as a stream, indexed in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.functions.text import blob_sha
from spanforge.operators.embed import Model, embed_files
from spanforge.operators.store import SnapshotStore, upserted


def index_stream(files: DataFrame, store: SnapshotStore, model: Model, checkpoint: str) -> StreamingQuery:
    """Every batch of (path, content) becomes a snapshot; the last content of a path wins.

    A batch that is run again gives the same rows under the same paths; one that
    brings nothing new writes no snapshot.
    """

    def batch(df: DataFrame, _: int) -> None:
        placed = df.select("path", "content", F.monotonically_increasing_id().alias("at"))
        latest = placed.groupBy("path").agg(F.max_by("content", "at").alias("content")).withColumn("blob_sha", blob_sha(F.col("content")))
        old = store.read()
        if old is not None:
            same = old.select("path", "blob_sha").distinct()
            latest = latest.join(same, ["path", "blob_sha"], "left_anti")
            if latest.isEmpty():
                return
        fresh = embed_files(latest, model)
        store.write(fresh if old is None else upserted(old, fresh, latest))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
