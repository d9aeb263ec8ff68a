from spanforge.operators.embed import MockModel
from spanforge.operators.store import SnapshotStore
from spanforge.streaming.incremental import index_stream


def test_stream_becomes_snapshots(spark, tmp_path):
    store, schema, place = SnapshotStore(spark, f"file://{tmp_path}/s"), "path string, content string", f"{tmp_path}/in"
    for text in ("alpha\n\nbeta", "gamma", "gamma"):
        spark.createDataFrame([("a.md", text), ("b.md", "same")], schema).coalesce(1).write.mode("append").parquet(place)
        index_stream(spark.readStream.schema(schema).parquet(place), store, MockModel(8), f"{tmp_path}/c").awaitTermination()
    rows = store.read()
    assert sorted((r["path"], r["ord"], r["end"]) for r in rows.collect()) == [("a.md", 0, 5), ("b.md", 0, 4)]
    assert store.current() == 2
