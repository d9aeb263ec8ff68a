"""Benchmark decontamination by a prefix-filtered set join.

Method: every benchmark item is cut into windows of ``size`` consecutive words (an
item with fewer words is one window). As the join asks for whole containment, the
necessary prefix of a window is one token: its rarest word, by the number of times
the corpus holds the window words. Documents emit the places of prefix words only;
they are joined with the windows on the word, bounded by position and length (the
window must lie inside the document), and verified word by word.

What reaches every task is one bitmap of fixed size (``1 << SLOT_BITS`` bytes) over
hashed words, whatever the size of the benchmark; a false hit in it costs a
candidate that the join then drops. Windows are broadcast only if there are at
most ``broadcast_windows``; more are joined by shuffle, where adaptive execution
splits hot words. Candidates of one document are at most ``size`` per word.

Edge cases: null and wordless texts have no words, hits or items; null and wordless
items have no window; an item with a null id counts for hits but has no id to
report; equal items are reported each; repeated documents give repeated rows; empty
tables give no rows, or rows without hits; of equally rare words the first by code
points is the prefix; long texts are read whole. Only the named columns, and ``key``,
which is passed on, are read.
"""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, slices, table, texts_of

SIZE = 10
SLOT_BITS = 22
_MASK = (1 << SLOT_BITS) - 1
#: Capitals become small; ASCII that is neither a letter nor a digit becomes a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): the distinct windows of every item."""
    words = F.expr(f"filter(split(translate(`{text_col}`, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w <> '')")
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item_id"), words.alias("w"))
        .where("size(w) > 0")
        .select("item_id", F.explode(F.expr(f"case when size(w) <= {size} then array(w) else transform(sequence(1, size(w) - {size - 1}), i -> slice(w, i, {size})) end")).alias("words"))
        .distinct()
    )


def _bitmap(words: DataFrame) -> bytes:
    """One byte per slot of a hashed word; at most ``1 << SLOT_BITS`` slots reach the driver."""
    slots = words.select(F.crc32(F.col("word").cast("binary")).bitwiseAND(_MASK).cast("int").alias("slot")).distinct()
    bits = bytearray(1 << SLOT_BITS)
    for (slot,) in slots.toLocalIterator():
        bits[slot] = 1
    return bytes(bits)


def _counter(bits):
    def run(batches):
        seen, counts = bits.value, {}
        for b in slices(batches):
            for text in texts_of(b):
                for w in words_of(text):
                    if seen[crc32(w) & _MASK]:
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts = {}
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def corpus_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often the whole corpus holds each of the given words."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(words))
    found = texts.select("text").mapInArrow(_counter(bits), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixed_windows(texts: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_words: int = 200_000, **names) -> DataFrame:
    """(item_id, words, prefix, at): windows with their rarest word and its place."""
    windows = materialize(item_windows(benchmark, size, **names))
    vocabulary = materialize(windows.select(F.explode("words").alias("word")).distinct())
    counts = materialize(corpus_counts(texts, vocabulary))
    if vocabulary.count() <= broadcast_words:
        counts = F.broadcast(counts)
    each = windows.select("item_id", "words", F.posexplode("words").alias("at", "word")).join(counts, "word")
    rarest = each.groupBy("item_id", "words").agg(F.min(F.struct("n", "word", "at")).alias("low"))
    return materialize(rarest.select("item_id", "words", F.col("low.word").alias("prefix"), F.col("low.at").cast("int").alias("at")))


def _candidates(bits, size):
    reach = size - 1

    def run(batches):
        seen = bits.value
        for b in slices(batches):
            n_words, found = [], []
            for text in texts_of(b):
                words = words_of(text)
                hits = [i for i, w in enumerate(words) if seen[crc32(w) & _MASK]]
                n_words.append(len(words))
                found.append([{"word": words[i].decode(), "pos": i, "low": max(0, i - reach), "near": [w.decode() for w in words[max(0, i - reach) : i + reach + 1]]} for i in hits])
            kind = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.int32()), ("low", pa.int32()), ("near", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(found, kind), b.column(3)], ["row", "doc_id", "n_words", "found", "key"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, key; one row per document."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("binary").alias("key"))
    windows = prefixed_windows(texts, benchmark, size, **names)
    bits = spark.sparkContext.broadcast(_bitmap(windows.select(F.col("prefix").alias("word"))))
    schema = "row long, doc_id long, n_words long, found array<struct<word string, pos int, low int, near array<string>>>, key binary"
    rows = texts.mapInArrow(_candidates(bits, size), schema).select("row", "doc_id", "n_words", "key", F.explode_outer("found").alias("f"))
    # rows without a candidate get a key of their own, so that no null key gathers them
    rows = rows.select("row", "doc_id", "n_words", "key", F.coalesce("f.word", F.concat(F.lit(" "), F.col("row").cast("string"))).alias("prefix"), "f.pos", "f.low", "f.near")
    side = F.broadcast(windows) if windows.count() <= broadcast_windows else windows
    joined = rows.join(side, "prefix", "left").withColumn("start", F.col("pos") - F.col("at"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("n_words")) & (F.expr("slice(near, start - low + 1, size(words))") == F.col("words"))
    span = F.when(fits, F.struct("start", (F.col("start") + F.size("words")).alias("stop")))
    # within one document: spans are at most its length, items are those that occur in it
    grouped = joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("key").alias("key"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set(F.when(fits, F.col("item_id")))).alias("items")
    )
    hit = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (a, s) -> struct(a.n + greatest(0, s.stop - greatest(s.start, a.upto)) as n, greatest(a.upto, s.stop) as upto), a -> a.n)")
    return grouped.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans", "key"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE [w[i:i+9] FOR i IN range(1, len(w) - 8)] END) AS g FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM x),
p AS (SELECT doc_id, k, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g, unnest(range(1, len(w) - k + 2)) AS i FROM d, s WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM p JOIN x ON p.k = x.k AND p.g = x.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
