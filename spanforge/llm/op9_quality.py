"""Quality score from compression with zstandard dictionaries.

Method: one dictionary is built from labelled good text, one from bad text. A
document is cut into chunks of at most ``CHUNK`` bytes that together are the whole
text; the summed compressed sizes under both dictionaries give the normalised
difference (bad size - good size) / bytes. A logistic curve over it and over the log
of the mean compressed share (which text of one repeated word drives to the floor
under either dictionary) makes the score; it is fitted on labelled rows that built
no dictionary.

Fitting uses at most about ``per_class`` labelled rows of each class (chosen by a
hash of doc_id), whose whole texts are read. The half that builds the dictionaries
goes to the driver as chunks, of a text over ``DOC_BYTES`` as what a dictionary of the
whole text keeps; the other half's sizes are taken by tasks. So the driver holds at most
``per_class`` times ``DOC_BYTES`` bytes. Scoring is one pass over all rows without a
shuffle.

Edge cases: null and empty texts have both terms 0 and get the curve's value there;
null labels are ignored; rows labelled twice count as bad if any label is bad; a
training set with one class, or none, scores every row with its share of good
labels (0.5 if none); repeated rows are scored alike; an empty table gives no rows;
texts of any length are read whole; scores of 0.7 are predicted 1. Only the named
columns are read by ``fit`` and ``score``; ``keep_good`` passes all columns on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fit_logistic, hash_fraction_sample, held_out, sigmoid, slices, split_of, table, texts_of

CHUNK = 2048
#: Bytes of a text that reach the driver as they are; longer ones are condensed by parts of ``PART_BYTES``.
DOC_BYTES, PART_BYTES = 1 << 16, 1 << 22
DICT_BYTES = 112 << 10
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    curve: tuple[float, float, float]  # difference, log share, intercept


def chunks_of(text: bytes) -> list[bytes]:
    """Near-equal chunks that join to the whole text."""
    n = -(-len(text) // CHUNK)
    cuts = [len(text) * i // n for i in range(n + 1)] if n else [0]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def condensed(parts: list[bytes]) -> list[bytes]:
    """Chunks of at most ``DOC_BYTES`` that dictionaries of the whole text keep, if it is longer."""
    while sum(map(len, parts)) > DOC_BYTES:
        step, kept = PART_BYTES // CHUNK, []
        for low in range(0, len(parts), step):
            group = parts[low : low + step]
            size = min(DOC_BYTES, sum(map(len, group)) // 2)
            kept += chunks_of(_dictionary(group, size)[-size:])
        parts = kept
    return parts


def _samples(batches):
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([condensed(chunks_of(t)) for t in texts_of(b)], pa.list_(pa.binary()))], ["doc_id", "label", "parts"])


def _sizes(shared):
    def run(batches):
        good, bad = shared.value
        for b in slices(batches):
            x = size_features(texts_of(b), good, bad)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "label", "difference", "share"])

    return run


def _dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; the plain text itself where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
    d = zstandard.ZstdCompressionDict(content)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def size_features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Normalised size difference and log compressed share; zeros for empty texts."""
    out = np.zeros((len(texts), 2))
    if good and bad:
        g, b = _compressor(good).compress, _compressor(bad).compress
        for i, text in enumerate(texts):
            if text:
                parts = chunks_of(text)
                with_good, with_bad = sum(len(g(c)) for c in parts), sum(len(b(c)) for c in parts)
                out[i] = (with_bad - with_good) / len(text), np.log((with_bad + with_good) / (2 * len(text)))
    return out


def scores_of(texts: list[bytes], model: QualityModel) -> np.ndarray:
    return sigmoid(size_features(texts, model.good, model.bad) @ np.array(model.curve[:2]) + model.curve[2])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Dictionaries and curve from labelled rows outside the held-out quarter."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(split_of(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(share.values())
    if len(share) < 2:
        return QualityModel(b"", b"", (0.0, 0.0, 6.0 if share.get(1) else (-6.0 if total else 0.0)))
    sample = hash_fraction_sample(known.where("label = 0"), F.col("doc_id"), per_class).union(hash_fraction_sample(known.where("label = 1"), F.col("doc_id"), per_class))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # bounded: at most about 2 * per_class pairs of an id and a label
    rows = texts.join(F.broadcast(sample.withColumn("half", F.expr("(doc_id div 8) % 2"))), "doc_id")

    def of_half(c: int, h: int, run, schema: str) -> list:
        return rows.where((F.col("label") == c) & (F.col("half") == h)).select("doc_id", "label", "text").mapInArrow(run, f"doc_id long, label int, {schema}").collect()

    built, told = {}, {}
    for c in (0, 1):
        for told[c] in (1, 0):  # the half that tells sizes is not the one that builds, unless one is empty
            found = sorted((r["doc_id"], [bytes(p) for p in r["parts"]]) for r in of_half(c, 1 - told[c], _samples, "parts array<binary>"))
            parts = [p for _, doc in found for p in doc if p]
            if parts:
                break
        built[c] = _dictionary(parts) if parts else b""
    if not built[0] or not built[1]:
        return QualityModel(b"", b"", (0.0, 0.0, float(np.log(share[1] / share[0]))))
    shared = docs.sparkSession.sparkContext.broadcast((built[1], built[0]))
    test = []
    for c in (0, 1):
        here = of_half(c, told[c], _sizes(shared), "difference double, share double")
        test += here or of_half(c, 1 - told[c], _sizes(shared), "difference double, share double")
    shared.destroy()
    test.sort(key=lambda r: (r["doc_id"], r["label"], r["difference"], r["share"]))
    x = np.array([(r["difference"], r["share"]) for r in test]) * np.array([20, 1])
    y = np.array([r["label"] for r in test], float)
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    w = fit_logistic(x, y, weight=weight, steps=3000)
    return QualityModel(built[1], built[0], (float(w[0] * 20), float(w[1]), float(w[2])))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches):
        m = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores_of(texts_of(b), m))], ["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = picked.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and with all columns, whose predicted label is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(scores_of(texts, m) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
