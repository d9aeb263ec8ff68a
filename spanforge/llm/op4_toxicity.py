"""Toxicity categories by a chain of linear classifiers.

Method: features are the presence of words and of their 5 to 8 byte beginnings,
hashed; the most telling ones (chi-square on the labelled sample) enter logistic
models, one per category in a fixed order. Each later model also reads the
probabilities of the earlier ones, which in training are out-of-fold predictions.

Categories: the table labels ``toxic`` alone. Before it the chain predicts ``kinds`` kinds
of toxic text that the labelled rows themselves show: kind k is a row labelled toxic
that lies on the upper side of the k-th principal axis of the toxic rows' features. So
no word list decides, and the kinds are named by their axis (``kind_1``, ...).

Fitting uses at most about ``per_class`` labelled rows of each class, chosen by a
hash of doc_id. Scoring is one pass over all rows and whole texts, without a shuffle.

Edge cases: null and empty texts have no features and get the chain's base rates;
null labels are ignored; rows labelled twice count as toxic if any label says so;
without both classes every probability is the share of toxic labels (0 if none);
repeated rows are scored alike; an empty table gives no rows; long texts are read
whole; a probability equal to the threshold is toxic. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fit_logistic, hash_fraction_sample, sigmoid, slices, table, texts_of

BUCKETS = 1 << 18
FOLDS = 5
CACHE_WORDS = 1 << 20
#: ASCII capitals become small; other ASCII but letters and digits becomes a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


@dataclass(frozen=True)
class ChainModel:
    names: tuple[str, ...]
    chosen: np.ndarray  # feature ids, sorted
    weights: tuple[np.ndarray, ...]  # per category: features, earlier probabilities, bias


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def word_features(word: bytes) -> list[int]:
    return [crc32(word) & (BUCKETS - 1)] + [crc32(word[:k], 1) & (BUCKETS - 1) for k in range(5, 9) if len(word) > k]


def _features(batches):
    for b in slices(batches):
        ids = [np.unique([f for w in words_of(text) for f in word_features(w)]).astype("<u4").tobytes() for text in texts_of(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["doc_id", "label", "x"])


def kinds_of(x: np.ndarray, label: np.ndarray, kinds: int) -> np.ndarray:
    """One column per kind: toxic rows on the upper side of a principal axis of theirs."""
    out, on = np.zeros((len(x), kinds)), np.flatnonzero(label == 1)
    if not len(on) or not x.shape[1]:
        return out
    centred = (x[on] - x[on].mean(0)).astype(float)
    # of rows, as they are bounded; the side of an axis on which its largest entry lies is the upper one
    axes = np.linalg.eigh(centred @ centred.T)[1][:, ::-1][:, :kinds]
    for k in range(axes.shape[1]):
        side = axes[:, k] * np.sign(axes[np.argmax(np.abs(axes[:, k])), k])
        out[on, k] = side > 1e-9
    return out


def _chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights per category; earlier categories enter as out-of-fold probabilities."""
    models, before = [], np.zeros((len(x), 0), np.float32)
    for c in range(y.shape[1]):
        z = np.hstack((x, before))
        models.append(fit_logistic(z, y[:, c], l2=2e-5, steps=200, weight=weight))
        p = np.empty((len(x), 1), np.float32)
        for f in range(FOLDS):
            w = fit_logistic(z[fold != f], y[fold != f, c], l2=2e-5, steps=100, weight=weight[fold != f]) if (fold != f).any() else models[-1]
            p[fold == f, 0] = sigmoid(z[fold == f] @ w[:-1] + w[-1])
        before = np.hstack((before, p))
    return tuple(models)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, features: int = 2000, kinds: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ChainModel:
    names = (*(f"kind_{k + 1}" for k in range(kinds)), label_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(share) < 2:
        base = 30.0 if share.get(1) else -30.0
        return ChainModel(names, np.zeros(0, np.int64), tuple(np.append(np.zeros(i), base) for i in range(len(names))))
    sample = hash_fraction_sample(known.where("label = 1"), F.col("doc_id"), per_class).union(hash_fraction_sample(known.where("label = 0"), F.col("doc_id"), 2 * per_class))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # bounded: at most about 3 * per_class pairs of an id and a label
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(_features, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not rows:
        return ChainModel(names, np.zeros(0, np.int64), tuple(np.append(np.zeros(i), -30.0) for i in range(len(names))))
    label = np.array([r["label"] for r in rows], float)
    ids = [np.frombuffer(r["x"], "<u4") for r in rows]
    on = np.bincount(np.concatenate([i for i, t in zip(ids, label, strict=True) if t] or [np.zeros(0, np.uint32)]), minlength=BUCKETS).astype(float)
    off = np.bincount(np.concatenate([i for i, t in zip(ids, label, strict=True) if not t] or [np.zeros(0, np.uint32)]), minlength=BUCKETS).astype(float)
    n1, n0 = max(label.sum(), 1), max((1 - label).sum(), 1)
    both = on + off
    chi = np.where(both >= 4, (on / n1 - off / n0) * np.abs(on / n1 - off / n0) / np.maximum(both * (n1 + n0 - both), 1) * 1e9, 0)
    chosen = np.sort(np.argsort(-np.abs(chi), kind="stable")[:features])
    chosen = chosen[chi[chosen] != 0]
    x = np.stack([np.isin(chosen, i) for i in ids]).astype(np.float32)
    y = np.column_stack([kinds_of(x, label, kinds), label])
    weight = np.where(label == 1, share[1] / n1, share[0] / n0)
    fold = np.array([crc32(str(r["doc_id"]).encode()) // 4 % FOLDS for r in rows])
    return ChainModel(names, chosen, _chain(x, y, weight, fold))


def score(docs: DataFrame, model: ChainModel, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one probability per category, and ``toxic`` of the last category."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` weights a category
    cols = [f"p_{n}" for n in model.names]

    def run(batches):
        m = shared.value
        at = {int(f): i for i, f in enumerate(m.chosen)}
        known: dict[bytes, tuple[int, ...] | None] = {}
        for b in slices(batches):
            out = np.empty((b.num_rows, len(m.names)))
            for i, text in enumerate(texts_of(b)):
                hit = set()
                for w in words_of(text):
                    if w not in known:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[w] = tuple(at[f] for f in word_features(w) if f in at) or None
                    if found := known[w]:
                        hit.update(found)
                idx, p = sorted(hit), []
                for w in m.weights:
                    n = len(m.chosen)
                    p.append(float(sigmoid(w[idx].sum() + np.dot(w[n:-1], p) + w[-1])))
                out[i] = p
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, k]) for k in range(out.shape[1])]], ["doc_id", *cols])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = picked.mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in cols))
    return scored.withColumn("toxic", F.col(cols[-1]) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
