"""Language identification by error-correcting output codes.

Method: every language gets a codeword of bits; one linear classifier per bit reads
hashed byte bigrams and trigrams; decoding sums a weighted logistic loss of each
codeword against all bits (weights: the training accuracy of the bit) and takes the
least. ``ambiguous`` marks rows whose two nearest codewords are close.

Codewords: exhaustive codes up to six languages, above that ``15 * log2`` random
bits, drawn with a fixed seed to keep codewords far apart.

Fitting uses at most about ``per_lang`` rows per language and, where there are many
languages, ``max_langs_rows`` rows in all (20 of each at least), chosen by a hash of
doc_id. Scoring is one pass over all rows and whole texts, without a shuffle.

Edge cases: null texts and texts without a letter are ``und`` with score 0; null
lang is not learned from; with no labelled row all are ``und``, with one language
all rows with a letter get it; equally near codewords go to the first language by
name; repeated rows agree; an empty table gives no rows; long texts are read whole.
Only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import held_out, slices, split_of, table, texts_of

BITS = 13
LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: ASCII capitals become small, all other ASCII but letters becomes a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_MIX2, _MIX3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    code: np.ndarray  # langs x bits, -1 or 1
    weights: np.ndarray  # 2**BITS x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding


def gram_ids(text: bytes) -> np.ndarray:
    """Hashed ids of all byte bigrams and trigrams of the folded text."""
    a = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = (a[:-1] << 8) | a[1:]
    three = (two[:-1] << 8) | a[2:]
    return np.concatenate((two * _MIX2 >> np.uint32(32 - BITS), three * _MIX3 >> np.uint32(32 - BITS))).astype(np.int32)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(LETTER.search(text.decode("utf-8", "replace")))


def codewords(n: int) -> np.ndarray:
    """n distinct codewords as rows of -1 and 1; every column splits the languages."""
    if n <= 6:
        width = 2 ** (n - 1) - 1
        cols = [[1] + [1 if (c >> (n - 2 - r)) & 1 else -1 for r in range(n - 1)] for c in range(width)]
        return np.array(cols, np.int8).T.reshape(n, width)
    rng, best, apart = np.random.default_rng(5), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, int(15 * np.log2(n))))
        m = m[:, np.abs(m.sum(0)) < n]
        d = (m[:, None, :] != m[None, :, :]).sum(2) + np.eye(n, dtype=int) * m.shape[1]
        if d.min() > apart:
            best, apart = m, d.min()
    return best


def _features(batches):
    for b in slices(batches, 64):
        packed = []
        for text in texts_of(b):
            g = gram_ids(text)
            packed.append((np.bincount(g, minlength=1 << BITS) * (1000.0 / len(g))).astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "x"])


def fit(docs: DataFrame, per_lang: int = 400, max_langs_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows with text and lang outside the held-out quarter."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(split_of(F.col("doc_id")) != 2, F.lit(False)))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = tuple(sorted(counts))
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0))
    each = max(20, min(per_lang, max_langs_rows // len(langs)))
    cut = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(int(2**31 * min(1.0, each / n))))])
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(2**31)) < cut[F.col("lang")])
    rows = sorted(picked.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in rows]).astype(np.float32)
    y = code[[langs.index(r["lang"]) for r in rows]].astype(np.float32)
    share = np.array([counts[r["lang"]] for r in rows], np.float32)
    per = np.bincount([langs.index(r["lang"]) for r in rows], minlength=len(langs))
    sample = 1.0 / np.array([per[langs.index(r["lang"])] for r in rows], np.float32) if len(share) else share
    sample /= sample.sum()
    d, k = x.shape[1], y.shape[1]
    w, m, v = np.zeros((d + 1, k), np.float32), np.zeros((d + 1, k), np.float32), np.zeros((d + 1, k), np.float32)
    for t in range(1, 201):
        margin = np.clip(y * (x @ w[:d] + w[d]), -30, 30)
        err = -y / (1 + np.exp(margin)) * sample[:, None]
        g = np.vstack((x.T @ err + 1e-5 * w[:d], err.sum(0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    right = ((x @ w[:d] + w[d]) * y > 0).mean(0)
    return LanguageModel(langs, code, (w[:d] * 1000).astype(np.float32), w[d].astype(float), np.maximum(right - 0.5, 0.01) * 2)


def decode(f: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share of exp(-loss), and the lead over the next."""
    loss = (np.logaddexp(0, -model.code[None, :, :] * f[:, None, :]) * model.trust).sum(2)
    e = np.exp(loss.min(1, keepdims=True) - loss)
    p = e / e.sum(1, keepdims=True)
    two = np.sort(p, 1)[:, ::-1]
    return loss.argmin(1), two[:, 0], two[:, 0] - (two[:, 1] if p.shape[1] > 1 else 0)


def bit_values(text: bytes, model: LanguageModel) -> np.ndarray:
    g = gram_ids(text)
    if len(g) > 1 << BITS:
        return np.bincount(g, minlength=1 << BITS).astype(np.float32) @ model.weights / len(g) + model.bias
    return model.weights[g].sum(0) / len(g) + model.bias


def identify(docs: DataFrame, model: LanguageModel, ambiguous_lead: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x bits floats

    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts = texts_of(b)
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
            if len(m.langs) == 1:
                for i in rows:
                    lang[i], score[i], unsure[i] = m.langs[0], 1.0, False
            elif rows:
                best, p, lead = decode(np.stack([bit_values(texts[i], m) for i in rows]), m)
                for i, k in zip(rows, best, strict=True):
                    lang[i] = m.langs[k]
                score[rows], unsure[rows] = p, lead < ambiguous_lead
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = picked.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
