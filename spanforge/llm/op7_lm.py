"""Language-model scores by masked pseudo-likelihood.

Method: a small bidirectional window network, trained in numpy, predicts every token
from the two tokens on either side: log p(token) = log p(class | window) +
log p(token | class). Summed over all tokens of the whole text this scores a document.

Words are counted as they are over the whole corpus, in a table that grows with the
vocabulary; p(token | class) comes from these counts. The commonest ``HEAD`` words
go to every task, the commonest ``OWN`` of them are classes of their own, and all
others share hashed classes. Rarer words are scored as unseen first and corrected by
a join with the table of counts.

The network starts from windows of at most about ``train_docs`` distinct texts,
``DOC_WINDOWS`` evenly spaced windows each. From there every task trains it on all
windows of all its rows, and the tasks' networks are averaged by their windows. The
average depends slightly on how the rows are dealt to tasks.

What reaches the driver is the head of the table and the network, both of fixed size;
counts and rare words stay in the shared folder.

Edge cases: null and wordless texts have no tokens, score 0 and mean 0; repeated
rows agree but for rounding; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, slices, table, texts_of

#: Words that every task knows; the others are joined.
HEAD = 1 << 17
#: Classes: OWN words of their own, hashed ones, and the last for places outside the text.
OWN, CLASSES = 64, 128
OUTSIDE = CLASSES - 1
WIDTH, HIDDEN = 2, 16
OFFSETS = [o for o in range(-WIDTH, WIDTH + 1) if o]
DOC_WINDOWS = 256
STEP = 4096
#: Distinct words a task counts before it hands them on.
COUNT_WORDS = 1 << 18
#: Parameters are averaged as whole multiples of 1 / GRID, so their sums are exact.
GRID = 1 << 16
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


class Head(dict):
    """Word -> number of the commonest words; any other word gets -1 - class and is noted."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return -1 - (OWN + crc32(word) % (OUTSIDE - OWN))

    def __reduce__(self):
        return Head, (list(self),)


@dataclass(frozen=True)
class WindowModel:
    head: Head
    class_of: np.ndarray  # word of the head -> class
    log_share: np.ndarray  # word of the head -> log p(word | class)
    log_unseen: np.ndarray  # class -> log p(a word without a count | class)
    counts: DataFrame | None  # word, n: the whole vocabulary; not sent to tasks
    tables: np.ndarray  # offsets x classes x hidden
    hidden_bias: np.ndarray
    out: np.ndarray  # hidden x classes
    out_bias: np.ndarray


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _counts(batches):
    seen = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for b in slices(batches):
        for text in texts_of(b):
            seen.update(words_of(text))
            if len(seen) > COUNT_WORDS:
                yield rows()
                seen.clear()
    yield rows()


def _classes(text: bytes, head: Head, class_of: np.ndarray) -> np.ndarray:
    """Classes of the words of a text, with places outside on either side."""
    words = words_of(text)
    at = np.fromiter(map(head.__getitem__, words), np.int32, len(words))
    head.rare.clear()
    out = np.full(len(words) + 2 * WIDTH, OUTSIDE, np.int64)
    out[WIDTH : len(out) - WIDTH] = _class(at, class_of)
    return out


def _class(at: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    return np.where(at < 0, -1 - at, class_of[np.maximum(at, 0)]) if len(class_of) else -1 - at


def _around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + k] for k in range(2 * WIDTH + 1)], 1)


def _hidden(context: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    h = np.repeat(bias[None, :], len(context), 0)
    for k in range(len(OFFSETS)):
        h += tables[k][context[:, k]]
    return np.tanh(h, out=h)


def start(target: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Tables, hidden bias, output weights and output bias before training."""
    rng = np.random.default_rng(seed)
    prior = np.log(np.bincount(target, minlength=CLASSES) + 1.0)
    p = [rng.normal(0, 0.1, (len(OFFSETS), CLASSES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, CLASSES)), prior - np.log(np.exp(prior - prior.max()).sum()) - prior.max()]
    return [x.astype(np.float32) for x in p]


class Adam:
    """Training of a network, batch by batch."""

    def __init__(self, p: list[np.ndarray], rate: float):
        self.p, self.rate, self.t = [x.copy() for x in p], rate, 0
        self.m, self.v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def step(self, windows: np.ndarray) -> None:
        p, y = self.p, windows[:, WIDTH]
        c = windows[:, [WIDTH + o for o in OFFSETS]]
        h = _hidden(c, p[0], p[1])
        z = h @ p[2] + p[3]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        dh = (z @ p[2].T) * (1 - h * h)
        tables = np.empty_like(p[0])
        for k in range(len(OFFSETS)):
            cell = (c[:, k, None] * HIDDEN + np.arange(HIDDEN)).ravel()
            tables[k] = np.bincount(cell, dh.ravel(), CLASSES * HIDDEN).reshape(CLASSES, HIDDEN)
        self.t += 1
        for i, g in enumerate((tables, dh.sum(0), h.T @ z, z.sum(0))):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            p[i] = (p[i] - self.rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def train(windows: np.ndarray, epochs: int = 3, batch: int = 1024, rate: float = 0.01, seed: int = 11) -> list[np.ndarray]:
    rng, net = np.random.default_rng(seed), Adam(start(windows[:, WIDTH], seed), rate)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            net.step(windows[order[at : at + batch]])
    return net.p


def train_in_tasks(texts: DataFrame, head: Head, class_of: np.ndarray, p: list[np.ndarray], batch: int = 1024, rate: float = 0.003) -> tuple[list[np.ndarray], int]:
    """The network trained on all windows of all rows, and the number of windows."""
    shared = texts.sparkSession.sparkContext.broadcast((head, class_of, p))

    def run(batches):
        head, class_of, p = shared.value
        net, seen = Adam(p, rate), 0
        for b in slices(batches):
            # the windows of a slice are mixed, so that no step sees one text only
            ids = np.concatenate([np.zeros(0, np.int64), *[_classes(t, head, class_of) for t in texts_of(b)]])
            at = np.flatnonzero(ids != OUTSIDE)
            np.random.default_rng(len(at)).shuffle(at)
            for i in range(0, len(at), batch):
                net.step(_around(ids, at[i : i + batch] - WIDTH))
            seen += len(at)
        if seen:
            flat = np.rint(np.concatenate([x.ravel() for x in net.p]).astype(np.float64) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.append(seen, flat * seen))], ["at", "sum"])

    total = {r["at"]: r["sum"] for r in texts.mapInArrow(run, "at int, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).collect()}  # one row a parameter
    shared.destroy()
    seen = total.pop(-1, 0)
    if not seen:
        return p, 0
    flat = np.array([total[i] for i in range(len(total))]) / (seen * GRID)
    parts = np.split(flat, np.cumsum([x.size for x in p])[:-1])
    return [x.reshape(y.shape).astype(np.float32) for x, y in zip(parts, p)], seen


def fit(docs: DataFrame, train_docs: int = 1500, text_col: str = "text") -> WindowModel:
    texts = docs.select(F.col(text_col).alias("text"))
    counts = materialize(texts.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = Head([bytes(r["word"]) for r in top])
    class_of = np.array([i if i < OWN else OWN + crc32(w) % (OUTSIDE - OWN) for i, w in enumerate(head)], np.int64)
    # sums of the smoothed counts by class, with room for one unseen word
    hashed = counts.groupBy((F.crc32("word") % (OUTSIDE - OWN)).cast("int").alias("c")).agg(F.sum(F.col("n") + 0.5).alias("s")).collect()
    mass = np.full(CLASSES, 0.5)
    for r in hashed:
        mass[OWN + r["c"]] += r["s"]
    n = np.array([r["n"] for r in top], float) + 0.5
    for i, w in enumerate(list(head)[:OWN]):
        mass[i] = n[i]
        mass[OWN + crc32(w) % (OUTSIDE - OWN)] -= n[i]
    total = texts.count()
    cut = int(2**31 * min(1.0, train_docs / max(total, 1)))
    picked = texts.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("train")), F.lit(2**31)) < cut).distinct()
    shared = docs.sparkSession.sparkContext.broadcast((head, class_of))

    def windows(batches):
        for b in slices(batches):
            out = []
            for text in texts_of(b):
                ids = _classes(text, *shared.value)
                m = len(ids) - 2 * WIDTH
                at = np.unique(np.linspace(0, m - 1, min(m, DOC_WINDOWS)).astype(int)) if m else np.zeros(0, int)
                out.append(_around(ids, at).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["windows"])

    rows = sorted(bytes(r["windows"]) for r in picked.mapInArrow(windows, "windows binary").collect())
    shared.destroy()
    p = train(np.frombuffer(b"".join(rows), np.int32).reshape(-1, 2 * WIDTH + 1))
    p, _ = train_in_tasks(texts, head, class_of, p)
    return WindowModel(head, class_of, np.log(n / mass[class_of]), np.log(0.5 / mass), counts, *p)


def log_likelihoods(texts: list[bytes], model: WindowModel, rare: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and summed conditional log-probabilities of whole texts.

    Words outside the head count as unseen; ``rare`` receives those of each text.
    """
    ids = []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(model.head.__getitem__, words), np.int64, len(words)))
        if rare is not None:
            rare.append(Counter(model.head.rare))
        model.head.rare.clear()
    n = np.array([len(x) for x in ids])
    edge = np.full(WIDTH, -1 - OUTSIDE, np.int64)
    flat = np.concatenate([edge, *[y for x in ids for y in (x, edge)]])
    cls = _class(flat, model.class_of)
    at = np.flatnonzero(cls != OUTSIDE)
    logp = np.empty(len(at))
    for i in range(0, len(at), STEP):
        here = at[i : i + STEP]
        z = _hidden(np.stack([cls[here + o] for o in OFFSETS], 1), model.tables, model.hidden_bias) @ model.out
        z += model.out_bias
        y = z[np.arange(len(here)), cls[here]]
        top = z.max()
        np.exp(np.subtract(z, top, out=z), out=z)
        word = flat[here]
        share = np.where(word < 0, model.log_unseen[cls[here]], model.log_share[np.maximum(word, 0)]) if len(model.log_share) else model.log_unseen[cls[here]]
        logp[i : i + STEP] = y - top - np.log(z.sum(1)) + share
    ends = np.cumsum(n)
    run = np.concatenate(([0.0], np.cumsum(logp)))
    return n, run[ends] - run[ends - n]


def score(docs: DataFrame, model: WindowModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and its mean per token."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None))  # fixed size

    def run(batches):
        m, row = shared.value, TaskContext.get().partitionId() << 40
        for b in slices(batches, 64):
            rare: list[Counter] = []
            n, total = log_likelihoods(texts_of(b), m, rare)
            words = pa.array([list(c) for c in rare], pa.list_(pa.binary()))
            times = pa.array([list(c.values()) for c in rare], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), b.column(0), pa.array(n), pa.array(total), words, times], ["row", "doc_id", "n_tokens", "total", "words", "times"])
            row += len(n)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # written once: the numbers of the rows hold for both sides of the join
    seen = materialize(picked.mapInArrow(run, "row long, doc_id long, n_tokens long, total double, words array<binary>, times array<long>"))
    rare = seen.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("tf"))
    # from log(0.5) for an unseen word to log(n + 0.5); sums of integers agree for equal texts
    gain = F.round(F.col("tf") * F.log(2 * F.col("n") + 1) * 2**20).cast("long")
    more = rare.join(model.counts, "word").groupBy("row").agg((F.sum(gain) / 2**20).alias("more"))
    full = seen.select("row", "doc_id", "n_tokens", "total").join(more, "row", "left")
    value = F.col("total") + F.coalesce("more", F.lit(0.0))
    return full.select("doc_id", "n_tokens", value.alias("pseudo_log_likelihood"), (value / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
