"""Quality rules whose cutoffs come from the data.

Method: every document gets integer metrics; per (lang, source, metric) a
fixed-resolution quantile sketch (counts of integer bins) of the documents that pass
the base rule is summed. Such a sketch merges by addition, so partial sums are formed
before the shuffle, one hot source costs no more than its bins, and the sketches of a
language and of the whole corpus are sums of those of the sources. A stratum's cutoff
of a metric is the bin that all but one in ``TAIL`` of its documents reach at most (at
least, for lower cutoffs), drawn towards the cutoff of its language, and that towards
the whole corpus's, as if ``PRIOR`` documents had it; nothing is added to it. Documents
are then filtered by a join with the cutoffs.

Edge cases: a null or blank text has no words, fails the base rule and is not
kept; null lang or source is a stratum of its own; small strata have cutoffs near
those of their language; a document in the bin of a cutoff is kept; repeated rows count
as often as they occur and each gets its verdict; an empty table gives no rows. Only
the named input columns are read, so further columns cannot clash; a long text is
counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, slices, table, texts_of

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: One in this many documents of a stratum lies beyond a cutoff of its own.
TAIL = 100
#: Documents with which the cutoff of the wider stratum counts.
PRIOR = 200
#: metric -> integer bin by the counts; those with a lower cutoff.
METRICS = {
    "symbols_permille": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines_permille": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_permille": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length_tenths": "10 * word_chars div greatest(n_words, 1)",
}
LOWER = ("word_length_tenths",)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0)
    solid = text.translate(None, SPACE)
    chars = len(solid) - int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    repeats = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        g = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            twice = np.zeros(n, bool)
            at = np.concatenate((order[1:][same], order[:-1][same]))
            for k in range(3):
                twice[at + k] = True
            repeats = int(twice.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _count_batches(batches):
    for b in slices(batches):
        rows = np.array([text_counts(x) for x in texts_of(b)], np.int64).reshape(-1, len(_COUNTS))
        cols = [b.column(i) for i in range(3)] + [pa.array(rows[:, k]) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *_COUNTS])


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts per document, in the order and partitions of the input."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_count_batches, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def quantile_sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): mergeable by summing n."""
    pairs = ", ".join(f"'{m}', {e}" for m, e in METRICS.items())
    return (
        counts.where(f"not ({BASE_FAILED})")
        .select("lang", "source", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, bin)"))
        .groupBy("lang", "source", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def sketch_tails(sketch: DataFrame, keys: list[str], tail: int = TAIL) -> DataFrame:
    """hi, lo and total per keys and metric: the bins that all but 1 / tail stay within."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return run.groupBy(*keys, "metric").agg(
        F.min(F.expr(f"case when {tail} * upto >= {tail - 1} * total then bin end")).alias("hi"),
        F.min(F.expr(f"case when {tail} * upto >= total then bin end")).alias("lo"),
        F.max("total").alias("total"),
    )


def cutoffs(counts: DataFrame, tail: int = TAIL, prior: int = PRIOR) -> DataFrame:
    """(lang, source, metric, hi, lo) of every stratum that has documents past the base rule."""
    sketch = materialize(quantile_sketch(counts))
    whole = sketch_tails(sketch, [], tail).select("metric", F.col("hi").alias("hi_w"), F.col("lo").alias("lo_w"))
    lang = sketch_tails(sketch, ["lang"], tail)
    drawn = lambda q, n, wide: F.expr(f"({n} * {q} + {prior} * {wide}) div ({n} + {prior})")
    # a few rows per language
    lang = lang.join(whole, "metric").select(F.col("lang").alias("lang_l"), F.col("metric").alias("metric_l"), drawn("hi", "total", "hi_w").alias("hi_l"), drawn("lo", "total", "lo_w").alias("lo_l"))
    own = sketch_tails(sketch, ["lang", "source"], tail)
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("metric") == F.col("metric_l")))
    return both.select("lang", "source", "metric", drawn("hi", "total", "hi_l").alias("hi"), drawn("lo", "total", "lo_l").alias("lo"))


def adaptive_rules(docs: DataFrame, tail: int = TAIL, prior: int = PRIOR) -> DataFrame:
    """Counts, base verdict and the verdict of the joined adaptive cutoffs."""
    counts = materialize(document_counts(docs))
    limits = {f"hi_{m}": (m, "hi") for m in METRICS} | {f"lo_{m}": (m, "lo") for m in LOWER}
    each = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(name) for name, (m, side) in limits.items()]
    own = materialize(cutoffs(counts, tail, prior).groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*each))
    joined = counts.join(own, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    fits = F.lit(True)
    for name, (m, side) in limits.items():
        fits = fits & (F.expr(METRICS[m]) <= F.col(name) if side == "hi" else F.expr(METRICS[m]) >= F.col(name))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & F.coalesce(fits, F.lit(True))).alias("kept"), "lang", "source",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
g AS (
  SELECT row_id, unnest([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] FOR i IN range(1, len(ws) - 1)]) AS g,
         unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
h AS (SELECT row_id, i FROM g QUALIFY count(*) OVER (PARTITION BY row_id, g) > 1),
r AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, i + o AS p FROM h, (VALUES (0), (1), (2)) v(o)) GROUP BY row_id),
c AS (
  SELECT w.row_id, w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN r ON r.row_id = w.row_id),
m AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS m1, 1000 * n_dup_lines // greatest(n_lines, 1) AS m2,
         1000 * n_repeat_words // greatest(n_words, 1) AS m3, 10 * word_chars // greatest(n_words, 1) AS m4 FROM c),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
l AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([m1, m2, m3, m4]) AS b FROM f WHERE NOT base_failed),
o1 AS (SELECT lang, source, k, b, sum(count(*)) OVER (PARTITION BY lang, source, k ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, k) AS n FROM l GROUP BY lang, source, k, b),
o AS (SELECT lang, source, k, max(n)::BIGINT AS n, min(b) FILTER (100 * upto >= 99 * n) AS hi, min(b) FILTER (100 * upto >= n) AS lo FROM o1 GROUP BY lang, source, k),
g1 AS (SELECT lang, k, b, sum(count(*)) OVER (PARTITION BY lang, k ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY lang, k) AS n FROM l GROUP BY lang, k, b),
g2 AS (SELECT lang, k, max(n)::BIGINT AS n, min(b) FILTER (100 * upto >= 99 * n) AS hi, min(b) FILTER (100 * upto >= n) AS lo FROM g1 GROUP BY lang, k),
a1 AS (SELECT k, b, sum(count(*)) OVER (PARTITION BY k ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY k) AS n FROM l GROUP BY k, b),
a AS (SELECT k, min(b) FILTER (100 * upto >= 99 * n) AS hi, min(b) FILTER (100 * upto >= n) AS lo FROM a1 GROUP BY k),
e AS (SELECT g2.lang, g2.k, (g2.n * g2.hi + 200 * a.hi) // (g2.n + 200) AS hi, (g2.n * g2.lo + 200 * a.lo) // (g2.n + 200) AS lo FROM g2 JOIN a ON a.k = g2.k),
cut AS (SELECT o.lang, o.source, o.k, (o.n * o.hi + 200 * e.hi) // (o.n + 200) AS hi, (o.n * o.lo + 200 * e.lo) // (o.n + 200) AS lo FROM o JOIN e ON e.k = o.k AND e.lang IS NOT DISTINCT FROM o.lang),
v AS (
  SELECT x.row_id, bool_and(b <= cut.hi AND (x.k < 4 OR b >= cut.lo)) AS fits
  FROM (SELECT row_id, lang, source, unnest([1, 2, 3, 4]) AS k, unnest([m1, m2, m3, m4]) AS b FROM f) x
  LEFT JOIN cut ON cut.k = x.k AND cut.lang IS NOT DISTINCT FROM x.lang AND cut.source IS NOT DISTINCT FROM x.source GROUP BY x.row_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(v.fits, true) AS kept
FROM f JOIN v ON v.row_id = f.row_id
"""
