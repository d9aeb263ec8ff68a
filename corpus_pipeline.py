"""From documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep
the columns of documents. ``run`` writes every stage to the shared folder and reads
it back, so a lost executor costs the work of one stage at most; what a stage wrote for
itself is deleted once its result is written.

Decisions on documents act on their texts, not only on their ids, which may be null or
repeated. Every stage gives an empty table for an empty one, and passes all columns of
its input on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import op1_decontaminate, op2_pii, op5_jaccard, op8_packing, op9_quality
from spanforge.llm.common import discard, materialize, sweep, table

#: Most rows (of an id and a digest) that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of words that a worker remembers in packing, besides an executor that has grown in the stages before.
CACHE_BYTES = 64 << 20


def digest(docs: DataFrame) -> Column:
    """Digest of a text, by which its row is known besides its id."""
    return F.unhex(F.md5(docs["text"]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text's digest, and id if ``gone`` has one, is not in ``gone``."""
    by_id = "doc_id" in gone.columns
    gone = materialize(gone.select(F.col("key").alias("gone_key"), *([F.col("doc_id").alias("gone_id")] if by_id else [])).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    # columns by frame: those of ``docs`` may have any names
    same = digest(docs) == side["gone_key"]
    return docs.join(side, same & docs["doc_id"].eqNullSafe(side["gone_id"]) if by_id else same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have the classifier's score of an empty text, and go if that is
    under 0.7; long texts are scored whole; equal rows fare alike; without labels of both
    classes all fare alike, and all go if there is no label at all.
    """
    return op9_quality.keep_good(docs, op9_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: the smallest id's (nulls last, then by digest).

    Rows of one id with different texts are told apart; equal rows are one group. Rows
    with null, empty or wordless texts link with nothing and all stay; long texts are
    compared whole.
    """
    rows = materialize(op5_jaccard.components(docs, key=digest(docs)).where("label is not null").select("doc_id", "key", "label"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    # per label, id and digest first, so that a large group is one row
    first = rows.groupBy("label").agg(F.min(order).alias("first")).select(F.col("label").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
    judged = rows.join(first, F.col("label") == F.col("of"))
    kept = without(docs, judged.where("not (doc_id <=> first_id and key = first_key)").select("doc_id", "key"))
    # equal rows of the first id and text
    twice = materialize(rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, (digest(kept) == twice["key"]) & kept["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi")
    return without(kept, twice).unionByName(again.dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null, empty and wordless texts hold none and stay; long texts are searched whole;
    a contaminated text goes from all rows, whatever their ids; a benchmark without
    words leaves all.
    """
    found = op1_decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), key=digest(docs))
    return without(docs, found.where("contaminated").select("key"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for entities; n_chars follows the text.

    Null and empty texts stay as they are, with n_chars null and 0; equal rows stay
    equal; long texts are treated whole.
    """
    out = op2_pii.replace_pii(docs, op2_pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences.

    Null and empty texts are one end id; equal rows are packed as often as they occur;
    long texts are encoded whole.
    """
    return op8_packing.pack(docs, cache_bytes=CACHE_BYTES)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", pii), ("packing", packing)]

#: Two stages are learned or tokenized; SQL cannot express the rows. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with sweep(spark):
            after = materialize(stage(spark, docs, sf_dir), lasting=True)
        if before is not None:
            discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
