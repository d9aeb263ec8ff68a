import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import common, op1_decontaminate, op5_jaccard, op9_quality


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, now, seen = [n for n, _ in corpus_pipeline.STAGES], docs, []
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert sorted(now.columns) == sorted(docs.columns)
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in op9_quality.score(docs, op9_quality.fit(docs, labels)).where("predicted = 1").collect()}
    kept = docs.where(docs["doc_id"].isin(list(good)))
    first = {r["component_id"] for r in op5_jaccard.components(kept).collect()}
    clean = {r["doc_id"] for r in op1_decontaminate.contaminated(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
    assert seen == [good, first, first & clean, first & clean]
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == seen[-1]
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


A, B = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
NEAR_B = B.replace("beta59", "other")
LONG = " ".join(f"word{i % 4999}" for i in range(60_000))
ROWS = [(5, A), (5, B), (3, NEAR_B), (None, A), (None, A), (7, A), (7, A), (8, None), (8, None), (None, ""), (9, " \n "), (10, LONG), (2, LONG), (11, "one two three"), (None, "two words"), (1, "one two three"), (1, "one two three")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0).cast("long"))
    for c in ("key", "label", "row", "found", "gone_id", "h", "set_id", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_row_of_each_group_stays(spark, odd, sf):
    got = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert got.columns == odd.columns
    # linked: A with A, B with its near copy, the long texts, the equal short ones
    want = [(5, A), (3, NEAR_B), (8, None), (8, None), (None, ""), (9, " \n "), (2, LONG), (1, "one two three"), (None, "two words")]
    assert rows_of(got) == sorted(want, key=str)


def test_contaminated_texts_go_whatever_their_ids(spark, odd, tmp_path):
    spark.createDataFrame([(1, "TWO words."), (2, None), (3, "alpha3 alpha4"), (4, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.decontaminate(spark, odd, str(tmp_path))
    assert got.columns == odd.columns and rows_of(got) == sorted([r for r in ROWS if r[1] not in (A, "two words")], key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, odd, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd.limit(0), sf).count() == 0
    got = stage(spark, odd, sf)
    if name == "packing":
        assert got.groupBy("doc_id").count().count() == len({r[0] for r in ROWS})
    else:
        assert got.columns == odd.columns and set(rows_of(got)) <= set(ROWS)
    if name == "PII":
        assert got.count() == len(ROWS) and {r["n_chars"] for r in got.where("doc_id = 8").collect()} == {None}


def test_quality_fares_alike_for_equal_rows(spark, odd, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rows_of(op9_quality.keep_good(odd, op9_quality.fit(docs, labels)))
    assert all(got.count(r) in (0, ROWS.count(r)) for r in ROWS)


def test_what_a_stage_wrote_is_swept(spark):
    with common.sweep(spark):
        gone, stays = common.materialize(spark.range(3)), common.materialize(spark.range(4), lasting=True)
    assert stays.count() == 4 and gone.written_path not in common._written
    with pytest.raises(Exception, match="(?i)not.*exist"):
        gone.count()
