"""Inputs of the catalog's queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import blob_sha
from spanforge.operators.batches import bound_batches


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents as markdown with two headings and one paragraph per line."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "lang", F.lit("\n\n## doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))


MD = "md AS (SELECT 'docs/' || doc_id || '.md' AS path, '# ' || lang || chr(10) || chr(10) || '## doc ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


def md_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents below headings of all levels, with fences, jumps and empty titles."""
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    level = F.repeat(F.lit("#"), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.concat(F.lit("before\n# "), "lang", F.lit("\n### jump "), n, F.lit("\n```\n# no heading\n```sh\n## "), n, F.lit("\n"), level, F.lit(" level "), n, F.lit("\n```\n"), "text", F.lit("\n```\n#\n## \n### under nothing\n####### seven\n#none\n# last "), n, F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return d.select(F.concat(F.lit("hard/"), n, F.lit(".md")).alias("path"), text.alias("text"))


MD_HARD = "mdh AS (SELECT 'hard/' || doc_id || '.md' AS path, 'before' || chr(10) || '# ' || lang || chr(10) || '### jump ' || doc_id || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```sh' || chr(10) || '## ' || doc_id || chr(10) || repeat('#', (doc_id % 6 + 1)::INT) || ' level ' || doc_id || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || '#' || chr(10) || '## ' || chr(10) || '### under nothing' || chr(10) || '####### seven' || chr(10) || '#none' || chr(10) || '# last ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## ') AS text FROM documents)"
EXTENSIONS = (".md", ".go", ".py", ".txt", ".html", ".tsx", ".json")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): documents as files of several kinds."""
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("src/"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), "text")


FILES = "files AS (SELECT doc_id, 'src/' || (doc_id % 10) || '/' || doc_id || (['.md', '.go', '.py', '.txt', '.html', '.tsx', '.json'])[doc_id % 7 + 1] AS path, text FROM documents)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they are now; some have been moved since they were indexed."""
    return files(spark, sf_dir).select("path", blob_sha(F.col("text")).alias("blob_sha"), F.col("text").alias("content"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files at an earlier time: under their old paths, with old contents or versions."""
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path"))
    sha = F.when(F.col("doc_id") % 4 == 0, F.sha1(F.concat(F.lit("old"), F.col("doc_id").cast("string")))).otherwise(blob_sha(F.col("text")))
    return files(spark, sf_dir).select(
        path.alias("path"), F.when(F.col("doc_id") % 6 == 1, "mock@16").otherwise("mock@8").alias("model"), sha.alias("blob_sha"), F.when(F.col("doc_id") % 11 == 0, 9).otherwise(10).cast("long").alias("version"), (F.col("doc_id") % 7).alias("chunks")
    )


SHA = "sha1('blob ' || strlen(text) || chr(0) || text)"
TREE = f"{FILES}, tree AS (SELECT path, {SHA} AS blob_sha, text FROM files)"
INDEXED = f"ix AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old/' || path ELSE path END AS path, CASE WHEN doc_id % 6 = 1 THEN 'mock@16' ELSE 'mock@8' END AS model, CASE WHEN doc_id % 4 = 0 THEN sha1('old' || doc_id) ELSE {SHA} END AS blob_sha, CASE WHEN doc_id % 11 = 0 THEN 9 ELSE 10 END::BIGINT AS version, doc_id % 7 AS chunks FROM files)"
CHUNKS = f"""{MD}, raw AS (SELECT path, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS part FROM md),
sp AS (SELECT path, part, regexp_replace(raw, '^[ \\t\\n\\r\\x0b\\f]+|[ \\t\\n\\r\\x0b\\f]+$', '', 'g') AS text, coalesce(sum(strlen(raw) + 2) OVER (PARTITION BY path ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(raw) - strlen(regexp_replace(raw, '^[ \\t\\n\\r\\x0b\\f]+', '')) AS s FROM raw),
ch AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY part) - 1 AS ord, text, s::BIGINT AS "start", (s + strlen(text))::BIGINT AS "end" FROM sp WHERE text <> '')"""
#: Heading of a chunk of the markdown inputs: its own line counts.
HEADED = "hd AS (SELECT ch.*, '# ' || regexp_extract(md.text, '^# ([^\\n]*)', 1) || CASE WHEN ord > 0 THEN ' > ## ' || regexp_extract(md.text, '\\n\\n## ([^\\n]*)', 1) ELSE '' END AS heading FROM ch JOIN md USING (path))"
