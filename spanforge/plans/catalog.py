"""Queries by name, and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import routing, structure, text
from spanforge.operators import diff, documents, search, store
from spanforge.operators.batches import slices
from spanforge.plans.inputs import CHUNKS, FILES, HEADED, INDEXED, MD, MD_HARD, SHA, TREE, files, indexed, md_docs, md_hard, read, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IGNORE = ["# generated", "src/3", "7.go", "node_modules/", ""]
DIMS = 8
QUESTION = "the report of the meeting"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


_SCORED = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v ORDER BY vec_id LIMIT 1), s AS (SELECT v.vec_id, v.label, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q)"


@query(f"WITH {_SCORED} SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 5")
def knn_topk_cosine(spark, d):
    return search.top_k(read(spark, d, "embeddings"), _first_vector(spark, d), 5, ("vec_id",)).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def knn_per_query_topk(spark, d):
    v = read(spark, d, "embeddings")
    return search.top_k_each(v, v.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE score >= 0.2")
def knn_threshold_score(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    return read(spark, d, "embeddings").select("vec_id", F.round(text.cosine(F.col("embedding"), q), 6).alias("score")).where("score >= 0.2")


@query(f"WITH {_SCORED}, m AS (SELECT vec_id, score, CASE WHEN label % 2 = 0 THEN 'even@64' ELSE 'odd@64' END AS model FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, vec_id) AS n FROM m) SELECT model, vec_id, score FROM r WHERE n <= 5 ORDER BY score DESC, vec_id LIMIT 5")
def multi_model_merge(spark, d):
    v, q = read(spark, d, "embeddings"), _first_vector(spark, d)
    parts = [search.top_k(v.where(F.col("label") % 2 == r).select(F.lit(m).alias("model"), "vec_id", "embedding"), q, 5, ("vec_id",)) for r, m in ((0, "even@64"), (1, "odd@64"))]
    return search.merge_models(parts, 5, ("vec_id",)).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, {SHA} AS blob_sha FROM documents")
def blob_sha(spark, d):
    return read(spark, d, "documents").select("doc_id", text.blob_sha(F.col("text")).alias("blob_sha"))


@query(f"""WITH {FILES}, e AS (SELECT path, regexp_extract(path, '\\.([^./]*)$', 1) AS x FROM files)
SELECT path, CASE WHEN x IN ('go', 'py', 'tsx', 'json') THEN 'code' ELSE 'text' END AS type, CASE x WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'tsx' WHEN 'json' THEN 'json' ELSE '' END AS grammar,
CASE x WHEN 'go' THEN '//' WHEN 'py' THEN '#' WHEN 'tsx' THEN '//' WHEN 'json' THEN '//' ELSE '' END AS comment,
CASE WHEN x IN ('go', 'tsx', 'json', 'html') THEN 'code' ELSE 'text' END AS overridden FROM e""")
def route_filetype(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", routing.file_type(p).alias("type"), routing.grammar(p).alias("grammar"), routing.comment_mark(p).alias("comment"), routing.file_type(p, {".html": "code", ".py": "text"}).alias("overridden"))


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT starts_with(path, 'src/3/') AND regexp_extract(path, '[^/]*$') <> '7.go' AND regexp_extract(path, '\\.([^./]*)$', 1) IN ('md', 'txt', 'go', 'py', 'tsx', 'json')")
def ignore_candidate_filter(spark, d):
    return files(spark, d).select("path").where(routing.candidate(F.col("path"), IGNORE))


@query(f"WITH {TREE}, {INDEXED} SELECT coalesce(t.path, ix.path) AS path, CASE WHEN ix.path IS NULL THEN 'new' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM tree t FULL JOIN ix ON t.path = ix.path WHERE t.blob_sha IS DISTINCT FROM ix.blob_sha")
def tree_diff_touched(spark, d):
    return diff.touched(tree(spark, d), indexed(spark, d))


@query(f"WITH {TREE}, {INDEXED} SELECT coalesce(t.path, ix.path) AS path, CASE WHEN t.path IS NULL THEN 'delete' WHEN t.blob_sha = ix.blob_sha AND version = 10 THEN 'skip' ELSE 'embed' END AS action FROM tree t FULL JOIN ix ON t.path = ix.path")
def reindex_action_plan(spark, d):
    return diff.action_plan(tree(spark, d), indexed(spark, d))


@query(f"WITH {TREE}, {INDEXED} SELECT path FROM ix WHERE path NOT IN (SELECT path FROM tree)")
def deletions_anti(spark, d):
    return diff.deletions(tree(spark, d), indexed(spark, d))


_COST = "SELECT count(*) AS files, count(*) AS chunks, coalesce(sum(strlen(text) // 3), 0)::BIGINT AS embed_tokens, round(coalesce(sum(strlen(text) // 3), 0)::BIGINT * {p}, 9) AS dollars FROM "


@query(f"WITH {TREE}, {INDEXED} {_COST.format(p='0.00000018')} tree t WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.path = t.path AND ix.blob_sha = t.blob_sha AND version = 10)")
def cost_estimate_next(spark, d):
    t = tree(spark, d)
    todo = diff.action_plan(t, indexed(spark, d)).where("action = 'embed'")
    return diff.estimate(t.join(todo, "path", "left_semi"), "voyage-context-3@256").withColumn("dollars", F.round("dollars", 9))


@query(f"WITH {TREE} {_COST.format(p='0.0000002')} tree")
def cost_estimate_full(spark, d):
    return diff.estimate(tree(spark, d), "mystery@128").withColumn("dollars", F.round("dollars", 9))


_BYTES = "b AS (SELECT {k}, unnest(range(strlen(text))) AS i, hex(encode(text)) AS h FROM {t}), m AS (SELECT {k}, i % 8 AS slot, sum(('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)::BIGINT AS v FROM b GROUP BY ALL)"


@query(f"WITH {_BYTES.format(k='doc_id', t='documents')} SELECT doc_id, slot, v FROM m")
def mock_isolated_vector(spark, d):
    v = documents.byte_vectors(read(spark, d, "documents").select("doc_id", "text", F.octet_length("text").alias("n")), "text", DIMS)
    return v.select("doc_id", "n", F.posexplode("v").alias("slot", "v")).where("slot < n").select("doc_id", F.col("slot").cast("long").alias("slot"), "v")


@query(f'WITH {CHUNKS} SELECT path, ord, "start", "end" FROM ch')
def auto_chunk_spans(spark, d):
    return documents.paragraphs_as_chunks(md_docs(spark, d)).select("path", "ord", "start", "end")


def _contextual(spark: SparkSession, d: str) -> DataFrame:
    """(path, ord, start, end, embedding): chunk bytes and document bytes, summed."""

    def run(data: bytes) -> Iterator[tuple]:
        whole = documents.byte_sums(data, DIMS)
        return ((i, a, b, whole + documents.byte_sums(piece, DIMS)) for i, piece, a, b in structure.paragraph_chunks(data))

    return documents.per_text(md_docs(spark, d), run, "ord long, start long, end long, embedding array<bigint>", [*[pa.int64()] * 3, pa.list_(pa.int64())], "text")


_CONTEXT = f"""{CHUNKS}, wb AS (SELECT path, unnest(range(strlen(text))) AS i, hex(encode(text)) AS h FROM md), wv AS (SELECT path, i % 8 AS slot, sum(('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT) AS v FROM wb GROUP BY ALL),
cb AS (SELECT path, ord, unnest(range(strlen(text))) AS i, hex(encode(text)) AS h FROM ch), cv AS (SELECT path, ord, i % 8 AS slot, sum(('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT) AS v FROM cb GROUP BY ALL),
e AS (SELECT ch.path, ch.ord, wv.slot, (wv.v + coalesce(cv.v, 0))::BIGINT AS v FROM ch JOIN wv ON wv.path = ch.path LEFT JOIN cv ON cv.path = ch.path AND cv.ord = ch.ord AND cv.slot = wv.slot)"""


@query(f"WITH {_CONTEXT} SELECT path, ord, slot, v FROM e")
def mock_contextual_vector(spark, d):
    return _contextual(spark, d).select("path", "ord", F.posexplode("embedding").alias("slot", "v")).withColumn("slot", F.col("slot").cast("long"))


def _question() -> list[float]:
    out = [0.0] * DIMS
    for i, b in enumerate(QUESTION.encode()):
        out[i % DIMS] += b
    return out


@query(f"""WITH {_CONTEXT}, q AS (SELECT {_question()}::DOUBLE[] AS q),
s AS (SELECT path, ord, round(list_cosine_similarity(list(v::DOUBLE ORDER BY slot), any_value(q)), 9) AS score FROM e, q GROUP BY path, ord)
SELECT s.path, s.ord, round(s.score, 6) AS score, ch.text FROM s JOIN ch ON ch.path = s.path AND ch.ord = s.ord ORDER BY s.score DESC, s.path, s.ord LIMIT 5""")
def semantic_search_end_to_end(spark, d):
    """Chunks, vectors, nearest neighbours; the text is joined to the winners only."""
    v = _contextual(spark, d)
    scored = v.withColumn("score", F.round(text.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in _question()])), 9))
    top = scored.select("path", "ord", "score", "start", "end").orderBy(F.desc_nulls_last("score"), "path", "ord").limit(5)
    raw = md_docs(spark, d).join(F.broadcast(top), "path")  # five rows
    piece = F.decode(F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return raw.select("path", "ord", F.round("score", 6).alias("score"), piece.alias("text"))


_WIN = """n AS (SELECT doc_id, strlen(text) AS n FROM documents), w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 2000 THEN [0] ELSE [0] || [1800 + 1600 * i FOR i IN range(greatest(0, ceil((n - 3600) / 1600.0))::BIGINT + 1)] END) AS body_start FROM n),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY body_start) - 1 AS window_no, body_start::BIGINT AS body_start, CASE WHEN body_start = 0 THEN least(n, 2000) ELSE least(n, body_start + 1800) END::BIGINT AS body_end FROM w)"""


def _windows(spark, d):
    return documents.windows(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 2000, 200, 1800)


@query(f"WITH {_WIN} SELECT * FROM x")
def window_layout(spark, d):
    return _windows(spark, d)


@query(f"""WITH {_WIN}, hd AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, substr(h, 1, 600) AS s FROM hd),
l AS (SELECT doc_id, s, list_max([i FOR i IN range(len(s) // 2) IF substr(s, 2 * i + 1, 2) = '0A']) AS last FROM c),
p AS (SELECT doc_id, CASE WHEN last IS NULL THEN len(s) // 2 ELSE last + 1 END::BIGINT AS head_len FROM l)
SELECT x.doc_id, window_no, CASE WHEN body_start > 0 THEN head_len + 2 ELSE 0 END::BIGINT AS prefix_len,
CASE WHEN 400 >= CASE WHEN body_start > 0 THEN head_len + 2 ELSE 0 END THEN body_start + 400 - CASE WHEN body_start > 0 THEN head_len + 2 ELSE 0 END END::BIGINT AS raw_400 FROM x JOIN p ON p.doc_id = x.doc_id""")
def window_prefix_map(spark, d):
    heads = read(spark, d, "documents").select("doc_id", F.octet_length(documents.head_section(F.col("text"), 300)).alias("head_len"))
    rows = _windows(spark, d).join(heads, "doc_id").withColumn("prefix_len", F.when(F.col("body_start") > 0, F.col("head_len") + 2).otherwise(0).cast("long"))
    return rows.select("doc_id", "window_no", "prefix_len", documents.to_raw(F.lit(400), F.col("prefix_len"), F.col("body_start")).cast("long").alias("raw_400"))


_GAPS = 'g AS (SELECT doc_id, body_start + (body_start * 7 % 900) AS "start", body_end - (body_end * 3 % 700) AS "end" FROM x WHERE body_start + (body_start * 7 % 900) < body_end - (body_end * 3 % 700))'


def _gappy(spark, d):
    w = _windows(spark, d)
    return w.select("doc_id", (F.col("body_start") + F.col("body_start") * 7 % 900).alias("start"), (F.col("body_end") - F.col("body_end") * 3 % 700).alias("end")).where('start < end')


@query(f"""WITH {_WIN}, {_GAPS}, r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isle FROM r)
SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY doc_id, isle""")
def covered_range_merge(spark, d):
    return documents.merged_ranges(_gappy(spark, d), "doc_id")


@query(f"""WITH RECURSIVE {_WIN}, {_GAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "end", "start") AS i FROM g),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::STRUCT(a BIGINT, b BIGINT)[] AS held, false AS keep, 0::BIGINT AS "start", 0::BIGINT AS "end" FROM o
UNION ALL SELECT o.doc_id, o.i, CASE WHEN len([h FOR h IN r.held IF h.a <= o."start" AND o."end" <= h.b]) > 0 THEN r.held ELSE list_append([h FOR h IN r.held IF h.b < o."start" OR o."end" < h.a],
{{'a': least(o."start", coalesce(list_min([h.a FOR h IN r.held IF NOT (h.b < o."start" OR o."end" < h.a)]), o."start")), 'b': greatest(o."end", coalesce(list_max([h.b FOR h IN r.held IF NOT (h.b < o."start" OR o."end" < h.a)]), o."end"))}}) END,
len([h FOR h IN r.held IF h.a <= o."start" AND o."end" <= h.b]) = 0, o."start", o."end" FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1)
SELECT doc_id, "start", "end" FROM r WHERE keep""")
def covered_range_dedup(spark, d):
    return documents.uncovered(_gappy(spark, d), "doc_id", ["end", "start"])


@query(f"""WITH {MD_HARD}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM mdh),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 AS inside FROM l),
v AS (SELECT *, CASE WHEN inside = 0 AND regexp_matches(line, '^#{{1,6}} ') THEN len(regexp_extract(line, '^(#+) ', 1)) ELSE 0 END AS lv FROM f),
t AS (SELECT *, CASE WHEN lv > 0 THEN trim(substr(line, lv + 2)) END AS title FROM v),
h AS (SELECT path, i, {", ".join(f"max(CASE WHEN lv = {k} THEN {{{{'i': i, 'title': title}}}} END) OVER w AS h{k}, max(CASE WHEN lv > 0 AND lv < {k} THEN i END) OVER w AS u{k}" for k in range(1, 7)).replace("{{", "{").replace("}}", "}")} FROM t WINDOW w AS (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT path, i, [{", ".join(f"CASE WHEN h{k} IS NULL OR coalesce(u{k}, 0) > h{k}.i THEN '' ELSE h{k}.title END" for k in range(1, 7))}] AS ts FROM h),
c AS (SELECT path, i, ts, coalesce(list_min([k FOR k IN range(1, 7) IF ts[k] = '']), 7) AS stop FROM g)
SELECT path, i AS line_no, array_to_string([repeat('#', k::INT) || ' ' || ts[k] FOR k IN range(1, stop)], ' > ') AS heading FROM c""")
def md_heading_breadcrumb(spark, d):
    """Heading paths over fences, skipped levels and headings without a title."""
    return documents.line_headings(md_hard(spark, d))


@query(f"""WITH {MD}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM md),
k AS (SELECT path, line, line_no, sum(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM l)
SELECT path, block, min(line_no) AS first_line, count(*) AS n_lines, (sum(strlen(line) + 1) - 1)::BIGINT AS n_bytes FROM k GROUP BY path, block""")
def md_hard_blocks(spark, d):
    return documents.markdown_blocks(md_docs(spark, d)).drop("heading")


@query(f"""WITH {MD}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM md),
s AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS run FROM l WHERE regexp_matches(line, '[^ \\t\\n\\r\\x0b\\f]'))
SELECT path, min(line_no) AS first_line, max(line_no) AS last_line FROM s GROUP BY path, run""")
def md_paragraphs(spark, d):
    return documents.markdown_paragraphs(md_docs(spark, d))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), s AS (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1800)) AS s FROM h)
SELECT doc_id, s AS "start", substr(h, (2 * s + 1)::BIGINT, 4000) AS piece FROM s""")
def char_split_overlap(spark, d):
    p = documents.char_split(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 2000, 200)
    return p.withColumn("piece", F.hex("piece"))


@query("""WITH h AS (SELECT doc_id, substr(hex(encode(text)), 1, 2 * (strlen(text) * 2 // 3)) AS h, strlen(text) * 2 // 3 AS o FROM documents),
l AS (SELECT doc_id, o, [i FOR i IN range(o) IF substr(h, (2 * i + 1)::BIGINT, 2) = '0A'] AS nl FROM h)
SELECT doc_id, o::BIGINT AS "offset", (len(nl) + 1)::BIGINT AS line, (o - coalesce(list_max(nl), -1))::BIGINT AS col FROM l""")
def line_col_from_offset(spark, d):
    at = F.floor(F.octet_length("text") * 2 / 3).cast("int")
    line, col = text.line_col(F.col("text"), F.col("offset"))
    return read(spark, d, "documents").select("doc_id", "text", at.alias("offset")).select("doc_id", F.col("offset").cast("long").alias("offset"), line.cast("long").alias("line"), col.cast("long").alias("col"))


@query(f"WITH {CHUNKS} SELECT path, ord, text FROM ch")
def slice_reconstruct(spark, d):
    """Texts cut anew from the documents' bytes by their spans."""
    return _reconstructed(spark, d).select("path", "ord", "text")


def _reconstructed(spark, d):
    """All chunks of the markdown documents, from spans and contents alone."""
    spans = documents.per_text(md_docs(spark, d).withColumn("content", F.col("text")), lambda data: [([{"ord": o, "start": a, "end": b} for o, _, a, b in structure.paragraph_chunks(data)],)], "spans array<struct<ord:bigint,start:bigint,end:bigint>>", [pa.list_(pa.struct([("ord", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))], "text")
    return documents.reconstruct(spans.select("path", "content", routing.grammar(F.col("path")).alias("grammar"), routing.comment_mark(F.col("path")).alias("comment"), "spans"))


@query(f"WITH {CHUNKS}, {HEADED} SELECT path, ord, text, path || ' > ' || heading AS heading, 0::BIGINT AS start_line, 0::BIGINT AS start_col, 0::BIGINT AS end_line, 0::BIGINT AS end_col, '<context>' || chr(10) || path || ' > ' || heading || chr(10) || '</context>' || chr(10) || chr(10) || text AS contextualized FROM hd")
def reconstruct_rows(spark, d):
    """Rows of an index of prose, rehydrated."""
    return _reconstructed(spark, d)


_CODE_ROWS = """src AS (SELECT 'src/' || doc_id || '.go' AS path, 'package p' || chr(10) || chr(10) || '// Doc ' || doc_id || chr(10) || 'func Outer() {' || chr(10) || chr(9) || 'f := `' || chr(10) || 'func No() {}' || chr(10) || '`' || chr(10) || chr(9) || 'g("' || regexp_replace(text, '[^A-Za-zà-ÿ ]', '', 'g') || '")' || chr(10) || '}' || chr(10) || chr(10) || 'type T struct {' || chr(10) || chr(9) || 'x int' || chr(10) || '}' || chr(10) AS t FROM documents),
pos AS (SELECT path, t, strlen(split_part(t, chr(9) || 'g(', 1)) + 1 AS g, strlen(split_part(t, 'type T', 1)) AS ty, strlen(t) AS n FROM src),
sp AS (SELECT path, t, 0 AS ord, 0 AS a, 9 AS b, path AS heading FROM pos UNION ALL SELECT path, t, 1, g, ty - 3, path || ' > function Outer' FROM pos UNION ALL SELECT path, t, 2, ty + 5, n - 1, path || ' > type T' FROM pos)"""


@query(f"""WITH {_CODE_ROWS}, h AS (SELECT *, hex(encode(t)) AS h FROM sp),
x AS (SELECT path, ord, heading, a, b, decode(unhex(substr(h, 2 * a + 1, 2 * (b - a)))) AS text, [i FOR i IN range(a) IF substr(h, 2 * i + 1, 2) = '0A'] AS na, [i FOR i IN range(b) IF substr(h, 2 * i + 1, 2) = '0A'] AS nb FROM h)
SELECT path, ord::BIGINT AS ord, text, heading, (len(na) + 1)::BIGINT AS start_line, (a - coalesce(list_max(na), -1))::BIGINT AS start_col, (len(nb) + 1)::BIGINT AS end_line, (b - coalesce(list_max(nb), -1))::BIGINT AS end_col, '// ' || heading || chr(10) || chr(10) || text AS contextualized FROM x""")
def reconstruct_code_rows(spark, d):
    """Rows of an index of code: definitions as breadcrumbs, lines and columns."""
    t = F.concat(F.lit("package p\n\n// Doc "), F.col("doc_id").cast("string"), F.lit('\nfunc Outer() {\n\tf := `\nfunc No() {}\n`\n\tg("'), F.regexp_replace("text", "[^A-Za-zà-ÿ ]", ""), F.lit('")\n}\n\ntype T struct {\n\tx int\n}\n'))
    src = read(spark, d, "documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), t.alias("content"))
    g, ty, n = F.octet_length(F.substring_index("content", "\tg(", 1)) + 1, F.octet_length(F.substring_index("content", "type T", 1)), F.octet_length("content")
    span = lambda o, a, b: F.struct(F.lit(o).cast("long").alias("ord"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    spans = F.array(span(0, F.lit(0), F.lit(9)), span(1, g, ty - 3), span(2, ty + 5, n - 1))
    p = F.col("path")
    return documents.reconstruct(src.select("path", "content", routing.grammar(p).alias("grammar"), routing.comment_mark(p).alias("comment"), spans.alias("spans")))


def small_windows(n: int) -> list[tuple[int, int]]:
    """Windows of 2000 bytes and bodies of 1800 that overlap by 200."""
    out = [(0, min(n, 2000))]
    while out[-1][1] < n:
        start = 1800 + 1600 * (len(out) - 1)
        out.append((start, min(n, start + 1800)))
    return out


@query(f"""WITH {MD}, n AS (SELECT path, text, strlen(text) AS n, hex(encode(text)) AS h, regexp_extract(text, '^# ([^\n]*)', 1) AS a, regexp_extract(text, '\n\n## ([^\n]*)', 1) AS b FROM md),
w AS (SELECT *, unnest(CASE WHEN n <= 2000 THEN [0] ELSE [0] || [1800 + 1600 * i FOR i IN range(greatest(0, ceil((n - 3600) / 1600.0))::BIGINT + 1)] END) AS s FROM n),
l AS (SELECT *, list_max([i FOR i IN range(least(n, 300)) IF substr(h, (2 * i + 1)::BIGINT, 2) = '0A']) AS last FROM w)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS window_no, CASE WHEN s = 0 THEN '' ELSE decode(unhex(substr(h, 1, (2 * (last + 1))::BIGINT))) || chr(10) || '<context>' || chr(10) || path || ' > # ' || a || ' > ## ' || b || chr(10) || '</context>' || chr(10) || chr(10) END AS prefix FROM l""")
def window_prefix_full(spark, d):
    """Head section, path and headings before the later windows of a document."""
    p = F.col("path")
    files_ = md_docs(spark, d).select("path", F.col("text").alias("content"), routing.grammar(p).alias("grammar"), routing.comment_mark(p).alias("comment"))
    return documents.window_prefixes(files_, small_windows, 300).withColumn("prefix", F.decode("prefix", "UTF-8"))


def _headed(spark, d):
    return documents.headed_chunks(md_docs(spark, d))


@query(f"WITH {CHUNKS}, {HEADED} SELECT path, ord, '<context>' || chr(10) || path || ' > ' || heading || chr(10) || '</context>' || chr(10) || chr(10) || text AS prose, '# ' || path || ' > ' || heading || chr(10) || chr(10) || text AS code FROM hd")
def contextualize_text(spark, d):
    crumb = text.breadcrumb(F.col("path"), F.col("heading"))
    h = _headed(spark, d).withColumn("crumb", crumb)
    return h.select("path", "ord", text.contextualized(F.lit(""), F.col("crumb"), F.col("text")).alias("prose"), text.contextualized(F.lit("#"), F.col("crumb"), F.col("text")).alias("code"))


@query(f"WITH {CHUNKS}, {HEADED} SELECT path, string_agg('## ' || path || ':L0 > ' || heading || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS page FROM hd GROUP BY path")
def render_hits(spark, d):
    """The chunks of every document as a page of hits."""
    h = _headed(spark, d).withColumn("crumb", text.breadcrumb(F.col("path"), F.col("heading")))
    section = h.select("path", "ord", F.concat(text.chunk_heading(F.col("crumb"), F.lit(0)), F.lit("\n\n"), "text").alias("section"))
    pages = section.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "section"))).alias("s"))
    return pages.select("path", F.array_join(F.col("s.section"), "\n\n---\n\n").alias("page"))


@query(f"WITH {CHUNKS}, {HEADED} SELECT path, heading, text, max(ord) AS ord FROM hd GROUP BY path, heading, text")
def chunk_reuse_map(spark, d):
    return store.reuse_map(documents.byte_vectors(_headed(spark, d), "text", DIMS, "embedding")).select("path", "heading", "text", "ord")


def _chunk_rows(spark, d):
    return indexed(spark, d).select("path", "model", "version", F.explode(F.expr("filter(sequence(0, chunks), i -> i < chunks)")).alias("ord"))


@query(f"WITH {FILES}, {INDEXED} SELECT model, count(*) AS n_files, sum(chunks)::BIGINT AS n_chunks FROM ix WHERE version = 10 GROUP BY model")
def store_stats(spark, d):
    rows = _chunk_rows(spark, d).where("version = 10")
    return store.stats(indexed(spark, d), rows, 10)


@query(f"WITH {FILES}, {INDEXED} SELECT path, model, version FROM ix WHERE model IN ('mock@8')")
def cleanup_orphans(spark, d):
    return store.without_orphans(indexed(spark, d), ["mock@8"]).select("path", "model", "version")


_CACHE = "cache AS (SELECT CASE WHEN doc_id % 2 = 0 OR doc_id % 9 = 0 THEN path ELSE 'old/' || path END AS path, CASE WHEN doc_id % 6 = 1 THEN 'mock@16' ELSE 'mock@8' END AS model, sha1(CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE 'y' END || doc_id) AS blob_sha FROM files), art AS (SELECT path, CASE WHEN doc_id % 6 = 1 THEN 'mock@16' ELSE 'mock@8' END AS model, sha1('y' || doc_id) AS blob_sha FROM files)"


@query(f"WITH {FILES}, {_CACHE}, a AS (SELECT * FROM art WHERE model = 'mock@8') SELECT coalesce(a.path, c.path) AS path, coalesce(a.model, c.model) AS model, CASE WHEN a.path IS NULL THEN 'evict' WHEN c.path IS NULL OR a.blob_sha <> c.blob_sha THEN 'upsert' ELSE 'keep' END AS action FROM a FULL JOIN cache c ON c.path = a.path AND c.model = a.model")
def sync_cache_actions(spark, d):
    f = files(spark, d).withColumn("model", F.when(F.col("doc_id") % 6 == 1, "mock@16").otherwise("mock@8"))
    sha = lambda mark: F.sha1(F.concat(mark, F.col("doc_id").cast("string")))
    old = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 9 == 0), F.col("path")).otherwise(F.concat(F.lit("old/"), "path"))
    cache = f.select(old.alias("path"), "model", sha(F.when(F.col("doc_id") % 9 == 0, "x").otherwise("y")).alias("blob_sha"))
    return diff.sync_actions(f.select("path", "model", sha(F.lit("y")).alias("blob_sha")), cache, ["mock@8"])


@query(f"WITH {TREE}, {INDEXED}, p AS (SELECT coalesce(t.path, ix.path) AS path, t.path IS NULL AS gone, NOT coalesce(t.blob_sha = ix.blob_sha AND version = 10, false) AS touched FROM tree t FULL JOIN ix ON t.path = ix.path) SELECT path, blob_sha, version FROM ix WHERE path IN (SELECT path FROM p WHERE NOT touched) UNION ALL SELECT t.path, t.blob_sha, 10 FROM tree t JOIN p ON p.path = t.path WHERE p.touched AND NOT p.gone")
def upsert_snapshot(spark, d):
    t, old = tree(spark, d).select("path", "blob_sha"), indexed(spark, d).select("path", "blob_sha", "version")
    plan = diff.action_plan(t, old).where("action <> 'skip'")
    fresh = t.join(plan.where("action = 'embed'"), "path", "left_semi").withColumn("version", F.lit(10).cast("long"))
    return store.upserted(old, fresh, plan)


@query(f"""WITH {TREE}, {INDEXED} SELECT coalesce(t.path, ix.path) AS path, CASE WHEN ix.path IS NULL THEN 'expected file is missing from the index' WHEN t.path IS NULL THEN 'indexed file is not expected' WHEN t.blob_sha <> ix.blob_sha THEN 'stale blob' ELSE 'stale format version' END AS msg
FROM tree t FULL JOIN ix ON t.path = ix.path WHERE ix.path IS NULL OR t.path IS NULL OR t.blob_sha <> ix.blob_sha OR version <> 10
UNION ALL SELECT '', 'file count differs from the marker' FROM ix HAVING count(*) <> 3 UNION ALL SELECT '', 'chunk count differs from the marker' FROM ix HAVING sum(chunks) <> 7""")
def healthcheck_issues(spark, d):
    return diff.health_issues(tree(spark, d).select("path", "blob_sha"), indexed(spark, d), 3, 7)


@query("""WITH t AS (SELECT doc_id, strlen(text) // 3 AS n FROM documents), s AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE round(n * pow(10, 2 - floor(log10(n)))) / pow(10, 2 - floor(log10(n))) END AS r FROM t)
SELECT doc_id, n::BIGINT AS tokens, round(r, 6) AS rounded FROM s""")
def format_tokens(spark, d):
    n = text.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", n.alias("tokens"), F.round(text.significant(n.cast("double")), 6).alias("rounded"))


def _cut(longs: str, most: int, overlap: int = 200) -> str:
    """SQL: (k, a, b) of the overlapping pieces, in whole characters, of (k, a, h): place and hex of long texts."""
    step = most - overlap
    inside = lambda p: f"(substr(h, (2 * ({p}) + 1)::BIGINT, 1) IN ('8', '9', 'A', 'B') AND {p} > 0 AND {p} < n)"
    ahead = f"CASE WHEN NOT {inside('i')} THEN i WHEN NOT {inside('i + 1')} THEN i + 1 WHEN NOT {inside('i + 2')} THEN i + 2 ELSE i + 3 END"
    back = f"CASE WHEN NOT {inside('e')} THEN e WHEN NOT {inside('e - 1')} THEN e - 1 WHEN NOT {inside('e - 2')} THEN e - 2 ELSE e - 3 END"
    return (
        f"(SELECT k, pos + low AS a, pos + high AS b FROM (SELECT k, pos, n, h, {ahead} AS low, {back} AS high FROM (SELECT k, pos, n, h, i, least(i + {most}, n) AS e FROM "
        f"(SELECT k, a AS pos, h, len(h) // 2 AS n, unnest(range(0, len(h) // 2, {step})) AS i FROM {longs}) x1) x2) x3 WHERE low < high)"
    )


def _soft(source: str, most: int) -> str:
    """SQL: CTEs up to ``soft`` (k, a, b), the soft pieces of (k, t)."""
    return f"""sl AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM {source}),
sa AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM sl),
ss AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM sa WHERE regexp_matches(line, '[^ \\t\\n\\r\\x0b\\f]')),
sp AS (SELECT k, min(pos) AS a, max(pos + strlen(line)) AS b FROM ss GROUP BY k, run),
so AS (SELECT sp.*, b - a AS n, row_number() OVER (PARTITION BY k ORDER BY a) AS j, count(*) OVER (PARTITION BY k) AS last FROM sp JOIN {source} USING (k) WHERE strlen(t) > {most}),
sr AS (SELECT DISTINCT k, 0::BIGINT AS j, NULL::BIGINT AS ha, NULL::BIGINT AS hb, 0::BIGINT AS size, NULL::BIGINT AS ea, NULL::BIGINT AS eb, false AS done FROM so
UNION ALL SELECT so.k, so.j, CASE WHEN n > {most} THEN NULL WHEN ha IS NULL OR size + 2 + n > {most} THEN so.a ELSE ha END, CASE WHEN n > {most} THEN NULL ELSE so.b END,
CASE WHEN n > {most} THEN 0 WHEN ha IS NULL OR size + 2 + n > {most} THEN n ELSE size + 2 + n END,
CASE WHEN ha IS NOT NULL AND (n > {most} OR size + 2 + n > {most}) THEN ha END, CASE WHEN ha IS NOT NULL AND (n > {most} OR size + 2 + n > {most}) THEN hb END, so.j = so.last FROM sr JOIN so ON so.k = sr.k AND so.j = sr.j + 1),
sg AS (SELECT so.k, so.a, substr(hex(encode(t)), (2 * so.a + 1)::BIGINT, (2 * n)::BIGINT) AS h FROM so JOIN {source} USING (k) WHERE n > {most}),
soft AS (SELECT k, ea AS a, eb AS b FROM sr WHERE ea IS NOT NULL UNION ALL SELECT k, ha, hb FROM sr WHERE done AND ha IS NOT NULL UNION ALL SELECT k, 0, strlen(t) FROM {source} WHERE strlen(t) <= {most} UNION ALL SELECT * FROM {_cut('sg', most)})"""


@query(f"""WITH RECURSIVE l AS (SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, strlen(text) AS total FROM documents),
p AS (SELECT *, strlen(line) AS n, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, count(*) OVER (PARTITION BY k) AS last FROM l),
r AS (SELECT DISTINCT k, 0::BIGINT AS i, NULL::BIGINT AS begin, NULL::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS total, false AS done FROM p
UNION ALL SELECT p.k, p.i, CASE WHEN n > 800 THEN NULL WHEN begin IS NULL OR pos + n - begin > 800 THEN pos ELSE begin END, CASE WHEN begin IS NOT NULL AND (n > 800 OR pos + n - begin > 800) THEN begin END, CASE WHEN begin IS NOT NULL AND (n > 800 OR pos + n - begin > 800) THEN pos - 1 END, p.total, p.i = p.last FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1),
g AS (SELECT k, pos AS a, hex(encode(line)) AS h FROM p WHERE n > 800),
o AS (SELECT k, a, b FROM r WHERE a IS NOT NULL UNION ALL SELECT k, begin, total FROM r WHERE done AND begin < total UNION ALL SELECT * FROM {_cut('g', 800)})
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS ord, a::BIGINT AS "start", b::BIGINT AS "end" FROM o""")
def greedy_line_pack(spark, d):
    return documents.line_pack(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 800)


@query(f"""WITH RECURSIVE {MD}, src AS (SELECT path AS k, text AS t FROM md), {_soft('src', 800)}
SELECT k AS path, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS ord, a::BIGINT AS "start", b::BIGINT AS "end" FROM soft""")
def md_soft_split(spark, d):
    return documents.soft_split(md_docs(spark, d).select("path", F.col("text").alias("content")), 800)


@query(f"""WITH RECURSIVE {MD}, src AS (SELECT path AS k, 'doc > # ' || regexp_extract(text, '^# ([^\\n]*)', 1) || ' > ## ' || regexp_extract(text, '\\n\\n## ([^\\n]*)', 1) AS crumb, substr(text, strpos(text, chr(10) || '## ') + 2 + len(regexp_extract(text, '\\n(## [^\\n]*)', 1))) AS t FROM md), {_soft('src', 2000)},
c AS (SELECT k, crumb, a, b, regexp_replace(decode(unhex(substr(hex(encode(t)), (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT))), '^\\s+|\\s+$', '', 'g') AS chunk FROM soft JOIN src USING (k))
SELECT k AS path, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS ord, crumb, chunk FROM c WHERE chunk <> ''""")
def chunk_markdown(spark, d):
    """Both kinds of splits of markdown: by headings, then by paragraphs."""
    kinds = [pa.int64(), pa.string(), pa.string()]
    md = md_docs(spark, d).select("path", F.col("text").alias("content"))
    return documents.per_text(md, lambda raw: [(i, c, t) for i, (c, t) in enumerate(structure.chunk_markdown(raw.decode("utf-8", "replace"), "doc"))], "ord long, crumb string, chunk string", kinds)


_SOURCES = "src AS (SELECT doc_id, strlen(doc_id::VARCHAR) + 18 AS c, strlen(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')) AS n FROM documents), spot AS (SELECT doc_id, c, n, c + 15 AS w, c + 49 + n AS e FROM src)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A small Python module per document."""
    body = F.concat(F.lit("import os\n\n# doc "), F.col("doc_id").cast("string"), F.lit("\nclass Doc:\n    def words(self):\n        return '"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", ""), F.lit("'\n\n\ndef main():\n    return Doc()\n"))
    return read(spark, d, "documents").select("doc_id", body.alias("content"))


@query(f"""WITH {_SOURCES} SELECT doc_id, c::BIGINT AS "start", e::BIGINT AS "end", 'class' AS label, 'Doc' AS name FROM spot UNION ALL SELECT doc_id, w, e, 'function', 'words' FROM spot UNION ALL SELECT doc_id, e + 3, e + 3 + 28, 'function', 'main' FROM spot""")
def code_definitions(spark, d):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return documents.per_text(_sources(spark, d), lambda raw: structure.definitions(raw.decode(), "python"), "start long, end long, label string, name string", kinds)


@query(f"""WITH {_SOURCES} SELECT doc_id, 'm.py' AS crumb, 0::BIGINT AS "start", 9::BIGINT AS "end" FROM spot UNION ALL SELECT doc_id, 'm.py > class Doc', 11, c + 10 FROM spot UNION ALL SELECT doc_id, 'm.py > function main', e + 3, e + 31 FROM spot
UNION ALL SELECT doc_id, 'm.py > class Doc > function words', c + 11, CASE WHEN n + 38 > 200 THEN c + 31 ELSE e END FROM spot UNION ALL SELECT doc_id, 'm.py > class Doc > function words', c + 32, least(e, c + 232) FROM spot WHERE n + 38 > 200""")
def chunk_code(spark, d):
    return documents.per_text(_sources(spark, d), lambda raw: structure.chunk_code(raw, "python", "m.py", 200), "crumb string, start long, end long", [pa.string(), pa.int64(), pa.int64()])


@query("SELECT event_id, unnest([''] || json_keys(props)) AS path FROM events")
def config_path(spark, d):
    """Paths of the JSON of events."""
    src = read(spark, d, "events").select("event_id", F.col("props").alias("content"))
    return documents.per_text(src, lambda raw: [(p,) for p, _, _ in structure.json_paths(raw.decode())], "path string", [pa.string()])


@query("SELECT vec_id, 16 + 4 * len(embedding) AS n_bytes, true AS same FROM embeddings")
def vec_codec_roundtrip(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for b in slices(batches):
            rows = b.column(1).to_pylist()
            coded = [structure.encode_vectors([r]) for r in rows]
            same = [structure.decode_vectors(c)[0] == r for c, r in zip(coded, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in coded], pa.int64()), pa.array(same)], ["vec_id", "n_bytes", "same"])

    return v.mapInArrow(run, "vec_id long, n_bytes long, same boolean")


@query("SELECT doc_id, CASE WHEN strlen(text) > 0 THEN greatest(1, strlen(regexp_extract(text, '[^\\n]*$'))) ELSE 1 END::BIGINT AS last_col FROM documents")
def end_of_last_line(spark, d):
    return read(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), F.octet_length(F.substring_index("text", "\n", -1))).cast("long").alias("last_col"))
