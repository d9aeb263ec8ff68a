"""Document operators: chunks and spans, windows, markdown structure, covered ranges.

Relational steps stay in DataFrame functions. Work that needs one document's bytes in
order goes through Arrow batches; no step gathers more than one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.structure import Crumbs, Headings, each_reconstructed, line_pieces, meta_block, paragraph_chunks, soft_pieces
from spanforge.operators.batches import packed, slices, text_bytes

_TEXT_SPAN, _TEXT_SPAN_KINDS = "ord long, text string, start long, end long", [pa.int64(), pa.string(), pa.int64(), pa.int64()]


def paragraphs_as_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, ord, text, start, end): parts between empty lines, trimmed, with byte spans."""
    return per_text(docs, paragraph_chunks, _TEXT_SPAN, _TEXT_SPAN_KINDS, text)


def headed_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same with the heading path in effect at each chunk."""

    def run(data: bytes) -> list[tuple]:
        headings = Headings(data)
        return [(*c, headings.at(c[2])) for c in paragraph_chunks(data)]

    return per_text(docs, run, _TEXT_SPAN + ", heading string", [*_TEXT_SPAN_KINDS, pa.string()], text)


def reconstruct(files: DataFrame) -> DataFrame:
    """(path, ord, text, heading, start_line, start_col, end_line, end_col, contextualized).

    ``files`` has path, content, grammar and comment (see ``routing``) and spans, an
    array of (ord, start, end); one row per file, whose structure is read once. A span
    outside its content raises an error.
    """

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for path, data, grammar, mark, spans in zip(*b.columns, strict=True):
            spans = spans.as_py() or []
            made = each_reconstructed(data.as_py() or b"", path.as_py() or "", grammar.as_py() or "", mark.as_py() or "", [(x["start"], x["end"]) for x in spans])
            for x, m in zip(spans, made, strict=True):
                yield path.as_py(), x["ord"], *m

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
        names = ["path", "ord", "text", "heading", "start_line", "start_col", "end_line", "end_col", "contextualized"]
        for b in slices(batches):
            yield from packed(rows(b), kinds, names)

    asked = files.select("path", F.col("content").cast("binary"), "grammar", "comment", F.col("spans").cast("array<struct<ord: bigint, start: bigint, end: bigint>>"))
    return asked.mapInArrow(run, "path string, ord long, text string, heading string, start_line long, start_col long, end_line long, end_col long, contextualized string")


def window_prefixes(files: DataFrame, layout: Callable[[int], list[tuple[int, int]]], head: int) -> DataFrame:
    """(path, window_no, prefix): what precedes the body of each window of a file.

    ``files`` has path, content, grammar and comment; ``layout`` gives the windows of a
    content of so many bytes.
    """

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for path, data, grammar, mark in zip(*b.columns, strict=True):
            data, mark = data.as_py() or b"", mark.as_py()
            crumbs, first = Crumbs(data, path.as_py(), grammar.as_py()), head_bytes(data, head)
            for i, (start, _) in enumerate(layout(len(data))):
                yield path.as_py(), i, window_prefix(first, crumbs.at(start), mark) if start else b""

    def run(batches):
        for b in slices(batches):
            yield from packed(rows(b), [pa.string(), pa.int64(), pa.binary()], ["path", "window_no", "prefix"])

    return files.select("path", F.col("content").cast("binary"), "grammar", "comment").mapInArrow(run, "path string, window_no long, prefix binary")


def head_bytes(data: bytes, size: int) -> bytes:
    """The first bytes up to and with the last newline; all of them without one."""
    head = data[:size]
    return head[: head.rfind(b"\n") + 1] or head


def window_prefix(head: bytes, crumb: str, mark: str) -> bytes:
    """Head section and, if there is one, the breadcrumb of a later window's body."""
    return head + (b"\n" + meta_block(mark, crumb).encode() if crumb else b"") + b"\n\n"


def byte_sums(data: bytes, dims: int) -> np.ndarray:
    """Sums of the bytes at places of equal remainder by ``dims``."""
    a = np.frombuffer(data, np.uint8)
    return np.array([a[i::dims].sum(dtype=np.int64) for i in range(dims)])


def byte_vectors(df: DataFrame, text: str, dims: int, name: str = "v") -> DataFrame:
    """``df`` with the mock model's vector: byte i is added to slot i modulo dims."""
    at = df.columns.index(text)

    def run(batches):
        for b in slices(batches):
            out = [byte_sums(raw.as_py() or b"", dims) for raw in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, name])

    return df.mapInArrow(run, _with(df, name, "array<bigint>"))


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` {kind}"


def per_text(df: DataFrame, fn: Callable[[bytes], Iterable[tuple]], item: str, kinds: list, text: str = "content") -> DataFrame:
    """``df`` without its content, with the rows that ``fn`` makes of each content.

    ``item`` is their DDL, ``kinds`` the Arrow types in the same order. A null content has
    no rows. Rows leave in batches of bounded size, also those of one content.
    """
    at, names = df.columns.index(text), [x.split()[0] for x in item.split(", ")]
    kept = [c for c in df.columns if c != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def run(batches):
        for b in slices(batches):
            # the content is not among what is repeated for every row
            texts, beside, rest = b.column(at).cast(pa.binary()), text_bytes(b, at).tolist(), b.select(kept)
            rows = ((i, *row) for i, raw in enumerate(texts) if raw.is_valid for row in fn(raw.as_py()))
            for made in packed(rows, [pa.int64(), *kinds], ["", *names], lambda row, beside=beside: beside[row[0]]):
                yield pa.RecordBatch.from_arrays(rest.take(made.column(0)).columns + made.columns[1:], [*kept, *names])

    return df.mapInArrow(run, f"{ddl}, {item}")


def _pieces(fn, most):
    def run(data: bytes) -> list[tuple]:
        return [(i, a, b) for i, (a, b) in enumerate(fn(data, most))]

    return run


SPAN, SPAN_KINDS = "ord long, start long, end long", [pa.int64()] * 3


def line_pack(df: DataFrame, most: int) -> DataFrame:
    return per_text(df, _pieces(line_pieces, most), SPAN, SPAN_KINDS)


def soft_split(df: DataFrame, most: int) -> DataFrame:
    return per_text(df, _pieces(soft_pieces, most), SPAN, SPAN_KINDS)


def char_split(df: DataFrame, most: int, overlap: int, content: str = "content") -> DataFrame:
    """Overlapping byte pieces: (…, start, piece); steps are a generated sequence."""
    step = most - overlap if most > overlap else most
    n = F.octet_length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return df.select(*[c for c in df.columns if c != content], content, F.explode(starts).alias("start")).select(
        *[c for c in df.columns if c != content], F.col("start").cast("long").alias("start"), F.substring(F.col(content).cast("binary"), F.col("start") + 1, F.lit(most)).alias("piece")
    )


def windows(df: DataFrame, largest: int = 300_000, overlap: int = 30_000, body: int = 286_000, content: str = "content") -> DataFrame:
    """(…, window_no, body_start, body_end): one window for what fits, else a first full
    one and bodies of ``body`` bytes that overlap by ``overlap``."""
    n, first, step = F.octet_length(content), largest - overlap, body - overlap
    more = F.ceil((n - first - body) / F.lit(step))
    starts = F.when(n <= largest, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), F.greatest(more, F.lit(0)).cast("int")), lambda i: F.lit(first) + i * step)))
    rows = df.select(*[c for c in df.columns if c != content], n.alias("n"), F.posexplode(starts).alias("window_no", "body_start"))
    end = F.when(F.col("window_no") == 0, F.least("n", F.lit(largest))).otherwise(F.least("n", F.col("body_start") + body))
    return rows.select(*[c for c in df.columns if c != content], F.col("window_no").cast("long"), F.col("body_start").cast("long"), end.cast("long").alias("body_end"))


def head_section(content: Column, size: int) -> Column:
    """The first bytes up to and with the last newline; all of them without one."""
    head = F.decode(F.substring(content.cast("binary"), 1, size), "ISO-8859-1")
    cut = F.regexp_extract(head, r"(?s)^(.*\n)", 1)
    return F.encode(F.when(cut == "", head).otherwise(cut), "ISO-8859-1")


def to_raw(offset: Column, prefix_len: Column, body_start: Column) -> Column:
    """A window's offset as one of the document; null inside the prefix."""
    return F.when(offset >= prefix_len, body_start + offset - prefix_len)


def merged_ranges(spans: DataFrame, key: str) -> DataFrame:
    """Union of [start, end): overlapping or abutting ranges become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
    return marked.withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("isle")


def uncovered(spans: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Spans, in order, that no union of the accepted ones before contains."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        held: list[list[int]] = []
        keep = []
        for a, b in zip(table.column("start").to_pylist(), table.column("end").to_pylist(), strict=True):
            keep.append(not any(x <= a and b <= y for x, y in held))
            if keep[-1]:
                apart = [h for h in held if h[1] < a or b < h[0]]
                over = [h for h in held if not (h[1] < a or b < h[0])]
                held = sorted([*apart, [min([a, *(h[0] for h in over)]), max([b, *(h[1] for h in over)])]])
        return table.filter(pa.array(keep))

    return spans.groupBy(key).applyInArrow(fold, spans.schema)


def markdown_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, line_no, line, start, level, heading, block): headings outside fences open blocks."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return per_text(docs, lambda data: Headings(data).rows(), "line_no long, line string, start long, level long, heading string, block long", kinds, text)


def line_headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, line_no, heading) of every line."""
    return per_text(docs, lambda data: enumerate(Headings(data).paths, 1), "line_no long, heading string", [pa.int64(), pa.string()], text)


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, block, heading, first_line, n_lines, n_bytes) of the blocks that headings open."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return per_text(docs, lambda data: Headings(data).blocks(), "block long, heading string, first_line long, n_lines long, n_bytes long", kinds, text)


def markdown_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, first_line, last_line) of runs of lines that are not blank."""
    return per_text(docs, lambda data: Headings(data).paragraphs(), "first_line long, last_line long", [pa.int64()] * 2, text)
