"""Column expressions over document text. Offsets are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices in dollars per million tokens, by a part of the model's name; fixed values.
PRICES = {"voyage-context-4": 0.12, "voyage-context-3": 0.18}
OTHER_PRICE = 0.20
BYTES_PER_TOKEN = 3
BLANK = r"[ \t\n\r\x0b\f]"


def blob_sha(content: Column) -> Column:
    """Content id: SHA-1 of ``blob <bytes>``, a zero byte and the bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tokens(content: Column) -> Column:
    return F.floor(F.octet_length(content) / BYTES_PER_TOKEN).cast("long")


def price_per_token(model: str) -> float:
    return next((p for k, p in PRICES.items() if k in model), OTHER_PRICE) / 1e6


def breadcrumb(*parts: Column) -> Column:
    """Parts that are not empty, joined by `` > ``."""
    return F.concat_ws(" > ", *[F.when(p != "", p) for p in parts])


def meta_block(mark: Column, heading: Column) -> Column:
    """A heading as comment lines, or as a context element where there is no mark."""
    commented = F.array_join(F.transform(F.split(heading, "\n"), lambda x: F.concat(mark, F.lit(" "), x)), "\n")
    return F.when(mark == "", F.concat(F.lit("<context>\n"), heading, F.lit("\n</context>"))).otherwise(commented)


def contextualized(mark: Column, heading: Column, text: Column) -> Column:
    return F.when(heading == "", text).otherwise(F.concat(meta_block(mark, heading), F.lit("\n\n"), text))


def chunk_heading(crumb: Column, line: Column) -> Column:
    """``## file:L<line>`` and what follows the first `` > ``."""
    at = F.instr(crumb, " > ")
    first = F.when(at > 0, F.expr("substring(crumb, 1, instr(crumb, ' > ') - 1)")).otherwise(crumb)
    rest = F.when(at > 0, F.expr("substring(crumb, instr(crumb, ' > '))")).otherwise("")
    return F.concat(F.lit("## "), first, F.lit(":L"), line.cast("string"), rest)


def significant(x: Column, digits: int = 3) -> Column:
    """Rounded to a number of significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null where a vector is zero."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(d(a, a)) * F.sqrt(d(b, b))
    return F.when(norm > 0, d(a, b) / norm)


def line_col(content: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and byte column of a byte offset."""
    head = F.substring(content.cast("binary"), F.lit(1), offset)
    text = F.decode(head, "ISO-8859-1")
    line = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(text, "\n", -1)) + 1
