"""Structure of source text in plain Python: chunkers, definitions, config paths, codecs.

Used inside Arrow batches. Grammar libraries are not assumed: Python definitions come
from the standard ``ast``; other languages from declaration patterns and matched
brackets over text whose strings and comments are blanked, which approximates a full
grammar: code is swept by lines where a grammar would sweep by statements.
"""

from __future__ import annotations

import ast
import json
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

TARGET, OVERLAP = 2000, 200
Piece = tuple[int, int]  # bytes [start, end)

# ------------------------------------------------------------------ splitting


def rune_start(data: bytes, at: int) -> int:
    """The place, or the begin of the character that it cuts."""
    for back in range(4):
        if not 0 < at - back < len(data) or data[at - back] & 0xC0 != 0x80:
            return at - back
    return at


def char_pieces(data: bytes, most: int = TARGET, overlap: int = OVERLAP) -> list[Piece]:
    """Fixed pieces of whole characters that overlap; the last may lie wholly in the one before."""
    size, out, at = len(data), [], 0
    if most > overlap:
        for i in range(0, size, most - overlap):
            a = next((x for x in range(i, min(i + 4, size)) if not x or data[x] & 0xC0 != 0x80), i)
            if out and out[-1][1] == size and data[a] & 0xC0 == 0x80:
                break  # only the end of a character, which the piece before holds whole
            if a < (b := rune_start(data, min(i + most, size))):
                out.append((a, b))
        return out
    while at < size:
        b = rune_start(data, min(at + most, size))
        out.append((at, b if b > at else min(at + most, size)))
        at = out[-1][1]
    return out


def line_pieces(data: bytes, most: int = TARGET) -> list[Piece]:
    """Whole lines packed greedily up to ``most`` bytes; longer lines are cut by characters."""
    out, at, begin = [], 0, None
    for line in data.split(b"\n"):
        end = at + len(line)
        if len(line) > most:
            if begin is not None:
                out.append((begin, at - 1))
                begin = None
            out += [(at + a, at + b) for a, b in char_pieces(line, most)]
        elif begin is None:
            begin = at
        elif end - begin > most:
            out.append((begin, at - 1))
            begin = at
        at = end + 1
    if begin is not None and begin < len(data):
        out.append((begin, len(data)))
    return out


def paragraph_spans(data: bytes) -> list[Piece]:
    """Runs of lines that are not blank."""
    out, at, begin, last = [], 0, None, 0
    for line in data.split(b"\n"):
        if line.strip():
            begin = at if begin is None else begin
            last = at + len(line)
        elif begin is not None:
            out.append((begin, last))
            begin = None
        at += len(line) + 1
    return out + ([(begin, last)] if begin is not None else [])


def soft_pieces(data: bytes, most: int = TARGET) -> list[Piece]:
    """Paragraphs packed greedily (a joiner counts two bytes); longer ones cut by characters."""
    if len(data) <= most:
        return [(0, len(data))]
    out, held, size = [], None, 0
    for a, b in paragraph_spans(data):
        if held is not None and (b - a > most or size + 2 + b - a > most):
            out.append(held)
            held = None
        if b - a > most:
            out += [(a + x, a + y) for x, y in char_pieces(data[a:b], most)]
        elif held is None:
            held, size = (a, b), b - a
        else:
            held, size = (held[0], b), size + 2 + b - a
    return out + ([held] if held is not None else [])


def heading_of(line: str) -> tuple[int, str] | None:
    m = re.match(r"(#{1,6}) (.*)$", line)
    return (len(m[1]), m[2].strip()) if m else None


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(heading path, first line number, text) per heading, fences respected."""
    levels: dict[int, str] = {}
    out, lines, first, fenced = [], [], 1, False

    def path() -> str:
        parts = []
        for level in range(1, 7):
            if not levels.get(level):
                break
            parts.append("#" * level + " " + levels[level])
        return " > ".join(parts)

    for n, line in enumerate(text.split("\n"), 1):
        if line.startswith("```"):
            fenced = not fenced
        found = None if fenced else heading_of(line)
        if found:
            if lines:
                out.append((path(), first, "\n".join(lines)))
            levels = {k: v for k, v in levels.items() if k < found[0]} | {found[0]: found[1]}
            lines, first = [line], n
        else:
            lines.append(line)
    return out + ([(path(), first, "\n".join(lines))] if lines else [])


BLANK = b" \t\n\r\x0b\x0c"


def paragraph_chunks(data: bytes) -> list[tuple[int, bytes, int, int]]:
    """(ord, text, start, end): parts between empty lines without blanks around them."""
    out, at = [], 0
    for raw in data.split(b"\n\n"):
        if text := raw.strip(BLANK):
            start = at + len(raw) - len(raw.lstrip(BLANK))
            out.append((len(out), text, start, start + len(text)))
        at += len(raw) + 2
    return out


class Headings:
    """Heading paths of a markdown text's lines, fences respected."""

    def __init__(self, data: bytes) -> None:
        self.starts, self.ends, self.levels, self.paths, self.lines = [], [], [], [], data.split(b"\n")
        at, fenced, path, titles = 0, False, "", [""] * 7
        for raw in self.lines:
            fence = raw.startswith(b"```")
            fenced ^= fence
            found = None if fenced or fence or not raw.startswith(b"#") else heading_of(raw.decode("utf-8", "replace"))
            if found:
                level, title = found
                titles = titles[:level] + [title] + [""] * (6 - level)
                # levels count up to the first that has no title
                upto = next((k for k in range(1, 7) if not titles[k]), 7)
                path = " > ".join("#" * k + " " + titles[k] for k in range(1, upto))
            self.starts.append(at)
            self.ends.append(at + len(raw))
            self.levels.append(found[0] if found else 0)
            self.paths.append(path)
            at += len(raw) + 1

    def at(self, offset: int) -> str:
        """The path at a byte; a heading counts from the begin of its line."""
        return self.paths[min(bisect_left(self.ends, offset), len(self.ends) - 1)]

    def rows(self) -> Iterator[tuple[int, bytes, int, int, str, int]]:
        """(line_no, line, start, level, heading, block) of every line."""
        block = 0
        for i, line in enumerate(self.lines):
            block += self.levels[i] > 0
            yield i + 1, line, self.starts[i], self.levels[i], self.paths[i], block

    def blocks(self) -> list[tuple[int, str, int, int, int]]:
        """(block, heading, first_line, n_lines, n_bytes) of what headings open."""
        begins = [i for i, level in enumerate(self.levels) if level or not i]
        first = 1 if self.levels[0] else 0
        return [(first + k, self.paths[i], i + 1, j - i, self.ends[j - 1] - self.starts[i]) for k, (i, j) in enumerate(zip(begins, [*begins[1:], len(self.levels)], strict=True))]

    def paragraphs(self) -> list[Piece]:
        """(first, last) line numbers of runs of lines that are not blank."""
        out: list[list[int]] = []
        for i, line in enumerate(self.lines, 1):
            if line.strip(BLANK):
                if out and out[-1][1] == i - 1:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return [(a, b) for a, b in out]


def line_col(data: bytes, at: int) -> tuple[int, int]:
    """1-based line and byte column of an offset."""
    return data.count(b"\n", 0, at) + 1, at - data.rfind(b"\n", 0, at)


class Crumbs:
    """Breadcrumbs of one file, whose structure is read once: path, then what encloses a span."""

    def __init__(self, data: bytes, path: str, grammar: str = "") -> None:
        self.path, self.code = path, bool(grammar)
        self.spans = definitions(data.decode("utf-8", "replace"), grammar) if grammar in (*DECLARATIONS, "python") else []
        self.headings = None if self.code else Headings(data)

    def at(self, start: int, end: int | None = None) -> str:
        if self.headings:
            return " > ".join(x for x in (self.path, self.headings.at(start)) if x)
        return code_breadcrumb(self.path, self.spans, start, start if end is None else end)


def meta_block(mark: str, heading: str) -> str:
    """A heading as comment lines, or as a context element where there is no mark."""
    return "\n".join(f"{mark} {x}" for x in heading.split("\n")) if mark else f"<context>\n{heading}\n</context>"


def reconstructed(data: bytes, path: str, grammar: str, mark: str, spans: list[Piece]) -> list[tuple[str, str, int, int, int, int, str]]:
    """(text, heading, start_line, start_col, end_line, end_col, contextualized) of each span.

    Lines and columns are those of code; of prose they are 0. A span outside the
    content is an error, as the content is then not the one that was indexed.
    """
    return list(each_reconstructed(data, path, grammar, mark, spans))


def each_reconstructed(data: bytes, path: str, grammar: str, mark: str, spans: list[Piece]) -> Iterator[tuple[str, str, int, int, int, int, str]]:
    """The same one at a time."""
    crumbs = Crumbs(data, path, grammar)
    breaks = [i for i, c in enumerate(data) if c == 10] if grammar and len(spans) > 8 else None

    def place(at: int) -> tuple[int, int]:
        if not grammar:
            return 0, 0
        if breaks is None:
            return line_col(data, at)
        n = bisect_left(breaks, at)
        return n + 1, at - (breaks[n - 1] if n else -1)

    for i, (a, b) in enumerate(spans):
        if not 0 <= a <= b <= len(data):
            raise ValueError(f"{path}: span {i} is [{a}, {b}) of {len(data)} bytes")
        text, heading = data[a:b].decode("utf-8", "replace"), crumbs.at(a, b)
        yield text, heading, *place(a), *place(b), f"{meta_block(mark, heading)}\n\n{text}" if heading else text


def chunk_markdown(text: str, path: str, most: int = TARGET) -> list[tuple[str, str]]:
    """(breadcrumb, chunk) of a markdown text; heading lines are left to the breadcrumb."""
    out = []
    for crumb, _, block in markdown_blocks(text):
        lines = block.split("\n")
        body = "\n".join(lines[1:] if heading_of(lines[0]) else lines)
        data = body.encode()
        out += [(" > ".join(x for x in (path, crumb) if x), piece) for a, b in soft_pieces(data, most) if (piece := data[a:b].decode("utf-8", "replace").strip())]
    return out


# ---------------------------------------------------------------- definitions

_JS = [
    ("class", r"^\s*(?:export )?(?:default )?(?:abstract )?class (\w+)"),
    ("function", r"^\s*(?:export )?(?:default )?(?:declare )?(?:async )?function\*? ?(\w+)"),
    ("function", r"(?<=[=(:,!])\s*(?:async )?function\*? (\w+)"),
    ("function", r"(?:(?<=^)|(?<=[ \t;]))(?:export )?(?:const|let|var) (\w+)(?:: [^=\n]+)? = (?:async )?(?:function\b|\([^)]*\)(?:: [^=\n]+)? =>|\w+ =>)"),
    ("function", r"(?<=[{,\n])[ \t]*(\w+): (?:async )?(?:function\b|\([^)\n]*\) =>|\w+ =>)"),
    ("method", r"^[ \t]+(?:async |static |get |set |public |private |protected |readonly |override )*\*?(?!if\b|for\b|while\b|switch\b|catch\b|constructor\b|return\b|function\b|new\b)(\w+)\([^)]*\)[^;{}=\n]*(?=\{)"),
]
#: Declaration patterns: grammar -> [(label, pattern with the name as group 1)], fixed values.
DECLARATIONS = {
    "go": [("method", r"^func \([^)]*\) (\w+)"), ("function", r"^func (\w+)"), ("type", r"(?<=^type )(\w+)")],
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))? )?(?:default )?(?:const )?(?:async )?(?:unsafe )?(?:extern +)?fn (\w+)"),
        ("class", r"^\s*(?:pub(?:\([^)]*\))? )?(?:struct|enum|union|type) (\w+)"),
        ("interface", r"^\s*(?:pub(?:\([^)]*\))? )?(?:unsafe )?trait (\w+)"),
        ("module", r"^\s*(?:pub(?:\([^)]*\))? )?mod (\w+)"),
        ("macro", r"^\s*macro_rules! (\w+)"),
    ],
    "javascript": _JS,
    "hcl": [("block", r"^[ \t]*(\w+(?: \"[^\"\n]*\")*) \{")],
}
DECLARATIONS["typescript"] = DECLARATIONS["tsx"] = [
    *_JS,
    ("interface", r"^\s*(?:export )?(?:declare )?interface (\w+)"),
    ("module", r"^\s*(?:export )?(?:declare )?(?:namespace|module) (\w+)"),
    ("method", r"^[ \t]+(?:public |protected |abstract |readonly )*(?!if\b|for\b|while\b|switch\b|return\b|new\b|constructor\b|function\b|super\b|this\b|await\b|throw\b)(\w+)\??\([^)\n]*\): [^;{}=\n]+;"),
]
#: What is no code: strings and comments by grammar, fixed values.
_NOT_CODE = {
    "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/",
    "rust": r"r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,9}?|[^'\\\n])'|//[^\n]*|/\*.*?\*/",
    "javascript": r"`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/",
    "hcl": r"#[^\n]*|//[^\n]*|/\*.*?\*/|<<[-~]?(\w+)\n.*?\n\s*\1\b",
}
_NOT_CODE["typescript"] = _NOT_CODE["tsx"] = _NOT_CODE["javascript"]


def blanked(source: str, grammar: str) -> str:
    """The source, as long as it was, without what its strings and comments say."""
    empty = lambda m: re.sub(r"[^\n]", " ", m.group())
    return re.sub(_NOT_CODE[grammar], empty, source, flags=re.S)


def _extent(code: str, at: int, by_line: bool) -> int:
    """End of the declaration that goes on at ``at``: after its braces, a semicolon, or its line."""
    depth = 0
    for m in re.compile(r"[][(){};\n]").finditer(code, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
            if c == "}" and not depth and not (by_line and re.match(r"[ \t]*[({.,]", code[m.end() : m.end() + 9])):
                return m.end()
        elif not depth and (c == ";" or by_line):
            return m.end() if c == ";" else m.start()
    return len(code)


def _python_definitions(source: str) -> list[tuple[int, int, str, str]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    starts, out = [0], []
    for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source):
        starts.append(starts[-1] + len(line.encode()))
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((node, "class" if isinstance(node, ast.ClassDef) else "function", node.name))
    out += [(n, "constant", n.targets[0].id) for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)]
    return sorted((starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset, label, name) for n, label, name in out)


def definitions(source: str, grammar: str) -> list[tuple[int, int, str, str]]:
    """(start, end, label, name) of definitions in byte offsets, outer ones first."""
    if grammar == "python":
        return _python_definitions(source)
    if grammar not in DECLARATIONS:
        return []
    code, found = blanked(source, grammar), {}
    for label, pattern in DECLARATIONS[grammar]:
        for m in re.finditer(pattern, code, re.M):
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            kind, name, end = label, m[1], m.end()
            if grammar == "hcl":
                kind, _, name = m[1].partition(" ")
                end -= 1
            if (begin not in found) and not any(b <= m.start(1) < b + len(n) for b, _, _, n in found.values() if b == begin):
                by_line = grammar == "go" or (label == "function" and "=" in m.group()) or m.group().endswith(";")
                found[begin] = (begin, m.end() if m.group().endswith(";") else _extent(code, end, by_line), kind, name)
    if grammar == "go":
        # the types of a group, each on a line of its own
        for group in re.finditer(r"^type \(", code, re.M):
            low, high = group.end(), _matching(code, group.end() - 1)
            for m in re.finditer(r"^\t(\w+)(?= )", code[low:high], re.M):
                found[low + m.start(1)] = (low + m.start(1), _extent(code, low + m.end(), True), "type", m[1])
    spans = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    if grammar == "rust":
        # a function right inside braces that are no function's is a method
        bodies = [(m.end(), _matching(code, m.end() - 1)) for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))? )?(?:unsafe )?(?:impl|trait|mod)\b[^;{}]*\{", code, re.M)]
        functions = [(a, b) for a, b, k, _ in spans if k == "function"]
        inner = lambda a: max(((x, 1) for x, y in bodies if x <= a < y), default=(-1, 1))[0] > max((x for x, y in functions if x < a < y), default=-1)
        spans = [(a, b, "method" if k == "function" and inner(a) else k, n) for a, b, k, n in spans]
    if source.isascii():
        return spans
    sizes = [0]
    for c in source:
        sizes.append(sizes[-1] + len(c.encode("utf-8", "surrogatepass")))
    return [(sizes[a], sizes[b], k, n) for a, b, k, n in spans]


def _matching(code: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[][(){}]").finditer(code, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.start()
    return len(code)


def code_breadcrumb(path: str, spans: list[tuple[int, int, str, str]], start: int, end: int) -> str:
    """The path and all definitions that enclose the range, outermost first."""
    return " > ".join([path, *(f"{k} {n}".strip() for a, b, k, n in spans if a <= start and end <= b)])


def chunk_code(data: bytes, grammar: str, path: str, most: int = TARGET) -> list[tuple[str, int, int]]:
    """(breadcrumb, start, end): a sweep over definitions, inner ones apart from outer ones.

    A definition has chunks of its own, which begin with its line and the comments
    right above it; what lies between definitions is packed by lines up to ``most``
    bytes. A longer line is one chunk, cut at a character.
    """
    text = data.decode("utf-8", "replace")
    if grammar not in DECLARATIONS and grammar != "python":
        return [(path, a, b) for a, b in line_pieces(data, most) if data[a:b].strip()]
    if grammar == "python":
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return [(path, a, b) for a, b in line_pieces(data, most) if data[a:b].strip()]
    spans, out = definitions(text, grammar), []
    mark = b"#" if grammar in ("python", "hcl") else b"//"

    def line_start(at: int) -> int:
        return data.rfind(b"\n", 0, at) + 1

    def lead(at: int) -> int:
        """Begin of the line, and of the comments right above it."""
        at = line_start(at)
        while at and data[line_start(at - 1) : at].strip().startswith((mark, b"/*", b"*")):
            at = line_start(at - 1)
        return at

    def emit(crumb: str, a: int, b: int) -> None:
        while b > a and data[b - 1 : b] in (b"\n", b"\r"):
            b -= 1
        if data[a:b].strip():
            out.append((crumb, a, b))

    def pack(crumb: str, low: int, high: int) -> None:
        """Lines of a range; a range that is only closing brackets is part of no chunk."""
        if not data[low:high].strip(BLANK + b"})];,"):
            return
        begin, at = low, low
        while at < high:
            stop = data.find(b"\n", at, high)
            stop = high if stop < 0 else stop
            if stop - at > most:
                emit(crumb, begin, at)
                emit(path if begin == low and not crumb.count(" > ") else crumb, at, rune_start(data, at + most))
                begin = stop + 1
            elif stop - begin > most:
                emit(crumb, begin, at)
                begin = at
            at = stop + 1
        emit(crumb, min(begin, high), high)

    def sweep(crumb: str, low: int, high: int, inside: list) -> None:
        at = low
        while inside:
            a, b, kind, name = inside.pop(0)
            if a < at:
                continue
            inner = []
            while inside and inside[0][0] < b:
                inner.append(inside.pop(0))
            begin = max(lead(a), at)
            pack(crumb, at, begin)
            own = f"{crumb} > {f'{kind} {name}'.strip()}"
            sweep(own, begin, b, [s for s in inner if s[1] <= b])
            at = b
        pack(crumb, at, high)

    sweep(path, 0, len(data), list(spans))
    return out


# --------------------------------------------------------------- config paths


def json_paths(source: str) -> list[tuple[str, int, int]]:
    """(path, start, end) of every value, in characters; raises ValueError if malformed."""
    json.loads(source)
    out: list[tuple[str, int, int]] = []
    blank, scalar = re.compile(r"\s*"), re.compile(r"\"(?:\\.|[^\"\\])*\"|[^\s,\]}]+")

    def value(at: int, path: str) -> int:
        start = at = blank.match(source, at).end()
        if source[at] in "{[":
            close, n = "}" if source[at] == "{" else "]", 0
            at = blank.match(source, at + 1).end()
            while source[at] != close:
                key = f"{path}[{n}]"
                if close == "}":
                    m = scalar.match(source, at)
                    key = f"{path}.{json.loads(m.group())}" if path else json.loads(m.group())
                    at = blank.match(source, m.end()).end() + 1
                at = blank.match(source, value(at, key)).end()
                if source[at] == ",":
                    at = blank.match(source, at + 1).end()
                n += 1
            at += 1
        else:
            at = scalar.match(source, at).end()
        out.append((path, start, at))
        return at

    value(0, "")
    return sorted(out, key=lambda x: (x[1], -x[2]))


def unquoted(key: str) -> str:
    """Without one layer of matching quotes."""
    return key[1:-1] if len(key) > 1 and key[0] == key[-1] and key[0] in "\"'" else key


def toml_paths(source: str) -> list[tuple[str, int, int]]:
    """(path, start, end) of every ``key = value`` line; tables of arrays are numbered."""
    out, at, table, counts = [], 0, "", {}
    for line in source.split("\n"):
        if m := re.match(r"\s*\[\[(.+?)\]\]", line):
            counts[m[1]] = counts.get(m[1], -1) + 1
            table = f"{m[1]}[{counts[m[1]]}]"
        elif m := re.match(r"\s*\[(.+?)\]", line):
            table = m[1]
        elif m := re.match(r"\s*([\w.\"'-]+)\s*=", line):
            out.append((".".join(x for x in (table, unquoted(m[1])) if x), at, at + len(line)))
        at += len(line) + 1
    return out


def yaml_paths(source: str) -> list[tuple[str, int, int]]:
    """(path, start, end) of every node, from PyYAML's marks."""
    import yaml

    out: list[tuple[str, int, int]] = []

    def walk(node, path: str) -> None:
        out.append((path, node.start_mark.index, node.end_mark.index))
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                walk(v, f"{path}.{k.value}" if path else str(k.value))
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                walk(v, f"{path}[{i}]")

    root = yaml.compose(source)
    if root is not None:
        walk(root, "")
    return out


def config_path(source: str, grammar: str, at: int) -> str:
    """Path of the smallest value that holds the character offset; empty if none does."""
    try:
        found = {"json": json_paths, "toml": toml_paths, "yaml": yaml_paths}[grammar](source)
    except Exception as error:  # malformed sources degrade to the bare path
        if isinstance(error, KeyError):
            raise
        return ""
    return min(((b - a, -a, p) for p, a, b in found if a <= at < max(b, a + 1)), default=(0, 0, ""))[2]


# --------------------------------------------------------------- vector codec

MAGIC, VERSION = b"SFVC", 1


def encode_vectors(vectors: list[list[float]], magic: bytes = MAGIC) -> bytes:
    """16-byte little-endian header (magic, version, width, count), then float32 rows."""
    width = len(vectors[0]) if vectors else 0
    if any(len(v) != width for v in vectors):
        raise ValueError("vectors of different widths")
    return struct.pack("<4sIII", magic, VERSION, width, len(vectors)) + b"".join(struct.pack(f"<{width}f", *v) for v in vectors)


def decode_vectors(data: bytes, magic: bytes = MAGIC) -> list[list[float]]:
    if len(data) < 16:
        raise ValueError("truncated header")
    got, version, width, count = struct.unpack_from("<4sIII", data)
    if got != magic or version != VERSION:
        raise ValueError("not a vector file of this version")
    if len(data) != 16 + 4 * width * count:
        raise ValueError("length does not match the header")
    return [list(struct.unpack_from(f"<{width}f", data, 16 + 4 * width * i)) for i in range(count)]


def encode_meta(blob_sha: str, model: str, version: int, spans: list[Piece]) -> str:
    body = {"blobSha": blob_sha, "modelName": model, "version": version, "chunks": [{"start": a, "end": b} for a, b in spans]}
    return json.dumps(body, indent=2) + "\n"


def decode_artifact(meta: str, vectors: bytes, magic: bytes = MAGIC) -> dict:
    """Both halves of an artifact; counts that differ mean a torn write."""
    out, rows = json.loads(meta), decode_vectors(vectors, magic)
    if len(rows) != len(out["chunks"]):
        raise ValueError("spans and vectors differ in number")
    for chunk, row in zip(out["chunks"], rows, strict=True):
        chunk["embedding"] = row
    return out
