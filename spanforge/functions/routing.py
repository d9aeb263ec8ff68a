"""Column expressions over paths: file types, comment marks, ignore patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> grammar of code files, fixed values.
GRAMMARS = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "go": "go", "py": "python", "rs": "rust", "hcl": "hcl", "tf": "hcl", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
#: Extension -> mark of a line comment, fixed values.
COMMENTS = {"ts": "//", "tsx": "//", "js": "//", "jsx": "//", "go": "//", "rs": "//", "json": "//", "py": "#", "hcl": "#", "tf": "#", "toml": "#", "yaml": "#", "yml": "#"}
PROSE = ("md", "markdown", "txt")
STATE_DIR, STATE_FILE = ".spanforge", "spanforge-state.toml"


def extension(path: Column) -> Column:
    """Lower-case extension without its point; empty if the last segment has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def grammar(path: Column) -> Column:
    return F.coalesce(_looked_up(GRAMMARS, extension(path)), F.lit(""))


def file_type(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """``code`` or ``text``; an override names code, any other value of it means text."""
    default = F.when(grammar(path) != "", "code").otherwise("text")
    if not overrides:
        return default
    own = _looked_up({k.lower().lstrip("."): "code" if v == "code" else "text" for k, v in overrides.items()}, extension(path))
    return F.coalesce(own, default)


def comment_mark(path: Column) -> Column:
    return F.coalesce(_looked_up(COMMENTS, extension(path)), F.lit(""))


def ignore_patterns(lines: list[str]) -> list[str]:
    """Patterns without blanks, comments and the slash at their end."""
    return [p for p in (x.strip().rstrip("/") for x in lines if not x.strip().startswith("#")) if p]


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last segment or the whole path is a pattern, or the path lies below one."""
    base, out = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in ignore_patterns(patterns):
        out = out | (base == p) | (path == p) | path.startswith(p + "/")
    return out


def candidate(path: Column, patterns: list[str], overrides: dict[str, str] | None = None) -> Column:
    """Files to index: code or prose, not ignored, not the index's own."""
    own = path.startswith(STATE_DIR + "/") | (path == STATE_FILE)
    return ~own & ~ignored(path, patterns) & ((file_type(path, overrides) == "code") | extension(path).isin(*PROSE))
