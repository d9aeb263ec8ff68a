import subprocess

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.cli import Index, main
from spanforge.functions import routing, structure
from spanforge.operators import diff, documents, embed, search
from spanforge.operators.embed import MockModel
from spanforge.operators.store import SnapshotStore
from spanforge.sources import config


def git(root, *args):
    return subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture
def repo(tmp_path):
    root = str(tmp_path)
    git(root, "init", "-q")
    (tmp_path / "spanforge.toml").write_text('exclude = ["private"]\n[embedding]\nprovider = "mock"\nmodel = "mock"\ndimensions = 8\n')
    (tmp_path / ".gitignore").write_text(".spanforge/\nspanforge-state.toml\n")
    (tmp_path / "a.md").write_text("# A\n\nalpha content")
    (tmp_path / "b.md").write_text("# B\n\nbeta content")
    (tmp_path / "private").mkdir()
    (tmp_path / "private/secret.md").write_text("# no\n\nsecret")
    git(root, "add", ".")
    git(root, "commit", "-qm", "first")
    return tmp_path


def test_reindex_search_health(spark, repo, capsys):
    index = Index(spark, str(repo))
    assert index.reindex() == {"files": 3, "chunks": 5}  # the settings file is code
    first = index.store.current()
    index.reindex()
    assert index.store.current() == first  # nothing to do
    assert index.health()["issues"] == []
    hit = index.search("# A\n\nalpha content", 1)[0]
    assert hit["path"] == "a.md"
    (repo / "a.md").write_text("# A\n\nnew words")
    (repo / "b.md").unlink()
    (repo / "c.md").write_text("# C")
    git(str(repo), "add", "-A")
    assert dict(index.reindex(staged=True))["files"] == 3
    git(str(repo), "commit", "-qm", "second")
    now = index.store.current()
    index.reindex()
    assert index.store.current() == now  # staged, then committed
    assert {r["path"] for r in index.rows().select("path").distinct().collect()} == {"a.md", "c.md", "spanforge.toml"}
    assert main(["healthcheck"], spark, str(repo)) == 0
    assert main(["version"]) == 0


def test_gate_writes_nothing(spark, repo):
    index = Index(spark, str(repo))
    with pytest.raises(diff.CostGateError, match="max reindex cost"):
        index.reindex(cap=1e-12)
    assert index.store.current() == 0 and config.read_marker(str(repo)) is None


def test_store_keeps_old_snapshot(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "m", 10)], "path string, model string, version long")
    assert store.read() is None
    assert store.write(rows) == 1 and store.write(rows.union(rows)) == 2
    assert store.read().count() == 2
    store.vacuum()
    assert not (tmp_path / "s/v=1").exists()


def test_patterns(spark):
    assert routing.ignore_patterns([" a/ ", "# x", ""]) == ["a"]
    df = spark.createDataFrame([("node_modules/x.js",), ("a/node_modules/x.js",), ("k.md",), (".spanforge/x.md",), ("x.bin",)], "path string")
    assert [r[0] for r in df.where(routing.candidate(F.col("path"), ["node_modules/"])).collect()] == ["a/node_modules/x.js", "k.md"]


def test_prepare_windows_and_backoff():
    text = "\n\n".join(f"paragraph {i} " + "x" * 90 for i in range(6000)).encode()
    spans = embed.prepare(text, embed.MockModel(8, limit=143_000), lambda _: "")
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    # chunks cut at a window edge overlap their whole and stay
    assert 6000 <= len({s[:2] for s in spans}) == len(spans) <= 6030
    with pytest.raises(ValueError, match="not in its window"):
        bad = embed.MockModel(8)
        bad.embed_document = lambda d: [("absent", [0.0] * 8)]
        embed.prepare(b"some text", bad, lambda _: "", "f")


@given(st.binary(max_size=300), st.integers(5, 60))
def test_pieces_cover(data, most):
    pieces = structure.line_pieces(data, most)
    kept = set()
    for a, b in pieces:
        assert b - a <= most
        kept.update(range(a, b))
    assert all(data[i : i + 1] == b"\n" for i in range(len(data)) if i not in kept)


def test_structure():
    py = "import os\n\n# note\nclass Foo:\n    def alpha(self):\n        return 1\n"
    spans = structure.definitions(py, "python")
    assert structure.code_breadcrumb("c.py", spans, py.index("def"), len(py) - 2) == "c.py > class Foo > function alpha"
    ts = "function foo() {\n  return 1;\n}\n\nclass Bar {\n  run() {\n  }\n}\n"
    assert [x[2:] for x in structure.definitions(ts, "typescript")] == [("function", "foo"), ("class", "Bar"), ("method", "run")]
    hcl = 'resource "aws_instance" "web" {\n  ami = "x"\n}\n'
    assert structure.definitions(hcl, "hcl")[0][2:] == ("resource", '"aws_instance" "web"')
    assert structure.config_path('{"deps": {"list": [1, {"y": 2}]}}', "json", 28) == "deps.list[1].y"
    assert structure.config_path('[[items]]\nname = "a"\n[[items]]\nname = "b"\n', "toml", 32) == "items[1].name"
    assert structure.markdown_blocks("x\n# T\n```\n# no\n```\n## S\ny")[-1][0] == "# T > ## S"


def test_codec():
    v = [[0.5, -1.25], [2.0, 0.0]]
    data = structure.encode_vectors(v)
    assert structure.decode_vectors(data) == v and structure.decode_vectors(structure.encode_vectors([])) == []
    with pytest.raises(ValueError, match="length"):
        structure.decode_vectors(data[:-1])
    with pytest.raises(ValueError, match="differ in number"):
        structure.decode_artifact(structure.encode_meta("s", "m", 10, [(0, 1)]), data)


def test_uncovered_is_ordered(spark):
    rows = spark.createDataFrame([("d", 0, 10), ("d", 5, 15), ("d", 2, 14), ("d", 20, 30), ("d", 10, 20)], "k string, start long, end long")
    got = documents.uncovered(rows.withColumn("o", F.monotonically_increasing_id()), "k", ["o"]).orderBy("o").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 10), (5, 15), (20, 30), (10, 20)]


def chunks(src: str, grammar: str, path: str, most: int = 2000):
    return [(c, src.encode()[a:b].decode(), src.encode()[:a].count(b"\n") + 1) for c, a, b in structure.chunk_code(src.encode(), grammar, path, most)]


def test_code_is_swept_by_definitions():
    two = chunks("function foo() {\n  return 1;\n}\n\nfunction bar() {\n  return 2;\n}\n", "typescript", "a/b.ts")
    assert [(c, n) for c, _, n in two] == [("a/b.ts > function foo", 1), ("a/b.ts > function bar", 5)]
    filler = chunks('import { x } from "y";\nimport { z } from "w";\n\nfunction foo() {\n  return 1;\n}\n', "typescript", "f.ts")
    assert [c for c, _, _ in filler] == ["f.ts", "f.ts > function foo"]
    body = "    this.x += 1;\n" * 80
    large = chunks("class Foo {\n  alpha() {\n" + body + "  }\n\n  beta() {\n" + body + "  }\n}\n", "typescript", "c.ts", 500)
    assert {c for c, _, _ in large} == {"c.ts > class Foo", "c.ts > class Foo > method alpha", "c.ts > class Foo > method beta"}
    assert all(len(t) <= 500 for _, t, _ in large)
    doc = chunks("package p\n\n// Foo does a thing.\nfunc Foo() int {\n\treturn 1\n}\n", "go", "p.go")
    assert [(c, n) for c, _, n in doc] == [("p.go", 1), ("p.go > function Foo", 3)]
    apart = chunks("package p\n\n// A remark.\n\nfunc Foo() {\n}\n", "go", "p.go")
    assert "remark" in apart[0][1] and apart[1][2] == 5
    hcl = chunks('region = "us-east-1"\n\nresource "aws_instance" "web" {\n  ami = "abc"\n}\n\nvariable "size" {\n  default = 1\n}\n', "hcl", "main.tf")
    assert [c for c, _, _ in hcl] == ["main.tf", 'main.tf > resource "aws_instance" "web"', 'main.tf > variable "size"']
    assert chunks("just words\n", "", "x.unknown") == [("x.unknown", "just words\n", 1)]
    assert [c for c, _, _ in chunks("def broken(:\n  pass\n", "python", "b.py")] == ["b.py"]
    assert chunks(" \n\n", "go", "p.go") == []


def test_long_lines_are_cut_at_a_character():
    (crumb, piece, _), *more = chunks('const x = "' + "é" * 500 + '";\n', "typescript", "f.ts", 200)
    assert not more and crumb == "f.ts" and 198 <= len(piece.encode()) <= 200


@pytest.mark.parametrize(
    "grammar,source,want",
    [
        ("go", "type F func() int\n\ntype (\n\tA int\n\tB struct {\n\t\tx int\n\t}\n)\n\nvar s = `\nfunc No() {\n}\n`\n\nfunc (s *S) M() (int, error) {\n\treturn 1, nil\n}\n", [("type", "F"), ("type", "A"), ("type", "B"), ("method", "M")]),
        ("rust", "type B = Vec<i32>;\nimpl A {\n    pub fn m(&self) {\n        fn inner() {}\n    }\n}\nfn f<'a>(x: &'a str) -> char { '}' }\n", [("class", "B"), ("method", "m"), ("function", "inner"), ("function", "f")]),
        ("javascript", "const o = {\n  a: function() { return 1; },\n  b: (x) => x + 1,\n};\nconst g = function named() { return '}' };\n// function no() {}\n", [("function", "a"), ("function", "b"), ("function", "g"), ("function", "named")]),
        ("typescript", "interface I {\n  foo(a: string): number;\n}\nabstract class C {\n  abstract go(x: number): void;\n  run(): void {\n    this.x(1);\n  }\n}\n", [("interface", "I"), ("method", "foo"), ("class", "C"), ("method", "go"), ("method", "run")]),
    ],
)
def test_kinds_of_definitions(grammar, source, want):
    assert [(k, n) for _, _, k, n in structure.definitions(source, grammar)] == want


def test_windows_carry_path_and_structure():
    code = ("x = 1\n" * 10 + "class Outer:\n    # no heading\n" + "    y = 2\n" * 50).encode()
    seen = []

    class Split(MockModel):
        def embed_document(self, document):
            seen.append(document)
            return super().embed_document(document)

    monkey = {"LARGEST": 200, "OVERLAP": 20, "HEAD": 30, "RESERVE": 100}
    old = {k: getattr(embed, k) for k in monkey}
    try:
        for k, v in monkey.items():
            setattr(embed, k, v)
        crumbs = structure.Crumbs(code, "a/m.py", "python")
        embed.prepare(code, Split(), crumbs.at, "a/m.py", "#")
        md = b"# Top\n\n## Sub long title\n\n" + b"word word\n" * 60
        embed.prepare(md, Split(), structure.Crumbs(md, "d.md").at, "d.md", "")
    finally:
        for k, v in old.items():
            setattr(embed, k, v)
    assert any("\n# a/m.py > class Outer\n\n" in d for d in seen) and not any("no heading" in d.split("\n\n")[0] for d in seen[1:5])
    assert any("<context>\nd.md > # Top > ## Sub long title\n</context>" in d for d in seen)


def test_headings_count_from_the_begin_of_their_line():
    h = structure.Headings(b"a\n# T\n```\n# no\n```\n### jump\n## S\ny")
    assert [h.at(i) for i in (0, 2, 4, 12, 20, 29, 36)] == ["", "# T", "# T", "# T", "# T", "# T > ## S", "# T > ## S"]


def test_reconstruction_of_spans():
    go = b"package p\n\nfunc Outer() {\n\tx := 1\n}\n"
    (text, heading, *places, full), = structure.reconstructed(go, "p.go", "go", "//", [(27, 33)])
    assert (text, heading, places) == ("x := 1", "p.go > function Outer", [4, 2, 4, 8]) and full == "// p.go > function Outer\n\nx := 1"
    assert structure.line_col(b"ab\ncde\nf", 3) == (2, 1)
    with pytest.raises(ValueError, match="span 0"):
        structure.reconstructed(go, "p.go", "go", "//", [(3, 99)])


def test_search_shows_breadcrumb_and_line(spark, repo, capsys):
    (repo / "p.go").write_text("package p\n\nfunc Outer() {\n\n\tgamma := 1\n}\n")
    git(str(repo), "add", ".")
    assert main(["reindex", "--staged"], spark, str(repo)) == 0
    assert config.read_marker(str(repo))["commit"] == git(str(repo), "rev-parse", "HEAD").strip()
    assert main(["search", "-k", "20", "gamma"], spark, str(repo)) == 0
    out = capsys.readouterr().out
    assert "## p.go:L5 > function Outer\n\ngamma := 1" in out and "## a.md:L0 > # A\n\nalpha content\n" in out and "\n---\n\n## " in out
    with pytest.raises(SystemExit):
        main(["search", " "], spark, str(repo))
    assert main(["estimate"], spark, str(repo)) == 0 and "kTok" in capsys.readouterr().out


def test_nearest_of_each_query_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties, and zero vectors
    df = spark.createDataFrame([(i, x.tolist() if i % 37 else None) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    v[::37] = 0
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.top_k_each(df, df.where("vec_id % 10 = 3"), 4).collect()}
    n = np.linalg.norm(v, axis=1)
    unit = v / np.where(n > 0, n, np.nan)[:, None]
    for q in range(3, 300, 10):
        s = np.round(unit @ unit[q], 9)
        want = sorted((-s[i], i) for i in range(300) if not np.isnan(s[i]))[:4] if n[q] > 0 else []
        assert [i for _, i in want] == [got[q, r] for r in range(1, 5) if (q, r) in got]
