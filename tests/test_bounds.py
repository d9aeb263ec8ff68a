import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from spanforge.functions import structure
from spanforge.operators import batches, documents, search


class Frame:
    """Stands for a frame of one Arrow batch: gives what an operator makes of it."""

    def __init__(self, names, columns):
        self.columns = names.split()
        self.schema = StructType([StructField(n, StringType()) for n in self.columns])
        self.batch = pa.RecordBatch.from_pydict(dict(zip(self.columns, columns, strict=True)))

    def mapInArrow(self, run, ddl):
        pool = pa.proxy_memory_pool(pa.default_memory_pool())
        before = pa.default_memory_pool()
        pa.set_memory_pool(pool)
        try:
            self.made = [(b.num_rows, b.nbytes, b.to_pydict()) for b in run(iter([self.batch]))]
        finally:
            pa.set_memory_pool(before)
        self.peak = pool.max_memory()
        return self

    def rows(self):
        return [r for _, _, made in self.made for r in zip(*made.values(), strict=True)]


def test_rows_do_not_carry_their_content():
    text = "# t\n" + "word word word\n" * 20_000
    got = documents.line_headings(Frame("path text", [["a", "b", "c"], [text, None, "x"]]))
    assert got.rows() == [("a", i, "# t") for i in range(1, 20_003)] + [("c", 1, "")]
    assert got.peak < 16 << 20  # 20002 times the content are 6 GB
    assert len(got.made) > 1 and all(n <= batches.OUT_ROWS and size <= 2 * batches.OUT_BYTES for n, size, _ in got.made)


def test_batches_count_what_is_repeated_beside_the_content():
    wide = documents.per_text(Frame("beside content", [["w" * (1 << 20)] * 2, ["a b c d e f", "g"]]), lambda raw: [(x,) for x in raw.split()], "word string", [pa.string()])
    assert [r[1] for r in wide.rows()] == list("abcdefg")
    assert [n for n, _, _ in wide.made] == [4, 3]


def test_no_piece_is_only_the_end_of_a_character():
    for end in ("é", "€", "😀"):
        for n in range(1790, 1812):
            line = ("x" * n + end).encode()
            pieces = structure.line_pieces(b"a\n" + line + b"\nb", 800)[1:-1]
            assert [p for p in pieces if (b"a\n" + line)[p[0]] & 0xC0 == 0x80] == [] and pieces[-1][1] == 2 + len(line)
            assert all((b"a\n" + line)[a:b].decode() for a, b in pieces)
    # without overlap enough to hold it, the character's end is still in a piece
    assert structure.char_pieces("aaaaaaaa😀".encode(), 10, 1) == [(0, 8), (9, 12)]


def test_soft_pieces_at_a_step_inside_the_last_character():
    data = ("short\n\n" + "x" * 1799 + "é").encode()
    assert structure.soft_pieces(data, 800) == [(0, 5), (7, 807), (607, 1407), (1207, 1808)]


def test_a_null_content_has_no_pieces():
    got = documents.soft_split(Frame("path content", [["a", "b"], [None, ""]]), 800)
    assert got.rows() == [("b", 0, 0, 0)]


def test_scores_of_many_queries_are_held_by_tiles(spark):
    n, rng = 6000, np.random.default_rng(4)
    v = rng.normal(size=(n, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(v), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    peak = []

    class Vectors:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def select(self, *_):
            return self

        def orderBy(self, *_):
            return self

        def toLocalIterator(self):
            return ({"q": i, "v": x} for i, x in enumerate(v.tolist()))

        def mapInArrow(self, run, _):
            tracemalloc.start()
            made = pa.Table.from_batches(run(iter([batch])))
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return spark.createDataFrame(made.to_pandas())

    got = search.top_k_each(Vectors(), Vectors(), 3).where("query_id % 1500 = 7").orderBy("query_id", "rank").collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert [r["id"] for r in got] == [i for q in (7, 1507, 3007, 4507) for i in np.argsort(-(unit @ unit[q]))[:3]]
    assert peak[0] < 100 << 20  # all scores at once are 288 MB


@pytest.mark.parametrize("operator", [documents.headed_chunks, documents.paragraphs_as_chunks, documents.markdown_paragraphs])
def test_pieces_of_a_long_text_leave_in_bounded_batches(operator):
    got = operator(Frame("path text", [["a"], ["# t\n\n" + "word word\n\n" * 20_000]]))
    assert sum(n for n, _, _ in got.made) == 20_001
    assert got.peak < 16 << 20  # 20001 times the content are 4 GB
    assert len(got.made) > 1 and all(size <= 2 * batches.OUT_BYTES for _, size, _ in got.made)


def test_contextual_vectors_leave_without_texts():
    from spanforge.plans import catalog

    docs = Frame("path text", [["a"], ["# t\n\n" + "word word\n\n" * 20_000]])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog, "md_docs", lambda *_: docs)
        catalog._contextual(None, "")
    assert sum(n for n, _, _ in docs.made) == 20_001 and list(docs.made[0][2]) == ["path", "ord", "start", "end", "embedding"]
    assert docs.peak < 16 << 20 and all(size <= 2 * batches.OUT_BYTES for _, size, _ in docs.made)


def test_sums_of_bytes_need_no_array_of_places():
    data = bytes(range(256)) * (1 << 14)
    tracemalloc.start()
    frame = documents.byte_vectors(Frame("text", [[data.decode("latin-1"), None, "abc"]]), "text", 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw = np.frombuffer(data.decode("latin-1").encode(), np.uint8).astype(int)
    assert [r[1] for r in frame.rows()] == [[raw[::2].sum(), raw[1::2].sum()], [0, 0], [97 + 99, 98]]
    assert peak < 8 * len(raw)  # one array of places takes as much


def test_reconstructed_rows_leave_in_bounded_batches():
    data = "# " + "t" * 2000 + "\n" + "word\n" * 10_000
    spans = [{"ord": i, "start": 2003 + 5 * i, "end": 2007 + 5 * i} for i in range(10_000)]

    class Files(Frame):
        def select(self, *_):
            return self

    files = Files("path content grammar comment spans", [["a.md"], [data.encode()], [""], [""], [spans]])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(documents.F, "col", lambda _: type("C", (), {"cast": lambda self, _: None})())
        documents.reconstruct(files)
    assert sum(n for n, _, _ in files.made) == 10_000 and files.made[0][2]["text"][0] == "word"
    assert len(files.made) > 5 and all(size <= 2 * batches.OUT_BYTES for _, size, _ in files.made)
