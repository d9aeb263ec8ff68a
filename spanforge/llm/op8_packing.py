"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are the tokenizer's, then ``end_id``. Whole windows of ``window``
ids are cut off first; the rest of each document is cut into halves of what is left (at most
``window / 4``), as differencing needs small items to even out large ones. Items are gathered into blocks that ``BLOCK_WINDOWS`` windows hold
(the last item is cut where the block ends), and each block is split among its
windows by differencing: the two partial partitions with the largest spread are
merged, the fullest side of one with the emptiest of the other, until one is left.
If its fullest window exceeds the capacity, the window count rises by one and the
block is split again. What is left at the end of a partition is a block of as many
windows as it fills; the rest, less than one window, is cut into sequences whose lengths
are powers of two, which need no padding.

One pass without a shuffle; memory is one block, one batch and the words remembered,
which are bounded in bytes. A partition's pieces
depend on its rows only, so a lost task gives the same pieces again.

Edge cases: a null text is empty and gives the end id alone; repeated rows are
packed as often as they occur; an empty table gives no rows; ids are those of the
whole text, however long; ties between partial partitions go by place. Columns besides
the id and the text are not read.
"""

from __future__ import annotations

import heapq
import re
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import bound_batches, slices, table, texts_of

WINDOW = 2048
BLOCK_WINDOWS = 16
#: Ids left free in each window of a full block, so that near-equal windows fit.
SLACK = 3
#: Bytes of words remembered by a worker process, and what a word costs besides its letters and ids.
CACHE_BYTES, WORD_BYTES = 192 << 20, 180
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text encoded at once.
TEXT_BYTES = 1 << 20
_loaded: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """A mapping that forgets what was long not asked for, bounded in bytes.

    New entries go to the young half; when that is full, it becomes the old one, which is
    forgotten at the next such time but for entries recalled from it.
    """

    def __init__(self, size: int) -> None:
        self.most, self.size = size // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, keys: list[str], values: list[bytes]) -> None:
        self.size += WORD_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, values))
        self.young.update(zip(keys, values, strict=True))

    def unknown(self, keys: set[str]) -> set[str]:
        """Those of the keys that neither half knows; brings the others to the young half."""
        missing = keys.difference(self.young)
        old = self.old
        if back := [k for k in missing if k in old] if old else None:
            self.put(back, [old[k] for k in back])
            missing.difference_update(back)
        return missing

    def age(self) -> None:
        """To be called between uses; forgets only when the young half is full."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0


#: A comma or stop after a letter or digit (by any version of Unicode) and before white space: a token of its own.
_PARTED = [(" " + m, re.compile(rf"\{m}(?<=[A-Za-z0-9\xdf-\xf6\xf8-\xff\u03b1-\u03c9\u0430-\u044f]\{m})(?=[ \n])")) for m in ",."]


class WordEncoder:
    """Ids of texts from a tokenizer that drops white space and parts letters from marks.

    Such a tokenizer never joins characters across white space, so a text's ids are
    those of its parts between spaces and line ends in turn, and those are remembered
    up to a bound in bytes. Commas and stops after a word are parted from it first. A
    part of letters, or of letters and closing marks, is looked up by its letters; new
    letter words are encoded in one call, whose ids are told apart by the vocabulary's
    word-end mark.
    """

    END = "</w>"
    MARKS = ".,;:!?|&%*$#"

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # ids as little-endian unsigned 32-bit bytes, which join fast and burden no collector
        self.known = Remembered(cache_bytes)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(self.END)

    def _each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _letter_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._each(words)  # the vocabulary has no such mark
        flat, cuts = ids.tobytes(), (4 * stops).tolist()
        return [flat[at:stop] for at, stop in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, parts: set[str]) -> None:
        known = self.known
        plain: list[tuple[str, str, str]] = []
        other, words, marks = [], set(), set()
        for p in parts:
            if p.isalpha() and p.isascii():
                words.add(word := p.lower())
                if word != p:
                    plain.append((p, word, ""))
                continue
            word = p.rstrip(self.MARKS)
            # beyond ASCII, a letter may be normalized to a letter and a mark of its own
            if word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha()):
                mark, word = p[len(word) :], word.lower() if word.isascii() else word
                words.add(word)
                if mark:
                    marks.add(mark)
                if word != p:
                    plain.append((p, word, mark))
            else:
                other.append(p)
        if new := list(known.unknown(words)):
            known.put(new, self._letter_words(new))
        ends, young = dict(zip(marks, self._each(list(marks)), strict=True)), known.young
        known.put([p for p, _, _ in plain], [young[word] + ends[mark] if mark else young[word] for _, word, mark in plain])
        known.put(other, self._each(other))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        known, split = self.known, []
        known.age()
        for t in texts:
            for mark, pattern in _PARTED:
                t = pattern.sub(mark, t)
            split.append(t.replace("\n", " ").split(" "))
        if new := known.unknown(set().union(*split)):
            self._learn(new)
        get = known.young.__getitem__
        return [b"".join(map(get, words)) for words in split]


def pieces(text: str, size: int = TEXT_BYTES) -> list[str]:
    """The text cut at spaces, which it loses there, into about ``size`` characters each."""
    out, low = [], 0
    while len(text) - low > size:
        cut = text.rfind(" ", low, low + size)
        cut = cut if cut >= 0 else text.find(" ", low + size)
        if cut < 0:
            break
        out.append(text[low:cut])
        low = cut + 1
    return [*out, text[low:]]


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> WordEncoder:
    """One per worker process and tokenizer, with the bound that is asked for last."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path, cache_bytes)
    _loaded[path].known.most = cache_bytes // 2
    return _loaded[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of item numbers with near-equal sums (largest differencing method)."""
    heap, names = [], {}
    for i, s in enumerate(sizes):
        names[i] = ([s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)])
        heap.append((-s, i))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        (sa, ma), (sb, mb) = names.pop(heapq.heappop(heap)[1]), names.pop(heapq.heappop(heap)[1])
        # a is sorted downwards, b is read upwards: imbalances oppose
        merged = sorted(((x + y, g + h) for x, y, g, h in zip(sa, reversed(sb), ma, reversed(mb), strict=True)), key=lambda p: -p[0])
        sums = [p[0] for p in merged]
        names[fresh] = (sums, [p[1] for p in merged])
        heapq.heappush(heap, (sums[-1] - sums[0], fresh))
        fresh += 1
    return names[heap[0][1]][1] if heap else [[] for _ in range(k)]


def split_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups within the capacity; their number rises until all of them fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return [g for g in groups if g]
        k += 1


class _Packer:
    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.next = window, first_sequence
        self.items: list[tuple] = []  # doc_id, start, bytes of ids, doc_tokens
        self.held = 0
        self.room = BLOCK_WINDOWS * (window - SLACK)
        self.rows: list[tuple] = []

    def _sequence(self, items: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in items:
            self.rows.append((doc_id, start, len(ids) // 4, crc32(ids), total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def _block(self) -> None:
        for g in split_block([len(x[2]) // 4 for x in self.items], self.window):
            self._sequence([self.items[i] for i in g])
        self.items, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids, four bytes each."""
        n, w, at = len(ids) // 4, self.window, 0
        while n - at >= w:
            self._sequence([(doc_id, at, ids[4 * at : 4 * (at + w)], n)])
            at += w
        while at < n:
            take = min(max((n - at + 1) // 2, 24), n - at, w // 4, self.room - self.held)
            self.items.append((doc_id, at, ids[4 * at : 4 * (at + take)], n))
            self.held += take
            at += take
            if self.held == self.room:
                self._block()

    def _take(self, size: int) -> list[tuple]:
        """The first ``size`` ids of what is held; an item is cut where they end."""
        part, at = [], 0
        while size:
            doc_id, start, ids, total = self.items[at]
            at += 1
            if len(ids) > 4 * size:
                at -= 1
                self.items[at] = (doc_id, start + size, ids[4 * size :], total)
                ids = ids[: 4 * size]
            size -= len(ids) // 4
            part.append((doc_id, start, ids, total))
        del self.items[:at]
        return part

    def finish(self) -> None:
        """The rest: whole windows by differencing, then sequences whose lengths are powers of two."""
        full = self.held // (self.window - SLACK) * (self.window - SLACK)
        if full:
            rest = self.held - full
            part = self._take(full)
            later, self.items = self.items, part
            self._block()
            self.items, self.held = later, rest
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            self._sequence(self._take(size))
            self.held -= size

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7)], names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    bound_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        packer, enc = _Packer(window, TaskContext.get().partitionId() << 40), encoder(path, cache_bytes)
        last = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, size=TEXT_BYTES):
            ids, texts = b.column(0).to_pylist(), [t.decode("utf-8", "replace") for t in texts_of(b)]
            # only a text that is a slice of its own is long
            encoded = enc.encode(texts) if len(texts) > 1 else [b"".join(enc.encode([p])[0] for p in pieces(t)) for t in texts]
            for doc_id, tokens in zip(ids, encoded, strict=True):
                packer.add(doc_id, tokens + last)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
