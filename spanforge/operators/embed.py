"""Embedding providers and the stage that embeds documents window by window."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from functools import cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.functions import routing
from spanforge.functions.structure import Crumbs
from spanforge.operators.batches import slices
from spanforge.operators.documents import head_bytes, window_prefix

BATCH_BYTES = 90_000
#: Beginning of the names of models that take whole documents.
CONTEXTUAL = "voyage-context"
LARGEST, OVERLAP, HEAD, RESERVE, LEAST_SPLIT = 300_000, 30_000, 12_000, 14_000, 60_000


class TokenLimitError(RuntimeError):
    """The service found a window too long; it is split and sent again."""


class Model(Protocol):
    name: str
    dims: int
    contextual: bool

    def embed_query(self, text: str) -> list[float]: ...

    def embed_document(self, document: str) -> list[tuple[str, list[float]]]:
        """Verbatim chunks in order, with their vectors."""
        ...


class MockModel:
    """Deterministic vectors: byte i is added to slot i modulo dims."""

    contextual = True

    def __init__(self, dims: int = 8, limit: int | None = None) -> None:
        self.name, self.dims, self.limit = f"mock@{dims}", dims, limit

    def embed_query(self, text: str) -> list[float]:
        out = [0.0] * self.dims
        for i, b in enumerate(text.encode()):
            out[i % self.dims] += b
        return out

    def embed_document(self, document: str) -> list[tuple[str, list[float]]]:
        if self.limit and len(document.encode()) > self.limit:
            raise TokenLimitError("too many tokens")
        whole = self.embed_query(document)
        parts = [p for p in (x.strip() for x in document.split("\n\n")) if p]
        return [(p, [a + b for a, b in zip(self.embed_query(p), whole, strict=True)]) for p in parts]


class HttpModel:
    """An embedding service over HTTP.

    Contextual models take whole documents; others only queries and given chunks.
    """

    def __init__(self, model: str, dims: int, base_url: str, api_key_env: str, timeout: int = 60) -> None:
        self.model, self.dims, self.base_url, self.key_env, self.timeout = model, dims, base_url.rstrip("/"), api_key_env, timeout
        self.name, self.contextual = f"{model}@{dims}", model.startswith(CONTEXTUAL)

    def _send(self, place: str, **body) -> list[dict]:
        asked = {"model": self.model, "output_dimension": self.dims, **body}
        key = os.environ.get(self.key_env, "")
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
        request = urllib.request.Request(f"{self.base_url}/v1/{place}", json.dumps(asked).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)["data"]
        except urllib.error.HTTPError as error:
            said = error.read().decode("utf-8", "replace")
            raise (TokenLimitError if error.code == 400 and "token" in said.lower() else RuntimeError)(f"{error.code}: {said[:200]}") from error

    def _checked(self, groups: list[list[dict]], n: int) -> list[list[dict]]:
        if len(groups) != n or any(len(x["embedding"]) != self.dims for g in groups for x in g):
            raise ValueError("the service's answer has another shape than asked for")
        return groups

    def _post(self, inputs: list[list[str]], kind: str, chunking: bool) -> list[list[dict]]:
        """Per input, its embedded parts; a model without context takes one text per input."""
        if self.contextual:
            groups = [g["data"] for g in self._send("contextualizedembeddings", inputs=inputs, input_type=kind, enable_auto_chunking=chunking)]
        else:
            groups = [[x] for x in self._send("embeddings", input=[t for texts in inputs for t in texts], input_type=kind)]
        return self._checked(groups, len(inputs))

    def embed_query(self, text: str) -> list[float]:
        return self._post([[text]], "query", False)[0][0]["embedding"]

    def embed_document(self, document: str) -> list[tuple[str, list[float]]]:
        if not self.contextual:
            raise TypeError(f"{self.name} does not embed whole documents")
        return [(x["text"], x["embedding"]) for x in sorted(self._post([[document]], "document", True)[0], key=lambda x: x["index"])]

    def embed_chunks(self, chunks: list[str]) -> list[list[float]]:
        """Given chunks, in requests of at most ``BATCH_BYTES`` (one alone may exceed it)."""
        out, held, size = [], [], 0
        for c in [*chunks, None]:
            if held and (c is None or size + len(c.encode()) > BATCH_BYTES):
                out += [g[0]["embedding"] for g in self._post([[x] for x in held], "document", False)]
                held, size = [], 0
            if c is not None:
                held.append(c)
                size += len(c.encode())
        return out


def build(provider: str, model: str, dims: int, base_url: str = "", api_key_env: str = "") -> Model:
    if provider == "mock":
        return MockModel(dims)
    if provider in ("", "voyage"):
        return HttpModel(model, dims, base_url or "https://api.voyageai.com", api_key_env or "VOYAGE_API_KEY")
    raise ValueError(f"unknown provider {provider!r}")


def _layout(n: int) -> list[tuple[int, int]]:
    if n <= LARGEST:
        return [(0, n)]
    out, at = [(0, LARGEST)], LARGEST - OVERLAP
    while True:
        end = min(n, at + LARGEST - RESERVE)
        out.append((at, end))
        if end == n:
            return out
        at += LARGEST - RESERVE - OVERLAP


def prepare(data: bytes, model: Model, crumb: Callable[[int], str], path: str = "", mark: str = "") -> list[tuple[int, int, list[float]]]:
    """(start, end, vector) of a document's chunks, each byte-equal to its span.

    A window too long for the model is split with overlap; chunks that touch the
    prefix or lie in ranges already covered are dropped; a chunk that cannot be found
    in its window is an error, as its span would be a guess.
    """
    head = head_bytes(data, HEAD)
    todo, covered, out = _layout(len(data)), [], []
    while todo:
        start, end = todo.pop(0)
        prefix = b""
        if start:
            prefix = window_prefix(head, crumb(start), mark)
            if len(prefix) > RESERVE:
                raise ValueError(f"{path}: prefix of {len(prefix)} bytes")
        window = prefix + data[start:end]
        try:
            found = model.embed_document(window.decode("utf-8", "replace"))
        except TokenLimitError:
            if end - start <= LEAST_SPLIT:
                raise
            half = (end - start) // 2
            todo[:0] = [(start, start + half), (start + half - OVERLAP, end)]
            continue
        cursor = 0
        for i, (text, vector) in enumerate(found):
            piece = text.strip().encode()
            if not piece:
                continue
            at = window.find(piece, cursor)
            if at >= 0:
                cursor = at + len(piece)
            else:
                at = window.find(piece)
            if at < 0:
                raise ValueError(f"{path}: chunk {i} is not in its window: {text[:80]!r}")
            if at < len(prefix):
                continue
            low = start + at - len(prefix)
            high = low + len(piece)
            if data[low:high] != piece:
                raise ValueError(f"{path}: chunk {i} differs from its span")
            if any(a <= low and high <= b for a, b in covered):
                continue
            touching = [r for r in covered if not (r[1] < low or high < r[0])]
            covered = [r for r in covered if r not in touching] + [(min([low, *(r[0] for r in touching)]), max([high, *(r[1] for r in touching)]))]
            out.append((low, high, vector))
    return out


def embed_files(files: DataFrame, model: Model) -> DataFrame:
    """(path, blob_sha, model, version, ord, start, end, embedding) of files with content.

    Calls may cost money: write the result before using it twice. A file without
    chunks gives one row with a null ord, so that it counts as indexed.
    """
    def run(batches):
        for b in slices(batches):
            rows = []
            for path, sha, data, grammar, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # the structure of a file is read once, and only if it has a second window
                crumbs = cache(lambda data=data, path=path, grammar=grammar: Crumbs(data or b"", path, grammar))
                spans = prepare(data or b"", model, lambda at, crumbs=crumbs: crumbs().at(at), path, mark)
                rows += [(path, sha, model.name, 10, i, s, e, v) for i, (s, e, v) in enumerate(spans)] or [(path, sha, model.name, 10, None, None, None, None)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32())]
            names = ["path", "blob_sha", "model", "version", "ord", "start", "end", "embedding"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names)

    asked = files.select("path", "blob_sha", files["content"].cast("binary").alias("content"), routing.grammar(files["path"]).alias("grammar"), routing.comment_mark(files["path"]).alias("comment"))
    return asked.mapInArrow(run, "path string, blob_sha string, model string, version long, ord long, start long, end long, embedding array<float>")
