import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spanforge.operators.embed import BATCH_BYTES, HttpModel, TokenLimitError


@pytest.fixture
def service():
    """(url, requests): a local service whose vectors hold the length of their text."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked, self.headers.get("Authorization")))
            vector = lambda t: [float(len(t))] * asked["output_dimension"]
            status, answer = 200, None
            if asked.get("enable_auto_chunking"):
                parts = asked["inputs"][0][0].split("\n\n")
                if parts[0] == "long":
                    status, answer = 400, {"detail": "too many Tokens"}
                else:
                    answer = {"data": [{"data": [{"embedding": vector(p), "index": i, "text": p} for i, p in reversed(list(enumerate(parts)))]}]}
            elif "inputs" in asked:
                answer = {"data": [{"data": [{"embedding": vector(t), "index": 0} for t in g]} for g in asked["inputs"]]}
            else:
                answer = {"data": [{"embedding": vector(t)} for t in asked["input"]]}
            body = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_contextual_model(service, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    url, seen = service
    m = HttpModel("voyage-context-3", 2, url + "/", "SOME_KEY")
    assert m.contextual and m.embed_query("abc") == [3.0, 3.0]
    assert m.embed_document("a\n\nbcd") == [("a", [1.0, 1.0]), ("bcd", [3.0, 3.0])]
    with pytest.raises(TokenLimitError):
        m.embed_document("long")
    assert {p for p, _, _ in seen} == {"/v1/contextualizedembeddings"} and seen[0][1]["input_type"] == "query" and seen[0][2] == "Bearer k"


def test_chunks_go_in_batches(service):
    url, seen = service
    texts = ["x" * (2 * BATCH_BYTES // 3)] * 3
    assert [v[0] for v in HttpModel("voyage-context-3", 1, url, "NO_SUCH_KEY").embed_chunks(texts)] == [float(len(texts[0]))] * 3
    assert len(seen) == 3 and seen[0][2] is None


def test_plain_model(service):
    url, seen = service
    m = HttpModel("other-model", 1, url, "NO_SUCH_KEY")
    assert m.embed_query("ab") == [2.0] and m.embed_chunks(["a", "abc"]) == [[1.0], [3.0]]
    assert {p for p, _, _ in seen} == {"/v1/embeddings"}
    with pytest.raises(TypeError):
        m.embed_document("ab")
