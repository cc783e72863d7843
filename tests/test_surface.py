"""Settings, tool server, command line, provider replies, hidden names."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cairnmill import __main__ as cli
from cairnmill import server, settings
from cairnmill.api import Config, Project
from cairnmill.sources import markdown
from cairnmill.sources.providers import HashedEmbedder, HttpEmbedder, Unavailable, context_length, discover, supporting


def test_settings_round_trip(tmp_path):
    assert settings.load(str(tmp_path)) is None
    s = settings.Settings(settings.Embedding("batch", 'mo"del', "http://x/é", 384, 2), settings.Extraction("batch", "m", "http://y"), 128)
    settings.save(str(tmp_path), s)
    assert settings.load(str(tmp_path)) == s
    settings.save(str(tmp_path), settings.Settings(settings.Embedding()))
    assert settings.load(str(tmp_path)).extraction is None and settings.load(str(tmp_path)).config().extractor is None
    settings.path(str(tmp_path)).write_text("strange = 1\n")
    with pytest.raises(ValueError, match="strange"):
        settings.load(str(tmp_path))


def test_cli(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("CAIRNMILL_HOME", str(tmp_path / "home"))
    assert cli.main(["create", "p", str(tmp_path)]) == 0 and cli.projects() == {"p": str(tmp_path)}
    assert cli.main(["config", "show", "p"]) == 0 and capsys.readouterr().out == "not configured\n"
    assert cli.main(["config", "set-embedding", "p", "offline", "hashed", "", "32"]) == 0
    assert cli.main(["config", "set-extraction", "p", "offline", "rules"]) == 0
    assert cli.main(["config", "show", "p"]) == 0
    assert "dimension = 32" in capsys.readouterr().out and settings.load(str(tmp_path)).config().embedder.dimension == 32
    assert cli.main(["config", "set-embedding", "q", "offline", "x"]) == 2 and cli.main([]) == 2
    cli.registry_file().write_text("{broken")
    assert cli.projects() == {}


def test_tools(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("---\nid: A\nkind: task\ndepends_on: [B]\n---\n\n# Rescan nightly\n")
    p = Project(spark, str(tmp_path / "state"), Config(embedder=HashedEmbedder(16), embed_partitions=1))
    p.sync(str(root))
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        ask(1, "initialize"), ask(2, "tools/list"), ask(3, "tools/call", name="query_by_concept", arguments={"concept": "a"}), ask(4, "tools/call", name="query_by_concept", arguments={"concept": "zzz"}),
        ask(5, "tools/call", name="get_related_entities", arguments={"entity_id": "x"}), ask(6, "tools/call", name="search_hybrid", arguments={"query": "rescan", "top_k": "two"}), "not json", ask(7, "nonsense"),
        json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(8, "tools/call", name="query_ontological", arguments={"question": "seeded canonical type: depends_on of A B?"}), ask(9, "tools/call", name="get_ontology_schema"),
    ]
    out = io.StringIO()
    server.serve(p, io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {g["id"]: g for g in got}
    assert len(got) == 10 and len(by[2]["result"]["tools"]) == 6
    assert json.loads(by[3]["result"]["content"][0]["text"])["entity"]["canonical_name"] == "A"
    assert by[4]["result"]["isError"] and by[5]["error"]["code"] == -32602 and by[6]["error"]["code"] == -32602 and by[7]["error"]["code"] == -32601 and by[None]["error"]["code"] == -32700
    assert json.loads(by[9]["result"]["content"][0]["text"])["entity_types"]["total"] >= 2


@pytest.fixture
def backend():
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def _send(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_GET(self):
            self._send({"models": [{"name": "e"}, {"name": "c"}]})

        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/show":
                self._send({"capabilities": ["embedding"] if given["model"] == "e" else ["completion"], "parameters": "num_ctx   256\nx 1" if given["model"] == "e" else "", "model_info": {"arch.context_length": 4096}})
            elif self.path == "/single":
                self._send([{"embedding": [[1.0, len(given["content"])]]}])
            elif self.path == "/batch":
                self._send({"embeddings": [[1.0, float(len(t))] for t in given["input"]]})
            else:
                self._send(b"<html>")

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_backends(backend):
    models = discover(backend)
    assert [m["name"] for m in supporting(models, "embedding")] == ["e"] and [m["name"] for m in supporting(models, "completion")] == ["c"]
    assert {m["name"]: m["context"] for m in models} == {"e": 256, "c": 4096} and context_length({}) is None
    for shape in ("batch", "single"):
        e = HttpEmbedder(f"{backend}/{shape}", "m", shape=shape)
        assert e.dimension == 2 and [v.tolist() for v in e.embed(["a", "bcd"])] == [[1.0, 1.0], [1.0, 3.0]]
    with pytest.raises(Unavailable):
        HttpEmbedder(f"{backend}/other", "m")
    with pytest.raises(Unavailable):
        discover("http://127.0.0.1:9")


def test_hidden_names_are_not_read(spark, tmp_path):
    """Spark's file index leaves out files and folders that begin with _ or a dot."""
    for name in ("a.md", "_b.md", ".d.md", "_posts/c.md", "x/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# x\n")
    assert {r["file_path"][len(str(tmp_path)) + 1 :] for r in markdown.read(spark, str(tmp_path)).collect()} == {"a.md", "x/e.md"}
