"""The command line and the stream, from files to a store and back."""

import json

from quillstrata import cli
from quillstrata.sources.store import Store
from quillstrata.streaming.imports import follow

LINES = [
    {"type": "project", "uuid": "p1", "origin_host": "h", "name": "alpha", "description": "d", "status": "active", "created_at": "2024-01-01T00:00:00Z"},
    {"type": "observation", "uuid": "o1", "origin_host": "h", "project_uuid": "p1", "kind": "note", "body": "glacier seen", "source_doi": "", "created_at": "2024-01-02T00:00:00Z"},
]


def test_stream_and_commands(spark, tmp_path, capsys):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.jsonl").write_text("\n".join(map(json.dumps, LINES)) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    follow(spark, str(inbox), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.version() == 1 and store.read().observations.count() == 1
    (inbox / "b.jsonl").write_text(json.dumps(LINES[0]) + "\n")
    follow(spark, str(inbox), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert store.version() == 2 and store.read().projects.count() == 1

    def run(*argv):
        code = cli.main(["--store", store.path, *argv])
        return code, capsys.readouterr()

    assert run("summary")[1].out.startswith("  [1] alpha  (active)")
    assert "glacier seen" in run("search", "glacier")[1].out
    code, said = run("observations", "nothing")
    assert code == 1 and said.out == "" and "nothing" in said.err
    assert run("search", '"')[0] == 1
    out = str(tmp_path / "out")
    assert run("export", out)[1].out == "2\n"
    assert cli.main(["--store", str(tmp_path / "other"), "import", out]) == 0
    assert Store(spark, str(tmp_path / "other")).read().projects.count() == 1


def test_writing_commands(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main(["--store", str(tmp_path / "store"), *argv])
        return code, capsys.readouterr()

    assert run("project-add", "alpha", "--description", "first") == (0, ("1\n", ""))
    assert run("observation-add", "alpha", "note", "glacier seen", "--doi", "10.1/x")[1].out == "2\n"
    assert run("concept-add", "ice")[0] == run("link-concept", "alpha", "ice")[0] == run("link-observation", "1", "ice")[0] == 0
    assert run("source-add", "a page")[0] == run("link-source", "1", "1")[0] == run("source-retract", "1", "wrong")[0] == 0
    assert run("project-set-status", "alpha", "paused")[0] == 0
    for refused in (("project-set-status", "alpha", "odd"), ("observation-add", "beta", "note", "b"), ("observation-add", "alpha", "odd", "b"), ("source-remove", "1"), ("link-concept", "alpha", "none")):
        assert run(*refused)[0] == 1
    s = Store(spark, str(tmp_path / "store")).read()
    assert [(r.name, r.status, r.description, len(r.uuid)) for r in s.projects.collect()] == [("alpha", "paused", "first", 36)]
    assert s.observation_sources.collect() == [(1, 1, "cited")] and s.sources.first().retracted and s.project_concepts.collect() == s.observation_concepts.collect() == [(1, 1)]


def test_trace(tmp_path):
    from quillstrata.trace import Trace

    trace = Trace(str(tmp_path / "trace.jsonl"))
    assert trace.traced(max)(1, 2) == 2
    try:
        trace.traced(int)("x")
    except ValueError:
        pass
    first, second = map(json.loads, (tmp_path / "trace.jsonl").read_text().splitlines())
    assert first["method"] == "max" and first["result"] == 2 and "error" in second and first["duration_ms"] >= 0


def test_checker_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quillstrata.operators.retracting import http_checker

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            body = b'[{"Reason": "Error", "RetractionDate": "2024"}, {"Reason": "later"}]' if "10.1%2Fa" in self.path else b"[]"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    check = http_checker(f"http://127.0.0.1:{server.server_port}")
    assert check("10.1/a") == (True, "Error (2024)") and check("10.1/b") == (False, "")
    server.shutdown()
