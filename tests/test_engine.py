"""The facade end to end over a table of pages, the command line, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, errors
from tessera.config import Config
from tessera.engine import Engine
from tessera.operators import state as ST
from tessera.streaming import telemetry as TS

BODY = "<p>Decorators wrap functions with " + " ".join(f"{w}{{i}}" for w in "alpha beta gamma delta river stone cloud paper".split()) + " and then return another function.</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"https://site{i}.org/{i}", f"<html><head><title>Python decorators guide {i}</title><meta name='date' content='2024-0{1 + i % 3}-01'></head><body>" + "".join(BODY.format(i=i * 100 + j) for j in range(12)) + "</body></html>") for i in range(5)]
    return spark.createDataFrame(rows, "url string, html string")


@pytest.fixture(scope="module")
def engine(spark, pages, tmp_path_factory):
    ticks = iter(range(1_750_000_000, 1_760_000_000))
    return Engine(spark, Config(path=str(tmp_path_factory.mktemp("db")), semantic_threshold=-1.0), pages=pages, clock=lambda: next(ticks))


def test_search_and_read(engine):
    r = engine.search("python decorators guide", "s")
    assert r.success and r.topic == "tech" and r.indexed_count > 0 and r.doc_count == 5, r.reason
    assert "total=" in r.trace.summary() and json.loads(r.to_json())["session"] == "s" and r.to_mongodb()["_id"].startswith("s:python")
    assert engine.list_sessions() == ["s"] and engine.reputation().count() == 5
    found = engine.query("decorators wrap functions", "s", 3)
    assert 0 < len(found) <= 3 and "function" in found[0]["content"]
    context = engine.build_context("decorators wrap functions", "s", token_budget=3000)
    assert context.total_tokens <= 3000 and context.chunks and "[Source:" in context.to_prompt() and context.to_jsonl() and context.to_json() and context.to_mongodb("s")
    assert engine.llm_context("decorators wrap functions", "s").startswith("[RETRIEVAL CONTEXT]\nquestion: decorators")
    assert not engine.is_stale("s", 1e9) and engine.is_stale("none")
    with pytest.raises(errors.SessionNotFound):
        engine.query("x", "none")


def test_http(engine):
    import threading
    import urllib.error
    import urllib.request

    from tessera.server import make_server

    server = make_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body else None, method=method)
        try:
            with urllib.request.urlopen(request) as found:
                return found.status, found.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert ask("GET", "/health")[0] == 200 and "s" in json.loads(ask("GET", "/sessions")[1])["sessions"]
        for kind in ("json", "jsonl", "prompt", "mongodb"):
            assert ask("POST", "/context", {"query": "decorators", "session": "s", "format": kind})[0] == 200
        told = json.loads(ask("POST", "/query", {"query": "decorators", "session": "s", "format": "llm", "preset": "fast"})[1])
        assert told["retrieved_chunks"] == len(told["context"]) > 0 and told["topic"] and "total=" in told["timing"] and told["conflicts"] == [] and told["prompt_ready"].startswith("[RETRIEVAL CONTEXT]")
        assert [t["name"] for t in json.loads(ask("POST", "/mcp", {"id": 1, "method": "tools/list"})[1])["result"]["tools"]] == ["search", "query", "context", "sessions"]
        called = json.loads(ask("POST", "/mcp", {"id": 2, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "decorators", "session": "s"}}})[1])
        assert called["id"] == 2 and called["result"]["content"][0]["text"].startswith("[RETRIEVAL CONTEXT]") and json.loads(ask("POST", "/mcp", {"id": 3, "method": "other"})[1])["error"]
        assert ask("POST", "/query", {"query": "x", "session": "none"})[0] == 404 and ask("POST", "/query", {"query": "x", "session": "s", "k": 99})[0] == 422 and ask("POST", "/nothing", {"a": 1})[0] == 422
    finally:
        server.shutdown()


def test_verify(engine):
    r = engine.verify("python decorators guide", "v")
    assert r.status == "conflict" and r.conflicts
    engine.delete_session("v")
    assert "v" not in engine.list_sessions()


def test_parallel(engine):
    found = engine.parallel_search([{"query": "python decorators guide", "session": "p1"}, {"query": "python decorators guide", "session": "p2"}, {"query": "zzzzzzzz qqqqqqqq", "session": "p3"}])
    assert [(r.session, r.success) for r in found] == [("p1", True), ("p2", True), ("p3", False)] and found[2].reason == "no_docs"
    assert {"p1", "p2"} <= set(engine.list_sessions())
    for s in ("p1", "p2"):
        engine.delete_session(s)


def test_prompts():
    from tessera.result import Result

    r = Result(query="q", chunks=[{"title": "T", "source": "u", "content": "c" * 700}, {"content": "x", "score": 0.12345}])
    assert r.to_prompt() == f"[1] T\nSource: u\n{'c' * 600}\n\n[2] \nSource: \nx" and not r
    told = r.to_llm()
    assert told["context"][1] == {"index": 2, "source": "unknown", "confidence": 0.123, "text": "x"} and Result(query="q").to_llm()["prompt_ready"] == "[NO CONTEXT AVAILABLE]\nQuestion: q"


def test_nothing_found(engine):
    assert engine.search("zzzzzzzz qqqqqqqq", "n").reason == "no_docs"


def test_ingest(engine, tmp_path):
    (tmp_path / "a.txt").write_text("The quick brown fox jumps over the lazy dog near the river bank today. Later on another animal came along and drank from the cold water for a while.")
    assert engine.ingest(str(tmp_path / "a.txt"), "files")["indexed"] >= 1


def test_config():
    assert Config.preset("fast").max_results == 6
    for wrong in (lambda: Config.preset("other"), lambda: Config().with_(nothing=1), lambda: Config(max_results=0)):
        with pytest.raises(errors.TesseraError) as e:
            wrong()
        assert e.value.code == "config"


def test_cli(spark, pages, tmp_path, capsys):
    path = str(tmp_path / "pages")
    pages.write.parquet(path)
    base = ["--path", str(tmp_path / "db"), "--pages", path]
    assert cli.main([*base, "search", "python decorators guide", "--session", "c"], spark) == 0
    assert cli.main([*base, "sessions"], spark) == 0 and "c" in capsys.readouterr().out
    assert cli.main([*base, "inspect", "--show", "reputation"], spark) == 0
    assert cli.main([*base, "query", "x", "--session", "missing"], spark) == 1
    capsys.readouterr()
    assert cli.main([*base, "read", "1"], spark) == 0 and "Decorators wrap" in capsys.readouterr().out
    assert cli.main([*base, "read", "99"], spark) == 1
    note = tmp_path / "note.txt"
    note.write_text("A file may be read too, as long as its sentences are long enough to be kept by the chunker today.")
    capsys.readouterr()
    assert cli.main([*base, "read", str(note), "--raw"], spark) == 0 and capsys.readouterr().out.startswith("A file may be read")
    assert cli.main([*base, "query", "decorators", "--session", "c", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["content"]
    assert cli.main([*base, "query", "decorators", "--session", "c", "--scores"], spark) == 0 and capsys.readouterr().out.startswith("#")
    assert cli.main([*base, "inspect", "--show", "candidates"], spark) == 0


def test_render():
    assert cli.render_table("a | b\n---|---\n1 | 2").split("\n") == ["a  b", "-  -", "1  2"]
    assert cli.render_paragraphs("x" * 70 + "\n\nshort") == "x" * 70
    assert cli.render_paragraphs("Home\nAbout\nContact us\nMore of the menu that is long enough to count\nEnd\n\n" + "y" * 70) == "y" * 70
    chunks = [{"content": "One paragraph that is long enough to be shown to a reader.", "coherence_score": c} for c in (0.1, 0.9, 0.9)] + [{"content": "a\nb\nc", "coherence_score": 1.0}]
    assert cli.unrepeated(chunks) == ["One paragraph that is long enough to be shown to a reader."]


def _stream(spark, rows, schema, path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(path))


def test_stream_equals_batch(spark, tmp_path):
    schema = "term string, topic string, confidence double, at double, seq long"
    rows = [[("a", "x", 0.9, float(i), i), ("b", "x", 0.2, float(i), i)] for i in range(4)]
    query = TS.lexicon_stream(_stream(spark, rows, schema, tmp_path / "in"), 0.0).writeStream.outputMode("update").format("memory").queryName("lexicon").start()
    query.processAllAvailable()
    query.stop()
    newest = {r["term"]: r["observations"] for r in spark.table("lexicon").groupBy("term").agg(F.max("observations").alias("observations")).collect()}
    batch = ST.observe_terms(spark.createDataFrame([r for p in rows for r in p], schema), order=("at", "seq"), explore=0.0)
    assert newest == {r["term"]: r["observations"] for r in batch.collect()} == {"a": 4, "b": 4}


def test_windows(spark, tmp_path):
    schema = "ts timestamp, domain string, latency double, failed boolean"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [[(day, "a", 1.0, False), (day + dt.timedelta(minutes=5), "a", 3.0, True)], [(day + dt.timedelta(hours=5), "a", 1.0, False)], [(day + dt.timedelta(hours=9), "a", 1.0, False)]]
    query = TS.windowed(_stream(spark, rows, schema, tmp_path / "in")).writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    first = spark.table("windows").orderBy("start").first()
    assert (first["fetches"], first["failures"], first["avg_latency"]) == (2, 1, 1.0)


def test_rolling_latency(spark, tmp_path):
    schema = "ts timestamp, domain string, latency double, failed boolean"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [[(day + dt.timedelta(seconds=10 * b + i), "a", float(10 * b + i), i == 3) for i in range(10)] for b in range(3)]
    query = TS.rolling_latency(_stream(spark, rows, schema, tmp_path / "in"), 5).writeStream.outputMode("update").format("memory").queryName("rolling").start()
    query.processAllAvailable()
    query.stop()
    assert (5, 27.0, 29.0) in {(r["n"], r["p50"], r["p95"]) for r in spark.table("rolling").collect()}


def test_expiry(spark, tmp_path):
    schema = "ts timestamp, session string"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [[(day, "a"), (day, "b")], [(day + dt.timedelta(hours=20), "b")], [(day + dt.timedelta(hours=30), "c")], [(day + dt.timedelta(hours=31), "c")]]
    query = TS.expired(_stream(spark, rows, schema, tmp_path / "in"), "session", 24).writeStream.outputMode("append").format("memory").queryName("expired").start()
    query.processAllAvailable()
    query.stop()
    assert {r["session"] for r in spark.table("expired").collect()} == {"a"}


def test_upserts(spark, tmp_path):
    schema = "term string, topic string, confidence double, at double, seq long"
    rows = [[(f"t{i}", "x", 0.9, float(b), b) for i in range(10) if (i + b) % 3] for b in range(4)]
    stream = TS.lexicon_stream(_stream(spark, rows, schema, tmp_path / "in"), 0.0)
    query = TS.upsert_each_batch(stream, str(tmp_path / "table"), ["term", "topic"], str(tmp_path / "mark"), 4).start()
    query.processAllAvailable()
    query.stop()
    got = {r["term"]: r["observations"] for r in TS.upserted(spark, str(tmp_path / "table")).collect()}
    assert got == {f"t{i}": sum(1 for b in range(4) if (i + b) % 3) for i in range(10)}
