"""The engine over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from .engine import Engine
from .errors import BadRequest, SessionNotFound, TesseraError

FORMATS = ("json", "jsonl", "prompt", "mongodb", "llm")


def field(body: dict, name: str, kind: type, default=None, low: float | None = None, high: float | None = None):
    value = body.get(name, default)
    if value is None and default is None:
        raise BadRequest(f"{name} is missing")
    if not isinstance(value, kind) or (low is not None and not low <= value <= high):
        raise BadRequest(f"{name} is out of range")
    return value


def formatted(made, kind: str):
    return {"json": lambda: made.to_dict(), "jsonl": lambda: made.to_jsonl(), "prompt": lambda: made.to_prompt(), "mongodb": lambda: made.to_mongodb(), "llm": lambda: made.to_llm()}[kind]()


def answer(engine: Engine, method: str, path: str, body: dict):
    """What a request gets; errors are raised."""
    parts = [unquote(p) for p in path.split("?")[0].strip("/").split("/") if p]
    route = (method, *parts)
    kind = body.get("format", "json")
    if kind not in FORMATS:
        raise BadRequest(f"formats are {FORMATS}")
    if body.get("preset"):
        engine = engine.with_preset(field(body, "preset", str))
    if route == ("POST", "mcp"):
        return mcp(engine, body)
    if route in (("GET",), ("GET", "health")):
        return {"status": "ok", "sessions": len(engine.list_sessions())}
    if route == ("GET", "sessions"):
        return {"sessions": engine.list_sessions()}
    if len(parts) == 3 and route[:2] == ("GET", "sessions") and parts[2] == "stale":
        return {"session": parts[1], "stale": engine.is_stale(parts[1])}
    if len(parts) == 2 and route[:2] == ("DELETE", "sessions"):
        engine.delete_session(parts[1])
        return {"deleted": parts[1]}
    if route == ("POST", "search"):
        made = engine.search(field(body, "query", str), field(body, "session", str, "default"), field(body, "force_new", bool, False), field(body, "results", int, 12, 1, 50))
        return formatted(made, kind)
    if route == ("POST", "search", "parallel"):
        return {"results": [r.to_dict() for r in engine.parallel_search(field(body, "plan", list))]}
    if route == ("POST", "search", "sequential"):
        return {"results": [r.to_dict() for r in engine.sequential_search(field(body, "steps", list))]}
    if route == ("POST", "search", "verify"):
        return engine.verify(field(body, "query", str), field(body, "session", str, "default")).to_dict()
    if route == ("POST", "query"):
        asked, session, k = field(body, "query", str), field(body, "session", str), field(body, "k", int, 5, 1, 50)
        return {"chunks": engine.query(asked, session, k)} if kind == "json" else formatted(engine.answer(asked, session, k), kind)
    if route == ("POST", "context"):
        made = engine.build_context(field(body, "query", str), field(body, "session", str), field(body, "k", int, 10, 1, 50), body.get("token_budget"))
        return formatted(made, kind if kind != "llm" else "prompt")
    if route == ("POST", "ingest"):
        return engine.ingest(field(body, "source", str), field(body, "session", str), field(body, "force_new", bool, False), **{k: body[k] for k in ("table", "query") if body.get(k)})
    raise SessionNotFound("/".join(parts)) if parts[:1] == ["sessions"] else BadRequest("no such endpoint")


#: Tools of the JSON-RPC endpoint: what they do, and their arguments.
TOOLS = {
    "search": ("Find, fetch and index pages for a query", ("query", "session")),
    "query": ("The best chunks of a session for a question, for a language model", ("query", "session")),
    "context": ("A token-budgeted context of a session for a question", ("query", "session")),
    "sessions": ("The sessions that are stored", ()),
}


def mcp(engine: Engine, body: dict) -> dict:
    """Model Context Protocol over JSON-RPC: initialize, tools/list and tools/call."""
    method, params = body.get("method"), body.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": body.get("id")}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}}
    if method == "tools/list":
        schema = lambda names: {"type": "object", "properties": {n: {"type": "string"} for n in names}, "required": list(names)}
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": schema(a)} for n, (d, a) in TOOLS.items()]}}
    if method != "tools/call" or params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32601, "message": "no such method or tool"}}
    name, own = params["name"], params.get("arguments") or {}
    try:
        asked = [field(own, a, str) for a in TOOLS[name][1]]
        made = {"search": lambda: engine.search(*asked).to_json(), "query": lambda: engine.llm_context(*asked), "context": lambda: engine.build_context(*asked).to_prompt(), "sessions": lambda: "\n".join(engine.list_sessions())}[name]()
        return reply | {"result": {"content": [{"type": "text", "text": made}], "isError": False}}
    except TesseraError as e:
        return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}


def make_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    lock = threading.Lock()  # one request changes the tables at a time

    class Handler(BaseHTTPRequestHandler):
        def _serve(self):
            status = 200
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size)) if size else {}
                with lock:
                    found = answer(engine, self.command, self.path, body)
            except SessionNotFound as e:
                status, found = 404, e.to_dict()
            except TesseraError as e:
                status, found = (422 if e.code in ("request", "config", "format", "ingest") else 500), e.to_dict()
            except ValueError as e:
                status, found = 422, {"error": str(e)}
            data = (found if isinstance(found, str) else json.dumps(found, default=str, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if isinstance(found, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _serve

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
