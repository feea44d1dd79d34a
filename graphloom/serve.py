"""A small HTTP surface over an engine: stats, query, update, load, load-turtle, save and lineage, as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from graphloom.engine import Engine

GET = {"/api/stats": "stats", "/api/status": "status", "/api/lineage": "lineage"}
POST = {"/api/query": "query", "/api/update": "update", "/api/load": "load", "/api/load-turtle": "load", "/api/save": "save"}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server, not yet running; port 0 picks a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body: dict, code: int = 200) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def run(self, tool: str | None, args: dict) -> None:
            out = {"error": "not found"} if tool is None else engine.call(tool, **args)
            self.answer(out, 404 if tool is None else 400 if "error" in out else 200)

        def do_GET(self) -> None:
            self.run(GET.get(self.path), {})

        def do_POST(self) -> None:
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            except ValueError:
                self.answer({"error": "the body is no JSON"}, 400)
                return
            self.run(POST.get(self.path), args)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
