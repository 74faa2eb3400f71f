"""A small HTTP surface over a trained service: POST /recommend, GET /health. Standard library only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from matchloom.operators.service import Service


def reply(service: Service, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and answer to a request; ``{"requests": [...], "n": 5}``, or one request by itself."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "targets": service.profiles.count()}
    if (method, path) != ("POST", "/recommend"):
        return 404, {"error": f"no {method} {path}"}
    try:
        asked = json.loads(body or b"{}")
        n = asked.pop("n", None)
        wanted = asked.get("requests", [asked] if asked else [])
        if not wanted:
            raise ValueError("no request")
        return 200, {"recommendations": service.answer(wanted, n)}
    except (ValueError, TypeError, AttributeError) as e:
        return 400, {"error": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server bound to an address; the caller runs ``serve_forever`` and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = reply(service, self.command, self.path, self.rfile.read(size))
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
