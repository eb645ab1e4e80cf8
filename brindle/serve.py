"""A small HTTP front: query, info, stats and health of namespaces."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .plans.namespace import Namespace, QueryError
from .sources.documents import results_json
from .sources.store import NotFound


def server(spark: SparkSession, store, data: str, port: int = 8080) -> ThreadingHTTPServer:
    stats = {"queries": 0, "seconds": 0.0}

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: object) -> None:
            raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _answer(self, act) -> None:
            try:
                self._say(200, act())
            except NotFound as e:
                self._say(404, {"error": f"no namespace {e}"})
            except (QueryError, ValueError, KeyError) as e:
                self._say(400, {"error": str(e)})
            except Exception as e:  # the request fails, the server stays
                self._say(500, {"error": str(e)[:500]})

        def do_GET(self) -> None:
            parts = self.path.strip("/").split("/")
            if parts == ["healthz"]:
                self._say(200, {"status": "ok"})
            elif parts == ["stats"]:
                self._say(200, stats)
            elif len(parts) == 4 and parts[:2] == ["v1", "namespaces"] and parts[3] == "info":
                self._answer(Namespace(spark, store, data, parts[2]).info)
            else:
                self._say(404, {"error": "no such path"})

        def do_POST(self) -> None:
            parts = self.path.strip("/").split("/")
            if len(parts) != 4 or parts[:2] != ["v1", "namespaces"] or parts[3] != "query":
                return self._say(404, {"error": "no such path"})
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def act() -> str:
                began, q = time.time(), json.loads(raw)
                ns = Namespace(spark, store, data, parts[2])
                out = results_json(ns.query(q.get("vector"), q.get("bm25"), q.get("topK", 0), q.get("filter"), q.get("approx", False), q.get("nProbe", 0)))
                stats["queries"] += 1
                stats["seconds"] += time.time() - began
                return out

            return self._answer(act)

        def log_message(self, *args: object) -> None:
            """Quiet."""

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
