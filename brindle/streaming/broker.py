"""An HTTP front of the queue: notifications of a time window share one swap, and are answered once it is written."""

from __future__ import annotations

import json
import queue as queues
import threading
import time
from concurrent.futures import Future
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .queue import Queue

#: Seconds that a group waits for others.
WINDOW = 0.05


def _group(waiting: queues.Queue, queue: Queue, window: float) -> None:
    while True:
        group, until = [waiting.get()], time.monotonic() + window
        while (left := until - time.monotonic()) > 0:
            try:
                group.append(waiting.get(timeout=left))
            except queues.Empty:
                break
        wanted: dict[str, int] = {}
        for namespace, up_to, _ in group:
            wanted[namespace] = max(up_to, wanted.get(namespace, up_to))
        try:
            queue.enqueue_all(wanted)
        except Exception as e:  # each caller learns of it
            for _, _, done in group:
                done.set_exception(e)
        else:
            for _, _, done in group:
                done.set_result(None)


def broker(queue: Queue, port: int = 8081, window: float = WINDOW) -> ThreadingHTTPServer:
    """``POST /v1/enqueue`` {namespace, requestedUpTo}, ``GET /v1/queue``, ``GET /healthz``."""
    waiting: queues.Queue = queues.Queue()
    threading.Thread(target=_group, args=(waiting, queue, window), daemon=True).start()

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self._say(200, {"status": "ok"})
            elif self.path == "/v1/queue":
                try:
                    jobs = queue.jobs()
                    self._say(200, {"count": len(jobs), "jobs": jobs})
                except Exception as e:  # the request fails, the broker stays
                    self._say(500, {"error": str(e)[:500]})
            else:
                self._say(404, {"error": "no such path"})

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/v1/enqueue":
                return self._say(404, {"error": "no such path"})
            try:
                body = json.loads(raw)
                namespace, up_to = body["namespace"], int(body.get("requestedUpTo", 0))
                if not isinstance(namespace, str) or not namespace:
                    raise ValueError("namespace is not set")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return self._say(400, {"error": str(e)})
            done: Future = Future()
            waiting.put((namespace, up_to, done))
            try:
                done.result()
            except Exception as e:  # the request fails, the broker stays
                return self._say(500, {"error": str(e)[:500]})
            return self._say(200, {"namespace": namespace, "queued": True})

        def log_message(self, *args: object) -> None:
            """Quiet."""

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
