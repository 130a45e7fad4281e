"""A judgment server on the loopback address, for tests, benchmarks and demonstrations.

It counts requests and answers by rules that SQL can restate: see ``answer``.
"""

from __future__ import annotations

import contextlib
import json
import socket
import socketserver
import threading
import time
from collections.abc import Callable
from http.client import responses

MODEL = "loopback-1"


def state_text(state: object) -> str:
    return state if isinstance(state, str) else json.dumps(state, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def answer(question: dict, state: object) -> dict:
    """By type. noul: 0.1 if the state's text starts with 'reject', else 0.9; with instructions 'even', 0.9 for even lengths, else 0.1.

    choice: option i of the sorted labels has weight 1 + (length + i) modulo 4,
    and the first of the heaviest wins. score: the length modulo the levels.
    """
    text, kind = state_text(state), question["type"]
    if kind == "noul":
        if question["instructions"] == "even":
            return {"type": kind, "noul": 0.9 if len(text) % 2 == 0 else 0.1}
        return {"type": kind, "noul": 0.1 if text.startswith("reject") else 0.9}
    if kind == "choice":
        labels = sorted(question["criteria"])
        weights = [1 + (len(text) + i) % 4 for i in range(len(labels))]
        chances = [w / sum(weights) for w in weights]
        best = chances.index(max(chances))
        return {"type": kind, "choice": labels[best], "confidence": chances[best], "probabilities": dict(zip(labels, chances, strict=True))}
    levels = len(question["criteria"])
    at = len(text) % levels
    return {"type": kind, "score": float(at), "confidence": 0.5, "probabilities": {str(i): 0.5 if i == at else 0.5 / max(1, levels - 1) for i in range(levels)}}


def respond(request: dict) -> dict:
    answers = {k: answer(q, request["state"]) for k, q in request["questions"].items()}
    return {"model": request["model"], "answers": answers, "usage": {"input_tokens": 10, "output_tokens": 2}}


class Loopback:
    """``with Loopback() as server``: ``server.url``, ``server.bodies`` (bytes of each request), ``server.peak`` (most in flight).

    ``script`` may return (status, headers, body bytes) for a request, or None for the usual answer. Without ``keep``
    requests are only counted: a server that millions of rows ask then holds none of them.
    """

    def __init__(self, script: Callable[[int, bytes], tuple[int, dict, bytes] | None] | None = None, delay: float = 0.0, keep: bool = True) -> None:
        self.bodies: list[bytes] = []
        self.headers: list[dict] = []
        self.paths: list[str] = []
        self.requests = self.peak = self._now = self.connections = 0
        self._sockets: set[socket.socket] = set()
        self._lock = threading.Lock()
        outer = self

        class Handler(socketserver.StreamRequestHandler):
            """HTTP/1.1 of the least kind: the standard library's handler takes most of a request's time to parse and write headers."""

            disable_nagle_algorithm = True

            def setup(self) -> None:
                super().setup()
                with outer._lock:
                    outer.connections += 1
                    outer._sockets.add(self.connection)

            def finish(self) -> None:
                with outer._lock:
                    outer._sockets.discard(self.connection)
                try:
                    super().finish()
                except OSError:
                    pass

            def handle(self) -> None:
                with contextlib.suppress(OSError):
                    while line := self.rfile.readline():
                        headers = {}
                        while (field := self.rfile.readline()) not in (b"\r\n", b""):
                            name, _, value = field.decode("latin-1").partition(":")
                            headers[name] = value.strip()
                        self.reply(line.split()[1].decode("latin-1"), headers)

            def reply(self, path: str, headers: dict) -> None:
                body = self.rfile.read(int(headers["Content-Length"]))
                with outer._lock:
                    n = outer.requests
                    outer.requests += 1
                    if keep:
                        outer.bodies.append(body)
                        outer.headers.append(headers)
                        outer.paths.append(path)
                    outer._now += 1
                    outer.peak = max(outer.peak, outer._now)
                try:
                    if delay:
                        time.sleep(delay)
                    made = script(n, body) if script else None
                    status, more, reply = made or (200, {}, json.dumps(respond(json.loads(body)), ensure_ascii=False).encode())
                    if "Transfer-Encoding" in more:
                        reply = b"".join(b"%x\r\n%b\r\n" % (len(reply[i : i + 4096]), reply[i : i + 4096]) for i in range(0, len(reply), 4096)) + b"0\r\n\r\n"
                    else:
                        more = more | {"Content-Length": len(reply)}
                    head = "".join(f"{k}: {v}\r\n" for k, v in more.items())
                    self.wfile.write(f"HTTP/1.1 {status} {responses.get(status, '')}\r\n{head}\r\n".encode("latin-1") + reply)
                finally:
                    with outer._lock:
                        outer._now -= 1

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads = True
            allow_reuse_address = True
            request_queue_size = 256

        self.server = Server(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def reset(self) -> None:
        with self._lock:
            self.bodies.clear(), self.headers.clear(), self.paths.clear()
            self.peak, self.requests = self._now, 0

    def drop_connections(self) -> None:
        """Close all open connections, as a server does with idle ones."""
        with self._lock:
            for s in self._sockets:
                with contextlib.suppress(OSError):
                    s.shutdown(socket.SHUT_RDWR)

    def __enter__(self) -> Loopback:
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.drop_connections()
        self.server.server_close()
