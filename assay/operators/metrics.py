"""Counters of judgment calls, by query and call site.

Workers report to a collector on the driver after every batch, also when it
fails: Spark's accumulators lose the counts of tasks that end early, as tasks
under a LIMIT do, and those requests were paid for. A report that doesn't get
through is tried again, and then kept in the worker and sent with its next one,
which also says how many were late.
"""

from __future__ import annotations

import hmac
import json
import secrets
import socket
import socketserver
import sys
import threading
import time
from collections import Counter, defaultdict

# The counters by name.
FIELDS = ("requests", "retries", "cache_hits", "failures", "input_tokens", "output_tokens", "estimated_cost_nano_usd", "unpriced_requests")


TRIES, WAIT = 3, 0.2
Address = tuple[str, int, str]


class Collector:
    """``address``: host and port as workers reach them, and a token without which nothing is taken."""

    def __init__(self, host: str = "127.0.0.1") -> None:
        self.late = 0
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self._lock = threading.Lock()
        outer = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    said = json.loads(line)
                    if not hmac.compare_digest(said.get("token", ""), outer.address[2]):
                        return
                    for query, site, counts in said["reports"]:
                        outer.add(query, site, Counter(counts))
                    outer.late += len(said["reports"]) - 1
                    self.wfile.write(b"\n")

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads = True
            allow_reuse_address = True
            request_queue_size = 256

        self.server = Server((host, 0), Handler)
        self.address: Address = (host, self.server.server_address[1], secrets.token_hex(16))
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def add(self, query: str, site: str, counts: Counter) -> None:
        with self._lock:
            self.counts[query][site].update(counts)

    def sites(self, query: str) -> dict[str, dict[str, int]]:
        with self._lock:
            return {site: {k: c[k] for k in (*FIELDS, "elapsed_compute_nanos")} for site, c in sorted(self.counts[query].items())}

    def total(self, query: str) -> dict[str, int]:
        out: Counter = Counter()
        for counts in self.sites(query).values():
            out.update(counts)
        return {k: out[k] for k in (*FIELDS, "elapsed_compute_nanos")}

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


_kept: dict[Address, list] = defaultdict(list)


def report(address: Address, query: str, site: str, counts: Counter) -> None:
    """Send a batch's counts, and any that are late, and wait until they are taken. If that fails they stay for the next report."""
    _kept[address].append((query, site, counts))
    for turn in range(TRIES):
        try:
            with socket.create_connection(address[:2], timeout=5) as link:
                link.sendall(json.dumps({"token": address[2], "reports": _kept[address]}).encode() + b"\n")
                if link.recv(1) == b"\n":
                    del _kept[address]
                    return
        except OSError:
            pass
        if turn < TRIES - 1:
            time.sleep(WAIT * 2**turn)
    print(f"{len(_kept[address])} reports of judgment costs are late", file=sys.stderr)
