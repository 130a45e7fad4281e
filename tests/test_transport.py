"""The provider against a loopback server."""

import threading
import time
from collections import Counter
from email.utils import format_datetime
from datetime import UTC, datetime, timedelta

import pytest

from assay.errors import FatalHttpError, HttpError, JudgmentError
from assay.sources.loopback import MODEL, Loopback
from assay.sources.provider import Provider, reported_nano, retry_after

BODY = b'{"model":"loopback-1","questions":{"q0":{"instructions":"x","type":"noul"}},"state":"s"}'


def direct(server, **more):
    return Provider.direct("key", server.url, MODEL, **more)


def test_request_and_price():
    with Loopback() as server:
        counts = Counter()
        text = direct(server).send(BODY, "noul", counts)
        assert '"noul": 0.9' in text and server.bodies == [BODY] and server.paths == ["/v1/systemone"]
        assert server.headers[0]["Authorization"] == "Bearer key" and server.headers[0]["Content-Type"] == "application/json"
        assert counts == {"requests": 1, "input_tokens": 10, "output_tokens": 2, "estimated_cost_nano_usd": 420}


@pytest.mark.parametrize("reply", [b"{}", b"not json", b'{"model":"other","usage":{"input_tokens":5}}'])
def test_unpriced(reply):
    with Loopback(lambda n, b: (200, {}, reply)) as server:
        counts = Counter()
        assert direct(server).send(BODY, "ask", counts).encode() == reply
        assert counts["unpriced_requests"] == 1 and counts["estimated_cost_nano_usd"] == 0


def test_reported_costs():
    with Loopback(lambda n, b: (200, {}, b'{"usage":{"input_tokens":7,"cost":0.000019992}}')) as server:
        for provider in (Provider.router("k", server.url + "/", "m"), Provider.compatible("k", server.url + "/any?x=1", "m")):
            counts = Counter()
            provider.send(BODY, "ask", counts)
            assert counts["estimated_cost_nano_usd"] == 19992
        assert server.paths == ["/api/alpha/decisions", "/any?x=1"]
    assert reported_nano(-1) is None and reported_nano("1") is None and reported_nano(True) is None


def test_retries_and_exhaustion():
    with Loopback(lambda n, b: (429, {"Retry-After": "0"}, b"") if n < 2 else None) as server:
        counts = Counter()
        direct(server).send(BODY, "noul", counts)
        assert (counts["requests"], counts["retries"]) == (3, 2)
    with Loopback(lambda n, b: (529, {}, b"")) as server:
        counts = Counter()
        with pytest.raises(HttpError, match="HTTP 529 for noul"):
            direct(server).send(BODY, "noul", counts)
        assert (counts["requests"], counts["retries"]) == (4, 3)
        with pytest.raises(HttpError):  # a router's other codes aren't retried
            Provider.router("k", server.url, "m").send(BODY, "noul", counts)
        assert counts["requests"] == 5


@pytest.mark.parametrize("status", [400, 500, 502, 302])
def test_other_statuses_are_row_errors_without_retry(status):
    with Loopback(lambda n, b: (status, {"Location": "/"}, b"secret")) as server:
        with pytest.raises(HttpError) as e:
            direct(server).send(BODY, "noul", Counter())
        assert server.requests == 1 and "secret" not in str(e.value)


def test_fatal_statuses():
    for status, make, fatal in ((401, Provider.direct, True), (422, Provider.direct, True), (402, Provider.direct, False), (402, Provider.router, True)):
        with Loopback(lambda n, b, s=status: (s, {}, b"")) as server:
            with pytest.raises(FatalHttpError if fatal else HttpError):
                make("k", server.url, "m").send(BODY, "noul", Counter())
            assert server.requests == 1


def test_retry_after_beyond_the_deadline():
    with Loopback(lambda n, b: (429, {"Retry-After": str(2**64 - 1)}, b"")) as server:
        began = time.monotonic()
        with pytest.raises(JudgmentError, match="Retry-After exceeds its 60 second"):
            direct(server).send(BODY, "noul", Counter())
        assert time.monotonic() - began < 2 and server.requests == 1


def test_retry_after_forms():
    later = format_datetime(datetime.now(UTC) + timedelta(seconds=30), usegmt=True)
    assert retry_after("7") == 7 and 25 < retry_after(later) <= 30
    assert retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0 and retry_after("soon") == 0 and retry_after(None) == 0


def test_body_limits():
    big = b"x" * (1 << 20)
    for reply, headers, good in ((big, {}, True), (big + b"x", {}, False), (big, {"Transfer-Encoding": "chunked"}, True), (big + b"x", {"Transfer-Encoding": "chunked"}, False)):
        with Loopback(lambda n, b, r=reply, h=headers: (200, h, r)) as server:
            if good:
                assert direct(server).send(BODY, "ask", Counter()).encode() == reply
            else:
                with pytest.raises(JudgmentError, match="byte JSON limit"):
                    direct(server).send(BODY, "ask", Counter())
    with Loopback(lambda n, b: (200, {}, b"\xff")) as server, pytest.raises(JudgmentError, match="UTF-8"):
        direct(server).send(BODY, "ask", Counter())


def test_deadline_and_dead_server():
    with Loopback(delay=2) as server:
        with pytest.raises(JudgmentError, match="deadline"):
            direct(server).with_deadline(0.3).send(BODY, "noul", Counter())
    with pytest.raises(JudgmentError, match="failed or timed out") as e:
        Provider.direct("key", "http://127.0.0.1:1", MODEL).send(BODY, "noul", Counter())
    assert "127.0.0.1" not in str(e.value)


def test_in_flight_cap_is_shared():
    with Loopback(delay=0.05) as server:
        providers = [direct(server), Provider.compatible("k", server.url, "m")]
        threads = [threading.Thread(target=providers[i % 2].send, args=(BODY, "noul", Counter())) for i in range(32)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert server.requests == 32 and 1 < server.peak <= 8


def test_nothing_shows_the_key():
    provider = Provider.direct("very-secret", "http://host", "m")
    assert "very-secret" not in repr(provider) and "host" not in repr(provider)
    assert Provider.direct("  ", "http://host/", "m").key is None
    assert Provider.direct("k", "http://host/", "m").endpoint == "http://host/v1/systemone"


def test_connections_are_kept_and_replaced():
    with Loopback() as server:
        provider = direct(server)
        for _ in range(5):
            provider.send(BODY, "noul", Counter())
        assert server.connections == 1
        server.drop_connections()
        counts = Counter()
        provider.send(BODY, "noul", counts)
        assert server.connections == 2 and counts["requests"] == 1 and server.requests == 6


def test_a_server_that_only_counts_keeps_no_request():
    with Loopback(keep=False) as server:
        counts = Counter()
        for _ in range(3):
            direct(server).send(BODY, "noul", counts)
        assert (server.requests, counts["requests"], counts["input_tokens"], server.peak) == (3, 3, 30, 1)
        assert server.bodies == server.headers == server.paths == []
        server.reset()
        assert server.requests == 0


def test_the_queries_server_keeps_no_request():
    from assay import queries

    before = queries.server().requests
    direct(queries.server()).send(BODY, "noul", Counter())
    assert queries.server().requests == before + 1 and queries.server().bodies == []
