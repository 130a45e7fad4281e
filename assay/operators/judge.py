"""Judging a batch of rows: one request for each distinct question about each distinct state.

This runs in Python workers, as Arrow functions, and on the driver under a LIMIT.
"""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa

from assay.errors import FatalError, JudgmentError
from assay.functions import requests as rq
from assay.functions.canonical import bounded, canonical_text
from assay.functions.state import root_converter
from assay.operators.metrics import report
from assay.sources.provider import Provider

_MAP = pa.map_(pa.string(), pa.float64())
ARROW = {
    "noul": pa.float64(),
    "choice": pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("probabilities", _MAP)]),
    "score": pa.struct([("score", pa.float64()), ("confidence", pa.float64()), ("probabilities", _MAP)]),
    "ask": pa.string(),
}
_FAILED, SLICE = object(), 256


@dataclass(frozen=True)
class Settings:
    """What a query is planned with; it keeps it whatever is set afterwards."""

    on_error: str = "fail"
    model: str = ""
    cache_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        if self.on_error not in ("fail", "null"):
            raise ValueError("on_error must be fail or null")
        rq.check_model(self.model)


class Cache:
    """Replies of one batch by the hash of their request. Beyond its budget a query ends: it never pays twice instead.

    What a batch keeps only to save work (hashes of states, decoded replies) has
    a quarter of the budget besides, beyond which that work is done again.
    """

    ENTRY = 128

    def __init__(self, limit: int) -> None:
        self.replies: dict[bytes, Any] = {}
        self.left, self.spare = limit, limit // 4

    def spares(self, size: int) -> bool:
        """Whether there is room for ``size`` bytes that could be computed again; if so it is taken."""
        size += self.ENTRY
        if size > self.spare:
            return False
        self.spare -= size
        return True

    def reserve(self) -> None:
        """Room for one more key, before its request is paid for."""
        self.left -= self.ENTRY
        if self.left < 0:
            raise FatalError("the judgment cache's byte budget is exhausted")

    def put(self, key: bytes, reply: Any) -> None:
        if isinstance(reply, str):
            self.left -= len(reply.encode("utf-8"))
        self.replies[key] = reply
        if self.left < 0:
            raise FatalError("the judgment cache's byte budget is exhausted")


class Judge:
    """Turns rows of arguments into results for one function, provider and settings."""

    def __init__(self, function: str, provider: Provider, settings: Settings) -> None:
        self.function, self.provider, self.settings = function, provider, settings
        self._questions: dict[tuple, Any] = {}
        self._keys: dict[Any, bytes] = {}
        self._results: dict[bytes, Any] = {}

    def _asked(self, first: str | None, criteria: str | None) -> str:
        """The questions' canonical JSON. Literal arguments come once per row, so it is kept for the batch."""
        key = (first, criteria)
        if key not in self._questions:
            try:
                self._questions[key] = canonical_text(rq.questions_of(self.function, first, criteria), 1)
            except JudgmentError as e:
                self._questions[key] = e
        if isinstance(found := self._questions[key], JudgmentError):
            raise JudgmentError(*found.args)
        return found

    def _body(self, state: Any, first: str | None, criteria: str | None, model: str | None) -> bytes:
        """The request's canonical JSON."""
        text = canonical_text(state, 1)
        asked = self._asked(first, criteria)
        model = rq.check_model(self.settings.model if model is None else model)
        return bounded(f'{{"model":{canonical_text(model)},"questions":{asked},"state":{text}}}')

    def row(self, state: Any, convert: Callable[[Any], Any], first: str | None, criteria: str | None, model: str | None, cache: Cache, counts: Counter) -> Any:
        if state is None:
            return None
        # equal texts of a batch have their request's hash looked up
        known = (state, first, criteria, model) if type(state) is str else None
        key, body = self._keys.get(known), None
        if key is None:
            body = self._body(convert(state), first, criteria, model)
            key = hashlib.sha256(body).digest()
            if known and cache.spares(2 * len(state)):
                self._keys[known] = key
        if key in cache.replies:
            counts["cache_hits"] += 1
            if (reply := cache.replies[key]) is _FAILED:
                raise JudgmentError("cached judgment request failed")
        else:
            body = body or self._body(convert(state), first, criteria, model)
            cache.reserve()
            try:
                reply = self.provider.send(body, self.function, counts)
            except JudgmentError:
                cache.put(key, _FAILED)
                raise
            cache.put(key, reply)  # before it is read: a reply that doesn't fit one function may be another's answer
        if key in self._results:
            return self._results[key]
        result = rq.result_of(self.function, reply)
        if cache.spares(4 * len(reply)):
            self._results[key] = result
        return result

    def begin(self) -> None:
        """Forget what was kept for the batch before."""
        self._questions.clear(), self._keys.clear(), self._results.clear()

    def one(self, state: Any, convert: Callable[[Any], Any], first: str | None, criteria: str | None, model: str | None, cache: Cache, counts: Counter) -> Any:
        """A row's result, NULL for its error if the settings say so."""
        try:
            return self.row(state, convert, first, criteria, model, cache, counts)
        except JudgmentError as e:
            counts["failures"] += 1
            if self.settings.on_error == "fail":
                raise JudgmentError(*e.args) from None
            return None

    def batch(self, states: pa.Array, firsts: list, criteria: list, models: list, cache: Cache, counts: Counter) -> pa.Array:
        self.begin()
        convert, out = root_converter(states.type), []
        for i in range(len(states)):
            if i % SLICE == 0:
                values = states.slice(i, SLICE).to_pylist()
            out.append(self.one(values[i % SLICE], convert, firsts[i], criteria[i], models[i], cache, counts))
        return pa.array(out, ARROW[self.function])


def _texts(values: pa.Array | None, n: int) -> list:
    return [None] * n if values is None or pa.types.is_null(values.type) else values.to_pylist()


_shared: dict[str, tuple[int, Cache]] = {}


def shared_cache(task: str, turn: int, limit: int) -> Cache:
    """The cache of a task's batch number ``turn``. (A nested function would get a copy of ``_shared`` with its closure.)"""
    at, cache = _shared.get(task, (0, None))
    if at != turn or cache is None:
        _shared.clear()
        cache = Cache(limit)
        _shared[task] = turn, cache
    return cache


def arrow_function(function: str, provider: Provider, settings: Settings, query: str, address: tuple[str, int], site: str | None = None) -> Callable:
    """The Arrow function of one call site, whose counts are reported under ``site``.

    All sites of a plan node see the same batches in the same worker, one after
    the other, so sites at the same batch number share a cache; a new batch
    begins a new one.
    """
    judge, turn, task = Judge(function, provider, settings), [0], [""]

    def run(state: pa.Array, first: pa.Array, criteria: pa.Array | None, model: pa.Array | None) -> pa.Array:
        if not task[0]:
            from pyspark import TaskContext

            context = TaskContext.get()
            task[0] = f"{query}/{context.taskAttemptId() if context else 'driver'}"
        turn[0] += 1
        cache = shared_cache(task[0], turn[0], settings.cache_bytes)
        n, counts, began = len(state), Counter(), time.monotonic_ns()
        try:
            return judge.batch(state, _texts(first, n), _texts(criteria, n), _texts(model, n), cache, counts)
        finally:
            counts["elapsed_compute_nanos"] += time.monotonic_ns() - began
            report(address, query, site or function, counts)

    if function == "ask":

        def ask(state: pa.Array, questions: pa.Array, model: pa.Array = None) -> pa.Array:
            return run(state, questions, None, model)

        return ask
    if function == "noul":

        def noul(state: pa.Array, instructions: pa.Array, criteria: pa.Array = None, model: pa.Array = None) -> pa.Array:
            return run(state, instructions, criteria, model)

        return noul

    def typed(state: pa.Array, instructions: pa.Array, criteria: pa.Array, model: pa.Array = None) -> pa.Array:
        return run(state, instructions, criteria, model)

    typed.__name__ = function
    return typed
