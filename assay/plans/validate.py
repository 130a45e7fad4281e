"""Checks of judgment calls before anything runs."""

from __future__ import annotations

import json
from typing import Any

from assay.errors import JudgmentError, PlanError
from assay.functions import requests as rq
from assay.functions.canonical import canonical
from assay.functions.state import root_text
from assay.plans.tree import Trees
from assay.sources.provider import Provider


def _literal(expr: Any) -> tuple[bool, Any]:
    """Whether an expression is constant, and its text or value."""
    if not expr.foldable():
        return False, None
    value = expr.eval(None)
    return True, None if value is None else value.toString() if hasattr(value, "toString") else value


def _repeats(kind: Any) -> bool:
    if isinstance(kind, dict):
        names = [f["name"] for f in kind.get("fields", [])]
        return len(names) != len(set(names)) or any(map(_repeats, kind.values()))
    return isinstance(kind, list) and any(map(_repeats, kind))


def check_call(trees: Trees, call: Any, provider: Provider) -> None:
    """Key, arity, names, types and constant arguments of one call; PlanError says what is wrong."""
    name = call.name()
    if provider.key is None:
        raise PlanError(f"{name} requires {provider.key_name} before planning")
    parameters = rq.PARAMETERS[name]
    try:
        given = dict(zip(parameters, trees.arguments(call), strict=True))
    except ValueError as e:
        raise PlanError(str(e)) from None
    if missing := [p for p in parameters if given[p] is None and p not in rq.OPTIONAL[name]]:
        raise PlanError(f"{name} expects {len(parameters)} arguments after optional defaults are filled; {missing[0]} is missing")
    for i, p in enumerate(parameters[1:], 1):
        if given[p] is not None and given[p].dataType().simpleString() not in ("string", "void"):
            raise PlanError(f"{name} argument {i + 1} must be UTF-8 text or NULL")
    if _repeats(json.loads(given["state"].dataType().json())):
        raise PlanError("Struct has duplicate field names")
    constant = {p: _literal(e) if e is not None else (True, None) for p, e in given.items()}
    try:
        fixed, state = constant["state"]
        if fixed and state is not None:
            kind = given["state"].dataType().simpleString()
            if kind == "string":
                canonical(root_text(state))
            elif not kind.startswith(("struct", "map", "array", "variant")):
                raise JudgmentError("state must be text, a JSON object or array")
        if constant["model"][0] and constant["model"][1] is not None:
            rq.check_model(constant["model"][1])
        first = parameters[1]
        if constant[first][0]:
            if constant[first][1] is None:
                raise JudgmentError(f"{first} cannot be NULL")
            if name == "ask":
                rq.parse_questions(constant[first][1])
        if name != "ask" and constant["criteria"][0]:
            rq.parse_criteria(name, constant["criteria"][1])
    except JudgmentError as e:
        raise PlanError(str(e)) from None


def check_plan(trees: Trees, plan: Any, provider: Provider) -> int:
    """Check all calls of a plan; how many there are."""
    count = 0
    for call in trees.plan_calls(plan):
        check_call(trees, call, provider)
        count += 1
    return count
