"""Requests to the judgment service, and what its replies mean.

Typed functions ask one question, named ``q0``; ``ask`` takes a map of named
questions and returns the reply as it came.
"""

from __future__ import annotations

import json
import math
from typing import Any

from assay.errors import JudgmentError
from assay.functions.canonical import parse, structured

# The functions, their arguments, and the result types.
PARAMETERS = {
    "noul": ("state", "instructions", "criteria", "model"),
    "choice": ("state", "instructions", "criteria", "model"),
    "score": ("state", "instructions", "criteria", "model"),
    "ask": ("state", "questions", "model"),
}
OPTIONAL = {"noul": ("criteria", "model"), "choice": ("model",), "score": ("model",), "ask": ("model",)}
RETURNS = {
    "noul": "double",
    "choice": "struct<label:string,confidence:double,probabilities:map<string,double>>",
    "score": "struct<score:double,confidence:double,probabilities:map<string,double>>",
    "ask": "string",
}
QUESTION = "q0"


def check_criteria(kind: str, criteria: Any) -> None:
    if kind == "noul" and not (criteria is None or isinstance(criteria, dict) and criteria.keys() <= {"true", "false"}):
        raise JudgmentError("noul criteria must be a JSON object with true/false rubrics, or SQL NULL")
    if kind == "choice" and not (isinstance(criteria, dict) and criteria):
        raise JudgmentError("choice criteria must be a nonempty JSON object")
    if kind == "score" and not (isinstance(criteria, list) and len(criteria) >= 2):
        raise JudgmentError("score criteria must be a JSON array with at least two ordered levels")


def parse_criteria(kind: str, text: str | None) -> Any:
    criteria = None
    if text is not None:
        try:
            criteria = parse(text)
        except JudgmentError as e:
            raise JudgmentError(f"criteria must be valid JSON without duplicate keys: {e}") from None
        if kind == "noul" and criteria is None:
            check_criteria(kind, False)
    check_criteria(kind, criteria)
    return criteria


def parse_questions(text: str) -> dict[str, dict]:
    """Named questions; fields that aren't known are left out, and null criteria count as none."""
    try:
        found = parse(text)
    except JudgmentError as e:
        raise JudgmentError(f"ask questions must be valid JSON: {e}") from None
    typed = isinstance(found, dict) and all(isinstance(q, dict) and q.get("type") in ("noul", "choice", "score") and "instructions" in q for q in found.values())
    if not typed:
        raise JudgmentError("ask questions must be a JSON map of typed questions")
    if not found:
        raise JudgmentError("ask questions cannot be empty")
    out = {}
    for name, q in found.items():
        check_criteria(q["type"], q.get("criteria"))
        out[name] = {k: q[k] for k in ("type", "instructions", "criteria") if k != "criteria" or q.get(k) is not None}
    return out


def questions_of(function: str, first: str | None, criteria: str | None) -> dict[str, dict]:
    """The questions of a call: ``first`` has the instructions, or the questions of ``ask``."""
    if function == "ask":
        if first is None:
            raise JudgmentError("questions cannot be NULL")
        return parse_questions(first)
    if first is None:
        raise JudgmentError("instructions cannot be NULL")
    found = parse_criteria(function, criteria)
    question = {"type": function, "instructions": structured(first)}
    return {QUESTION: question | ({} if found is None else {"criteria": found})}


def check_model(model: str) -> str:
    if not model.strip():
        raise JudgmentError("model cannot be empty")
    return model


def _probability(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value <= 1


def _field(function: str, answer: dict, name: str, good: bool) -> Any:
    if not good:
        raise JudgmentError(f"invalid {function} response field {name}")
    return answer[name]


def result_of(function: str, reply: str) -> Any:
    """A reply's value; errors name fields and never quote the reply."""
    if function == "ask":
        return reply
    try:
        answer = json.loads(reply)["answers"][QUESTION]
    except (ValueError, RecursionError, LookupError, TypeError):
        raise JudgmentError(f"invalid {function} response") from None
    if function == "noul":
        value = answer.get("noul") if isinstance(answer, dict) else None
        if not _probability(value):
            raise JudgmentError("noul answer must be a probability from 0 to 1")
        return float(value)
    if not isinstance(answer, dict):
        raise JudgmentError(f"invalid {function} answer")
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
    name = "choice" if function == "choice" else "score"
    main = answer.get(name)
    main = _field(function, answer, name, isinstance(main, str) if function == "choice" else number(main))
    confidence = _field(function, answer, "confidence", number(answer.get("confidence")))
    chances = answer.get("probabilities")
    chances = _field(function, answer, "probabilities", isinstance(chances, dict) and all(number(v) for v in chances.values()))
    for field, values in (("confidence", [confidence]), ("probabilities", chances.values())):
        if not all(map(_probability, values)):
            raise JudgmentError(f"{field} is outside 0.0..=1.0")
    first = {"label": main} if function == "choice" else {"score": float(main)}
    return first | {"confidence": float(confidence), "probabilities": [(k, float(v)) for k, v in chances.items()]}
