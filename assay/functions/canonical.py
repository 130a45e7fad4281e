"""Strict JSON in, canonical JSON out.

Numbers never pass through a float: :class:`Number` keeps their digits.
Canonical text has sorted keys, no spaces, and one spelling for each number,
so that equal requests have equal bytes.
"""

from __future__ import annotations

import json
import re
from json.encoder import encode_basestring
from typing import Any

from assay.errors import JudgmentError

MAX_DEPTH, MAX_BYTES = 64, 1_048_576
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.DOTALL)
_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?")


class Number(str):
    """A JSON number in its canonical spelling."""

    __slots__ = ()

    def __new__(cls, text: str) -> Number:
        return super().__new__(cls, spell(text))


def spell(text: str) -> str:
    """One spelling for each value: plain digits from 1e-6 to under 1e21, else an exponent."""
    match = _NUMBER.fullmatch(text)
    if not match:
        raise JudgmentError("not a JSON number")
    sign, whole, fraction, exponent = match.groups()
    shift = int(exponent or 0)
    if not -(1 << 63) <= shift < 1 << 63:
        raise JudgmentError("a JSON number's exponent is out of range")
    digits = whole + (fraction or "")
    point = len(whole) + shift
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    stripped = stripped.rstrip("0")
    if not stripped:
        return "0"
    if 1 <= point <= 21:
        body = stripped + "0" * (point - len(stripped)) if len(stripped) <= point else f"{stripped[:point]}.{stripped[point:]}"
    elif -5 <= point <= 0:
        body = "0." + "0" * -point + stripped
    else:
        body = stripped[0] + ("." + stripped[1:] if len(stripped) > 1 else "") + f"e{point - 1}"
    return sign + body


def check_depth(depth: int) -> None:
    if depth > MAX_DEPTH:
        raise JudgmentError(f"value exceeds {MAX_DEPTH} nesting levels")


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise JudgmentError("duplicate object keys")
    return out


def _reject(name: str) -> None:
    raise JudgmentError(f"{name} is not JSON")


_decoder = json.JSONDecoder(object_pairs_hook=_unique, parse_float=Number, parse_int=Number, parse_constant=_reject)


def parse(text: str) -> Any:
    """Strict JSON: keys unique after unescaping, bounded size and depth, exact numbers."""
    if len(text) > MAX_BYTES or len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise JudgmentError(f"value exceeds the local {MAX_BYTES}-byte JSON limit")
    depth = 0
    for token in _TOKEN.finditer(text):
        if (c := token.group()) in "[{":
            depth += 1
            check_depth(depth)
        elif c in "]}":
            depth -= 1
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError):
        raise JudgmentError("not valid JSON") from None


def structured(text: str) -> Any:
    """Instructions: text that strictly is a JSON object or array becomes one; anything else stays text."""
    if text.lstrip(" \t\r\n")[:1] not in ("{", "["):
        return text
    try:
        return parse(text)
    except JudgmentError:
        return text


def _write(value: Any, depth: int, out: list[str]) -> None:
    kind = type(value)
    if kind is str:
        out.append(encode_basestring(value))
    elif kind is Number:
        out.append(str.__str__(value))
    elif value is None or kind is bool:
        out.append({None: "null", True: "true", False: "false"}[value])
    elif kind is int:
        out.append(spell(str(value)))
    elif kind is dict:
        check_depth(depth + 1)
        mark = "{"
        for key in sorted(value):
            out.append(mark + encode_basestring(key) + ":")
            _write(value[key], depth + 1, out)
            mark = ","
        out.append("}" if value else "{}")
    elif kind is list or kind is tuple:
        check_depth(depth + 1)
        mark = "["
        for item in value:
            out.append(mark)
            _write(item, depth + 1, out)
            mark = ","
        out.append("]" if value else "[]")
    else:
        raise JudgmentError(f"cannot represent {kind.__name__} losslessly in JSON")


def canonical_text(value: Any, depth: int = 0) -> str:
    """The value's canonical JSON, as it stands inside ``depth`` containers; size unchecked."""
    out: list[str] = []
    _write(value, depth, out)
    return "".join(out)


def bounded(text: str) -> bytes:
    try:
        data = text.encode("utf-8")
    except UnicodeEncodeError:
        raise JudgmentError("text is not valid Unicode") from None
    if len(data) > MAX_BYTES:
        raise JudgmentError(f"value exceeds the local {MAX_BYTES}-byte JSON limit")
    return data


def canonical(value: Any) -> bytes:
    """The value's canonical JSON, within the limits of depth and size."""
    return bounded(canonical_text(value))
