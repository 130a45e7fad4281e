"""A bounded decoder of the Variant binary encoding that keeps decimals exact."""

from __future__ import annotations

import struct
from decimal import Decimal
from typing import Any

from assay.errors import JudgmentError
from assay.functions.canonical import Number, check_depth

# The primitive types that JSON can hold, by type id.
_NULL, _TRUE, _FALSE, _DOUBLE, _FLOAT, _STRING = 0, 1, 2, 7, 14, 16
_INTS = {3: 1, 4: 2, 5: 4, 6: 8}
_DECIMALS = {8: 4, 9: 8, 10: 16}


def _bad() -> JudgmentError:
    return JudgmentError("invalid Variant data")


def _take(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or n < 0 or at + n > len(data):
        raise _bad()
    return data[at : at + n]


def _uint(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(_take(data, at, n), "little")


def _names(metadata: bytes) -> list[str]:
    head = _uint(metadata, 0, 1)
    if head & 15 != 1:
        raise _bad()
    size = (head >> 6) + 1
    count = _uint(metadata, 1, size)
    base = 1 + size * (count + 2)
    if base > len(metadata):
        raise _bad()
    ends = [_uint(metadata, 1 + size * (1 + i), size) for i in range(count + 1)]
    try:
        return [_take(metadata, base + a, b - a).decode("utf-8") for a, b in zip(ends, ends[1:], strict=False)]
    except UnicodeDecodeError:
        raise _bad() from None


def decimal_text(value: Decimal) -> Number:
    sign, digits, exponent = value.as_tuple()
    return Number(("-" if sign else "") + "".join(map(str, digits)) + f"e{exponent}")


def float_number(value: float) -> Number:
    if value != value or value in (float("inf"), float("-inf")):
        raise JudgmentError("cannot represent a non-finite number losslessly in JSON")
    return Number(repr(value))


def _primitive(kind: int, data: bytes, at: int) -> Any:
    if kind in (_NULL, _TRUE, _FALSE):
        return {_NULL: None, _TRUE: True, _FALSE: False}[kind]
    if kind in _INTS:
        return int.from_bytes(_take(data, at, _INTS[kind]), "little", signed=True)
    if kind in _DECIMALS:
        scale = _uint(data, at, 1)
        if scale > 38:
            raise _bad()
        return Number(f"{int.from_bytes(_take(data, at + 1, _DECIMALS[kind]), 'little', signed=True)}e-{scale}")
    if kind == _DOUBLE:
        return float_number(struct.unpack("<d", _take(data, at, 8))[0])
    if kind == _FLOAT:
        return float_number(struct.unpack("<f", _take(data, at, 4))[0])
    if kind == _STRING:
        return _text(data, at + 4, _uint(data, at, 4))
    if kind <= 20:
        raise JudgmentError("cannot represent this Variant type losslessly in JSON")
    raise _bad()


def _text(data: bytes, at: int, n: int) -> str:
    try:
        return _take(data, at, n).decode("utf-8")
    except UnicodeDecodeError:
        raise _bad() from None


def decode(value: bytes, metadata: bytes) -> Any:
    """The JSON value of a Variant; corrupt bytes, and types that JSON can't hold, are row errors."""
    names = _names(metadata)

    def at_place(at: int, depth: int) -> Any:
        head = _uint(value, at, 1)
        basic, info = head & 3, head >> 2
        if basic == 0:
            return _primitive(info, value, at + 1)
        if basic == 1:
            return _text(value, at + 1, info)
        check_depth(depth + 1)
        size = (info & 3) + 1
        many = 4 if info >> (4 if basic == 2 else 2) & 1 else 1
        count = _uint(value, at + 1, many)
        ids = (info >> 2 & 3) + 1 if basic == 2 else 0
        first = at + 1 + many + ids * count
        base = first + size * (count + 1)
        if base > len(value):
            raise _bad()
        places = [base + _uint(value, first + size * i, size) for i in range(count)]
        if basic == 3:
            return [at_place(p, depth + 1) for p in places]
        keys = [_uint(value, at + 1 + many + ids * i, ids) for i in range(count)]
        if any(k >= len(names) for k in keys):
            raise _bad()
        out = {names[k]: at_place(p, depth + 1) for k, p in zip(keys, places, strict=True)}
        if len(out) != count:
            raise JudgmentError("duplicate object keys")
        return out

    return at_place(0, 0)
