"""Column values as JSON states, without loss.

A state is text, an object or an array. Text that is a JSON object or array
counts as that, strictly; other text, and all text inside a container, stays
text. What JSON can't hold exactly (times, bytes, non-finite numbers) is an
error of its row, never a null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.types as at

from assay.errors import JudgmentError
from assay.functions import variant
from assay.functions.canonical import check_depth, parse

Convert = Callable[[Any, int], Any]


def is_variant(kind: pa.DataType) -> bool:
    return at.is_struct(kind) and sorted(f.name for f in kind) == ["metadata", "value"] and all(at.is_binary(f.type) or at.is_large_binary(f.type) for f in kind)


def _lossy(kind: pa.DataType) -> JudgmentError:
    return JudgmentError(f"cannot represent {kind} losslessly in JSON")


def converter(kind: pa.DataType) -> Convert:
    """From a Python value of an Arrow type, at a depth, to its JSON value."""
    if at.is_dictionary(kind):
        return converter(kind.value_type)
    if at.is_null(kind):
        return lambda v, d: None
    if at.is_string(kind) or at.is_large_string(kind) or at.is_boolean(kind) or at.is_integer(kind):
        return lambda v, d: v
    if at.is_decimal(kind):
        return lambda v, d: None if v is None else variant.decimal_text(v)
    if at.is_floating(kind):
        return lambda v, d: None if v is None else variant.float_number(float(v))
    if is_variant(kind):
        return lambda v, d: None if v is None else variant.decode(v["value"], v["metadata"])
    if at.is_struct(kind):
        names = [f.name for f in kind]
        inner = {f.name: converter(f.type) for f in kind}

        def struct(v: Any, d: int) -> Any:
            if v is None:
                return None
            check_depth(d + 1)
            if len(inner) != len(names):
                raise JudgmentError("Struct has duplicate field names")
            return {k: f(v[k], d + 1) for k, f in inner.items()}

        return struct
    if at.is_map(kind):
        item = converter(kind.item_type)
        text = at.is_string(kind.key_type) or at.is_large_string(kind.key_type)

        def pairs(v: Any, d: int) -> Any:
            if v is None:
                return None
            check_depth(d + 1)
            if not text or any(k is None for k, _ in v):
                raise JudgmentError("Map keys must be non-NULL UTF-8 strings")
            out = {k: item(x, d + 1) for k, x in v}
            if len(out) != len(v):
                raise JudgmentError("Map has duplicate keys")
            return out

        return pairs
    if at.is_list(kind) or at.is_large_list(kind) or at.is_fixed_size_list(kind):
        element = converter(kind.value_type)

        def items(v: Any, d: int) -> Any:
            if v is None:
                return None
            check_depth(d + 1)
            return [element(x, d + 1) for x in v]

        return items

    def never(v: Any, d: int) -> Any:
        if v is None:
            return None
        raise _lossy(kind)

    return never


def root_text(text: str) -> Any:
    """Text that begins like an object or array is one if it parses; errors of strict JSON count only if it would parse otherwise."""
    if text.lstrip(" \t\r\n")[:1] not in ("{", "["):
        return text
    try:
        return parse(text)
    except JudgmentError as e:
        if str(e) == "not valid JSON":
            return text
        raise


def root_converter(kind: pa.DataType) -> Callable[[Any], Any]:
    """From a non-null value of a column's type to a state, whose size and depth are checked where it is written."""
    inner = converter(kind)
    text = at.is_string(kind) or at.is_large_string(kind) or (at.is_dictionary(kind) and at.is_string(kind.value_type))

    def convert(value: Any) -> Any:
        state = root_text(value) if text else inner(value, 0)
        if isinstance(state, bool) or not isinstance(state, str | dict | list) or (isinstance(state, str) and type(state) is not str):
            raise JudgmentError("state must be text, a JSON object or array")
        return state

    return convert
