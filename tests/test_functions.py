"""Canonical JSON, states, requests and replies, without Spark."""

import json
import struct
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from assay.errors import JudgmentError
from assay.functions import requests as rq
from assay.functions.canonical import MAX_BYTES, canonical, parse, spell, structured
from assay.functions.state import root_converter
from assay.functions.variant import decode


def state(value, kind):
    array = pa.array([value], kind)
    return canonical(root_converter(array.type)(array[0].as_py())).decode()


@pytest.mark.parametrize(
    ("text", "want"),
    [("1", "1"), ("1.0", "1"), ("10e-1", "1"), ("-0.0", "0"), ("0e20", "0"), ("1e20", "100000000000000000000"), ("1e21", "1e21"), ("1.50", "1.5"), ("0.000001", "0.000001"), ("0.0000001", "1e-7"), ("-12.5e3", "-12500"), ("123e-25", "1.23e-23")],
)
def test_numbers_have_one_spelling(text, want):
    assert spell(text) == want and canonical(parse(f"[{text}]")) == f"[{want}]".encode()


@given(st.decimals(allow_nan=False, allow_infinity=False))
def test_spelling_keeps_the_value(d):
    text = spell(f"{d:E}".replace("E", "e"))
    assert Decimal(text) == d and spell(text) == text


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_canonical_json_is_stable_and_parses_back(value):
    try:
        data = canonical(value)
    except JudgmentError:
        return  # lone surrogates
    assert canonical(parse(data.decode())) == data and json.loads(data) == value


def test_keys_are_sorted_by_code_point():
    assert canonical({"\U00010000": 1, "￿": 2, "a": 3}).decode() == '{"a":3,"￿":2,"\U00010000":1}'


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"a":1,"\\u0061":2}', "[NaN]", "[1e99999999999999999999]", "[" * 65 + "]" * 65, "[" * 5000 + "]" * 5000, "[1,]", "{"])
def test_strict_json(bad):
    with pytest.raises(JudgmentError):
        parse(bad)
    assert structured(bad) == bad


def test_depth_and_size_limits():
    assert canonical(parse("[" * 64 + "]" * 64))
    with pytest.raises(JudgmentError, match="64 nesting"):
        state("[" * 65 + "]" * 65, pa.string())
    assert len(canonical("x" * (MAX_BYTES - 2))) == MAX_BYTES
    for text in ("x" * (MAX_BYTES - 1), "é" * (MAX_BYTES // 2), "\0" * (MAX_BYTES // 6 + 1)):
        with pytest.raises(JudgmentError, match="byte JSON limit"):
            canonical(text)


@pytest.mark.parametrize("text", ["", "null", "true", "123", '"quoted"', "{broken", "naïve 😀"])
def test_other_text_stays_text(text):
    assert json.loads(state(text, pa.string())) == text


@pytest.mark.parametrize("text", ["{}", "[]", '[null,"null",{},[]]', ' {"a": [1.0]} '])
def test_text_that_is_a_container_becomes_one(text):
    assert json.loads(state(text, pa.string())) == json.loads(text)


def test_typed_values_equal_json_text():
    inner = pa.struct([("b", pa.decimal128(38, 20)), ("a", pa.list_(pa.int64()))])
    value = {"b": Decimal("1.50"), "a": [3, None, 1]}
    want = '{"a":[3,null,1],"b":1.5}'
    assert state(value, inner) == want == state('{"b":1.50,"a":[3,null,1]}', pa.string())
    assert state([("k", "x"), ("a", None)], pa.map_(pa.string(), pa.string())) == '{"a":null,"k":"x"}'
    assert state(["{}"], pa.list_(pa.string())) == '["{}"]'  # nested text stays text
    assert state(pa.array(["x"]).dictionary_encode()[0].as_py(), pa.string()) == '"x"'
    assert state({}, pa.struct([])) == "{}"
    assert state([0.1, 1e300], pa.list_(pa.float64())) == "[0.1,1e300]" and state([0.5], pa.list_(pa.float32())) == "[0.5]"
    assert state([Decimal("-123456789012345678901234567890.12345678")], pa.list_(pa.decimal128(38, 8))) == "[-123456789012345678901234567890.12345678]".replace("-123456789012345678901234567890.12345678", spell("-123456789012345678901234567890.12345678"))


@pytest.mark.parametrize(
    ("value", "kind", "says"),
    [(1, pa.int64(), "state must be text"), (True, pa.bool_(), "state must be text"), ([float("nan")], pa.list_(pa.float64()), "losslessly"), ([b"x"], pa.list_(pa.binary()), "losslessly"), (0, pa.timestamp("us", "UTC"), "losslessly"), (1.5, pa.float64(), "state must be text"), ([(1, "a")], pa.map_(pa.int64(), pa.string()), "Map keys"), ([("a", 1), ("a", 2)], pa.map_(pa.string(), pa.int64()), "duplicate keys"), ('{"a":1,"a":2}', pa.string(), "duplicate object keys")],
)
def test_row_errors(value, kind, says):
    with pytest.raises(JudgmentError, match=says):
        state(value, kind)


def test_null_values_inside_containers():
    assert state([None], pa.list_(pa.binary())) == "[null]" and state({"a": None}, pa.struct([("a", pa.timestamp("us"))])) == '{"a":null}'


def variant_metadata(*names):
    ends, data = [0], b""
    for n in names:
        data += n.encode()
        ends.append(len(data))
    return bytes([1, len(names), *ends]) + data


def test_variants():
    decimal = bytes([8 << 2, 2]) + struct.pack("<i", 150)
    obj = bytes([2, 2, 0, 1, 0, len(decimal), len(decimal) + 1]) + decimal + bytes([1 << 2])
    assert canonical(decode(obj, variant_metadata("b", "a"))) == b'{"a":true,"b":1.5}'
    array = bytes([3, 2, 0, 2, 5]) + bytes([3 << 2, 7]) + bytes([2 << 2 | 1]) + b"hi"
    assert decode(array, variant_metadata()) == [7, "hi"]
    for value, metadata in ((obj[:-1], variant_metadata("b", "a")), (obj, variant_metadata("b")), (b"", variant_metadata()), (b"\0", b""), (array, b"\x02\0\0"), (bytes([31 << 2]), variant_metadata())):
        with pytest.raises(JudgmentError, match="invalid Variant"):
            decode(value, metadata)
    with pytest.raises(JudgmentError, match="losslessly"):
        decode(bytes([11 << 2, 0, 0, 0, 0]), variant_metadata())
    deep = bytes([0])
    for _ in range(65):
        deep = bytes([3, 1, 0, len(deep) % 256]) + deep if len(deep) < 250 else bytes([3 | 1 << 2, 1, 0, 0]) + struct.pack("<H", len(deep)) + deep
    with pytest.raises(JudgmentError, match="nesting"):
        decode(deep, variant_metadata())


@given(st.binary(max_size=60), st.binary(max_size=30))
def test_corrupt_variants_are_errors(value, metadata):
    try:
        decode(value, metadata)
    except JudgmentError:
        pass


def test_criteria_and_questions():
    assert rq.questions_of("noul", "x", None) == {"q0": {"type": "noul", "instructions": "x"}}
    assert rq.questions_of("noul", '{"a":1}', "{}")["q0"] == {"type": "noul", "instructions": {"a": "1"}, "criteria": {}}
    for kind, text in (("noul", '{"maybe":1}'), ("noul", "[]"), ("noul", "null"), ("choice", "{}"), ("choice", None), ("score", "[1]"), ("score", None), ("choice", '{"a":1,"a":2}')):
        with pytest.raises(JudgmentError, match="criteria"):
            rq.questions_of(kind, "x", text)
    got = rq.parse_questions('{"a":{"type":"noul","instructions":"i","criteria":null,"extra":1}}')
    assert got == {"a": {"type": "noul", "instructions": "i"}}
    for text in ("{}", "[]", "{", '{"a":{"type":"other","instructions":"i"}}', '{"a":{"type":"noul"}}', '{"a":{"type":"score","instructions":"i"}}'):
        with pytest.raises(JudgmentError):
            rq.parse_questions(text)


def reply(**answer):
    return json.dumps({"answers": {"q0": answer}})


def test_replies():
    assert rq.result_of("noul", reply(noul=1)) == 1.0 and rq.result_of("ask", "not json\0") == "not json\0"
    assert rq.result_of("choice", reply(choice="a", confidence=0, probabilities={"a": 1}, more=2)) == {"label": "a", "confidence": 0.0, "probabilities": [("a", 1.0)]}
    assert rq.result_of("score", reply(score=-7.5, confidence=1, probabilities={}))["score"] == -7.5
    for function, text, says in (
        ("noul", reply(noul=2), "probability from 0 to 1"), ("noul", reply(noul=True), "probability"), ("noul", "x", "invalid noul response"), ("noul", reply(), "probability"),
        ("choice", '{"answers":{"q0":7}}', "invalid choice answer"), ("choice", reply(choice="secret", confidence=1.01, probabilities={}), "confidence is outside"),
        ("choice", reply(choice="a", confidence=1, probabilities={"a": -0.01}), "probabilities is outside"), ("choice", reply(choice={"secret": 1}, confidence=1, probabilities={}), "response field choice"),
        ("score", reply(score="1", confidence=1, probabilities={}), "response field score"), ("score", reply(score=1, confidence={"x": 1}, probabilities={}), "response field confidence"),
        ("score", reply(score=1, confidence=1, probabilities={"a": "b"}), "response field probabilities"),
    ):
        with pytest.raises(JudgmentError, match=says) as e:
            rq.result_of(function, text)
        assert "secret" not in str(e.value)
