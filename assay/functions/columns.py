"""SQL helpers: the canonical JSON of states and its SHA-256, and values out of JSON text by keys."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assay.functions.canonical import canonical
from assay.functions.state import root_converter


def _canonical(state: pa.Array) -> list[bytes | None]:
    convert = root_converter(state.type)
    return [None if (v := x.as_py()) is None else canonical(convert(v)) for x in state]


def canonical_state(state: pa.Array) -> pa.Array:
    return pa.array([None if b is None else b.decode("utf-8") for b in _canonical(state)], pa.string())


def state_fingerprint(state: pa.Array) -> pa.Array:
    return pa.array([None if b is None else hashlib.sha256(b).hexdigest() for b in _canonical(state)], pa.string())


def register_helpers(spark: SparkSession) -> None:
    """``canonical_state(state)`` and ``state_fingerprint(state)``; NULL gives NULL, a state that can't be kept exactly ends the query."""
    spark.udf.register("canonical_state", F.arrow_udf(canonical_state, "string"))
    spark.udf.register("state_fingerprint", F.arrow_udf(state_fingerprint, "string"))


def register_json_functions(spark: SparkSession) -> None:
    """``json_get``, ``json_get_str``, ``json_get_float``, ``json_get_int`` and ``json_get_bool`` of a JSON text and one to four keys.

    They are SQL functions over Spark's own ``from_json``. A key is any text, or
    of an array the place from 0. What is absent or of another type gives NULL.
    """
    keys = ", ".join(["k1 STRING", *(f"k{i} STRING DEFAULT NULL" for i in range(2, 5))])
    step = "CASE WHEN {1} IS NULL THEN {0} WHEN ltrim({0}) LIKE '[%' THEN get(from_json({0}, 'array<string>'), try_cast({1} AS INT)) ELSE try_element_at(from_json({0}, 'map<string,string>'), {1}) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json_step(doc STRING, k STRING) RETURNS STRING RETURN {step.format('doc', 'k')}")
    for name, kind in (("json_get", "STRING"), ("json_get_str", "STRING"), ("json_get_float", "DOUBLE"), ("json_get_int", "BIGINT"), ("json_get_bool", "BOOLEAN")):
        value = "json_step(json_step(json_step(json_step(doc, k1), k2), k3), k4)"
        body = value if kind == "STRING" else f"try_cast({value} AS {kind})"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(doc STRING, {keys}) RETURNS {kind} RETURN {body}")
