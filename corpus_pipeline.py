"""A pipeline from documents to packed training sequences.

Each stage takes all that the one before kept, and is written and read again.
Documents in no known language go, one of each group of near duplicates stays,
personal data and secrets are masked, sources are repeated to their target weights, and the
rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import langid, mixing, packing, pii, simhash
from assay.llm.common import cut, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, extra=pii.SECRETS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, copy_col="__copy", key_col="__key").select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mask_pii", mask_pii), ("mix_sources", mix_sources), ("pack", pack)]

#: Fingerprints, models and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
