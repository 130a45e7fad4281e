"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the corpus, and so a mean repetition rate:
its share of the total size over its own size. Each document's count is the
inverse of the Poisson distribution with that mean at a hash of its id, so it
is the same in every run and needs no state. Copies are put in the order of
another hash, which shuffles the whole corpus.

Rates above ``STEP`` are split into parts of equal rate, each with a hash of
its own, since sums of Poisson counts are Poisson; so the distribution is
inverted over at most ``TERMS`` terms, beyond which 52 bits can't reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents

STEP, TERMS, BITS, TEMPERATURE, SEED = 8.0, 48, 52, 0.7, "mix"


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 as a number from 0 to below 1."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long").cast("double") / float(1 << BITS)


def rates(df: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, parts, thresholds): into how many parts each source's rate is split, and their distribution.

    Sizes are characters. Without ``weights`` a source's target share goes as
    its size to the power ``temperature``. With them, a source that has none
    gets no copies; the key None stands for rows without a source. Weights need
    not add up to 1, and those of sources without rows don't count; where none
    is left, nothing is copied. Negative and unbounded weights are errors.
    """
    if bad := [k for k, v in (weights or {}).items() if not 0 <= v < math.inf]:
        raise ValueError(f"weights must be finite and not negative: {bad}")
    sizes = df.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.sum(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("double").alias("size"))
    sizes = cut(sizes, "sizes")
    weight = F.pow("size", F.lit(temperature))
    if weights is not None:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    wanted = sizes.withColumn("weight", weight)
    total = wanted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes")).first()
    if not total.weights:  # no rows, or no source with a weight
        return wanted.select("source", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("parts"), F.array().cast("array<double>").alias("thresholds")).where("false")
    rate = F.col("weight") / F.lit(total.weights).cast("double") * F.lit(total.sizes).cast("double") / F.col("size")
    wanted = wanted.withColumn("rate", rate).where("rate > 0").withColumn("parts", F.ceil(F.col("rate") / STEP).cast("long")).withColumn("mean", F.col("rate") / F.col("parts"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def term(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    thresholds = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, term, lambda s: s["c"])
    return wanted.select("source", "rate", "parts", thresholds.alias("thresholds"))


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", key_col: str = "shuffle_key") -> DataFrame:
    """All columns of ``df`` with ``copy_col`` (from 0) and ``key_col``, repeated to the target weights, in shuffled order.

    Columns of ``df`` of those two names are replaced; no other can clash.
    Repeated rows of one id get equal counts, and their copies tie in the order;
    a null id hashes as the text 'null'. Null sources are a source of their own,
    null and empty texts have size 1, very long ones their whole length. No rows
    give none.
    """
    wanted = cut(rates(df, weights, temperature, source_col, text_col), "rates")
    wanted = wanted.select(F.col("source").alias("__source"), "parts", "thresholds")
    packed = df.select(F.struct("*").alias("__row"), F.col(f"`{source_col}`").cast("string").alias("__of"), F.col(f"`{id_col}`").alias("__id"))
    # the written rates are a row per source: Spark broadcasts them if they are under its limit, and else splits large sources
    parts = packed.join(wanted, F.col("__of").eqNullSafe(F.col("__source")))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(k.alias("k"), _uniform(seed, F.col("__id"), k).alias("u")))
    counts = F.transform(draws, lambda d: F.struct(d["k"].alias("k"), F.size(F.filter(F.col("thresholds"), lambda c: d["u"] >= c)).alias("n")))
    drawn = parts.select("__row", "__id", F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("__n")).where("__n > 0")
    copies = drawn.select("__row", "__id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.col("copy"))), 1, 15), 16, 10).cast("long"))
    names = [c for c in df.columns if c not in (copy_col, key_col)]
    # the keys are even by construction, so their leading bits name the partition and no sample has to be drawn for ranges
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionById(n, F.floor(F.col("shuffle_key") / float(1 << 60) * n).cast("int")).sortWithinPartitions("shuffle_key", "copy")
    return dealt.select(*[F.col(f"__row.`{c}`").alias(c) for c in names], F.col("copy").alias(copy_col), F.col("shuffle_key").alias(key_col))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = {
    "op1_mixing": f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size, {TEMPERATURE}) AS weight FROM sizes),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(size) FROM sizes) / size AS rate FROM weighted),
parted AS (SELECT source, CAST(ceil(rate / {STEP}) AS BIGINT) AS parts, rate / ceil(rate / {STEP}) AS mean FROM rated WHERE rate > 0),
terms AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < {TERMS}),
draws AS (
  SELECT d.doc_id, d.source, part, CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || part), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << BITS)} AS u
  FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(0, r.parts)) AS t(part)),
counts AS (SELECT w.doc_id, count(t.k) AS n FROM draws w JOIN terms t ON w.source IS NOT DISTINCT FROM t.source AND w.u >= t.c GROUP BY w.doc_id)
SELECT d.*, copy, CAST('0x' || substr(md5('{SEED}/order:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM documents d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id, unnest(range(0, c.n)) AS u(copy)
"""
}
