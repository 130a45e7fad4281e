"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) to (a, b): each node that isn't its component's least node, with that node.

    Each round is two joins of the edges with their least neighbours; its
    result is written, so lineage stays short. Only a count and a checksum of
    the edges come to the driver. Self loops and repeated edges do no harm; no
    edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that Spark sees its size and may split a hub's edges over tasks
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        discard(least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = cut(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now)
        discard(large)
        discard(least)
        now = then
