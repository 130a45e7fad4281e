"""Shards of equal row counts that keep linked documents together.

Documents are linked if their texts are equal. Balanced label propagation: a
linked document starts in the shard that its hash gives. In each round, joins tell every
linked document which shard most of its neighbours are in, and it moves there
as far as that shard's quota goes. Links are stars around a hub per group, so
a group costs its size and no pairs; groups larger than a part of a shard have
several hubs. Rows come out exactly even: a last step turns out what is over a
shard's capacity and fills the gaps with those and with unlinked documents.
Only tables of (shard) or (shard, bucket) counts meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import cut, documents, pick

SHARDS, ROUNDS, HUB_SHARE, BUCKET = 40, 3, 2, 1 << 16


def _ranked(df: DataFrame, by: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with a gapless rank from 0 within ``by``, in two steps: counts before each bucket, and ranks within one."""
    df = df.withColumn("__b", F.pmod(F.xxhash64("rid", F.lit(17)), F.lit(buckets)))
    counts = df.groupBy(*by, "__b").count()
    # one row for each bucket of a shard, that is of some 65,536 documents
    before = counts.withColumn("__before", F.sum("count").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__bucket"), F.coalesce("__before", F.lit(0)).alias("__before"))
    # the ranks are partitioned by what they are joined on, so the join moves none of them
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("rid")) - 1)
    on = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col("__b") == F.col("__bucket")]
    return ranked.join(before, on).withColumn(name, F.col("__before") + F.col("__r")).select(*[c for c in df.columns if c != "__b"], name)


def _step(rank: F.Column, edges: list[int]) -> F.Column:
    """How many of the rising ``edges`` are at or under ``rank``; there is one per shard."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= rank))


def balanced_shards(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and the group, for each row.

    Null texts count as empty and equal each other. Repeated rows and null ids
    are documents like any other. Very long texts count in full; beyond their
    size and hashes they are not moved. Rows that tie are told apart by where
    they were read. No rows give none. Columns other than the two named are not
    read, so their names cannot clash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("group_id"), F.monotonically_increasing_id().alias("rid"))
    docs = cut(docs, "rows")
    total = docs.count()
    if not total:
        return docs.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_id")
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    hub_size = max(1, total // shards // HUB_SHARE)
    buckets = -(-capacity[0] // BUCKET)

    groups = docs.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select("group_id", F.ceil(F.col("n") / hub_size).alias("hubs")), "groups")
    docs = docs.join(groups, "group_id", "left")
    hub = F.xxhash64("group_id", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("hubs")))
    base = cut(docs.select("doc_id", "size", "text_crc32", "group_id", "rid", F.when(F.col("hubs").isNotNull(), hub).alias("hub")), "base")

    linked = base.where("hub is not null").select("rid", "hub", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"))
    linked = cut(linked, "labels")
    for turn in range(rounds):
        load = {r.shard: r["count"] for r in linked.groupBy("shard").count().collect()}
        free = F.element_at(F.array(*[F.lit(0.05 + max(0, capacity[s] - load.get(s, 0)) / max(1, capacity[s])) for s in range(shards)]), F.col("shard") + 1)
        # neighbours by shard, as each hub sees them, in shards with room first; ties go by a hash, or low shards would fill first
        seen = linked.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        top = F.max(F.struct((F.col("n") * free).alias("score"), F.xxhash64("hub", "shard").alias("h"), "shard", "n")).alias("top")
        aim = cut(seen.groupBy("hub").agg(top, F.sum("n").alias("all")).select("hub", F.col("top.shard").alias("aim"), F.col("top.n").alias("there"), (F.col("all") - F.col("top.n")).alias("movers")), "aims")
        asked = {r.aim: r for r in aim.groupBy("aim").agg(F.sum("movers").alias("movers"), F.sum("there").alias("there")).collect()}
        # a shard's quota is its capacity less those that are there to stay; who asks beyond that is turned away by a hash
        share = [min(1.0, max(0, capacity[s] - asked[s].there) / max(1, asked[s].movers)) if s in asked else 0.0 for s in range(shards)]
        luck = F.pmod(F.xxhash64("hub", F.lit(29 + turn)), F.lit(1 << 20)) / (1 << 20)
        taken = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("aim") + 1) > luck
        moved = linked.join(aim.select("hub", "aim"), "hub")
        # a hub that is turned away tries its luck at another shard in the next round
        linked = cut(moved.select("rid", "hub", F.when(taken, F.col("aim")).otherwise(F.col("shard")).alias("shard")), "labels")

    ranked = cut(_ranked(linked, ["shard"], "place", buckets), "placed")
    limit = F.element_at(F.array(*[F.lit(c).cast("long") for c in capacity]), F.col("shard") + 1)
    staying = ranked.where(F.col("place") < limit).select("rid", "shard", F.col("place").alias("slot"))
    taken = {r.shard: r["count"] for r in staying.groupBy("shard").count().collect()}
    edges, room = [], 0
    for s in range(shards):
        edges.append(room)
        room += capacity[s] - taken.get(s, 0)
    pool = base.where("hub is null").select("rid").unionAll(ranked.where(F.col("place") >= limit).select("rid"))
    pool = _ranked(pool, [], "place", shards * buckets)
    # the shard is the last whose gap begins at or before the place, since empty gaps begin where the next one does
    pool = pool.withColumn("shard", (_step(F.col("place"), edges) - 1).cast("int"))
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    filled = pool.select("rid", "shard", (F.col("place") - at(edges) + at([taken.get(s, 0) for s in range(shards)])).alias("slot"))
    placed = staying.unionAll(filled)
    return base.join(placed, "rid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "group_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(documents(spark, sf_dir))
