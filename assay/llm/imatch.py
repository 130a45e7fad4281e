"""I-Match fingerprints over randomised subsets of a lexicon.

The lexicon has the terms whose document frequency lies in a band, so whose
inverse document frequency is neither low (words of the language) nor high
(names and slips). Subset 0 is all of it, so that every term of the band
counts. ``WIDTHS`` gives the random ones, each term being in each by a hash of
its own: they overlap and get sparser, since large subsets tell whether two
texts are equal and small ones how alike they are. The distinct terms of a
document, as 57-bit hashes, are sorted within each subset and hashed together;
the fingerprint is the list of these hashes, and the
likeness of two is the share of equal ones among the subsets that either has
terms in. A document with no term in the band has its whole text's hash, and is
like its equals alone.

Terms are runs of letters, marks and digits, by the blocks of Unicode that hold
them. In scripts that don't part words they are all pairs of neighbouring
characters, and the last of a run.

At most mean terms a document / ``RARE`` terms can be in the band, whatever the
number of documents; the lexicon is broadcast if it has at most ``BROADCAST``
bytes and joined by shuffle beyond. Texts are shuffled once by document; under
a broadcast the terms of a document stay where its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import cut, discard, documents, let, pick

RARE, COMMON, BROADCAST = 0.002, 0.2, 64 << 20
#: Of 256 terms how many are in each random subset, on average.
WIDTHS = [*[32] * 2, *[8] * 13, *[2] * 24, *[1] * 24]
# Ranges, as Java finds the class of a character far more slowly than its place.
_BREAK = r"[^a-z0-9\xc0-\u1fff\u2c00-\x{1efff}\x{20000}-\x{3ffff}]+"
_CLOSE = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"
_SLOT, _HASH = 57, (1 << 57) - 1


def _terms(text: Column) -> Column:
    """The distinct terms of a text, and the empty term, which every text has."""

    def of(lower: Column) -> Column:
        pairs = F.concat(F.split(F.regexp_replace(lower, f"{_CLOSE}+", " "), _BREAK), F.regexp_extract_all(lower, F.lit(f"(?=({_CLOSE}{{1,2}})){_CLOSE}"), F.lit(1)))
        close = (F.octet_length(lower) > F.char_length(lower)) & lower.rlike(r"[\u0e00-\x{3ffff}]")
        return F.array_union(F.array(F.lit("")), F.when(close, pairs).otherwise(F.split(lower, _BREAK)))

    # parted at spaces first, which is fast, so that the pattern runs over distinct words
    return let(F.array_join(F.array_distinct(F.split(F.lower(text), " ")), " "), of)


def _keys(term: Column) -> Column:
    """For each random subset that a term is in, its number from 1 before 57 bits of the term's hash."""
    slots = F.filter(F.sequence(F.lit(1), F.lit(len(WIDTHS))), lambda k: F.pmod(F.xxhash64(term, k), F.lit(256)) < F.get(F.array(*map(F.lit, WIDTHS)), k - 1))
    return F.transform(slots, lambda k: F.shiftleft(k.cast("long"), _SLOT).bitwiseOR(F.xxhash64(term).bitwiseAND(F.lit(_HASH))))


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(term, hash, keys) of the terms in the band, from all texts (column text)."""
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    n = texts.count()
    band = counts.where((F.col("df") >= max(2.0, rare * n)) & (F.col("df") <= common * n))
    return cut(band.select("term", F.xxhash64("term").bitwiseAND(F.lit(_HASH)).alias("hash"), _keys(F.col("term")).alias("keys")), "lexicon")


def _order(docs: DataFrame) -> DataFrame:
    """Each document's key with the next one's, by ascending id (nulls first, equal ids by a hash of the text), the last with the first."""
    keys = docs.select("doc_id", "k0", "k1", "n_chars").distinct()
    keys = cut(keys.repartitionByRange("doc_id", "k1").withColumn("part", F.spark_partition_id()), "order")
    by = [F.col("doc_id").asc_nulls_first(), F.col("k1")]
    key = F.struct("k0", "k1")
    keys = keys.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(*by)))
    # one row per partition: what the last document of the partition before has next
    first = keys.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*by))).where("i = 1").select("part", key.alias("head"))
    heads = first.orderBy("part").collect()
    after = {a.part: b.head for a, b in zip(heads, heads[1:] + heads[:1], strict=True)}
    ends = keys.sparkSession.createDataFrame([(p, h.k0, h.k1) for p, h in after.items()], "part int, e0 long, e1 long")
    out = keys.join(F.broadcast(ends), "part")
    return out.select("k0", "k1", "n_chars", F.coalesce("next.k0", "e0").alias("n0"), F.coalesce("next.k1", "e1").alias("n1"))


def _packed(slot: Column, h: Column) -> Column:
    return F.shiftleft(slot, 16).bitwiseOR(h.bitwiseAND(F.lit(0xFFFF))).cast("int")


def _hashes(every: Column, keys: Column) -> Column:
    """For each subset with terms its number before 16 bits of a hash of its sorted terms; those of the random ones in one pass over their sorted keys."""
    none, empty = F.lit(-1).cast("long"), F.array().cast("array<int>")
    first = F.when(F.size(every) > 0, F.array(_packed(F.lit(0).cast("long"), F.xxhash64(every)))).otherwise(empty)
    start = F.struct(none.alias("at"), none.alias("h"), first.alias("out"))
    done = lambda s: F.concat(s["out"], F.array(_packed(s["at"], s["h"])))

    def step(s: Column, x: Column) -> Column:
        slot = F.shiftright(x, _SLOT)
        fresh = F.struct(slot.alias("at"), F.xxhash64(x).alias("h"), F.when(s["at"] < 0, s["out"]).otherwise(done(s)).alias("out"))
        return F.when(s["at"] == slot, F.struct(s["at"].alias("at"), F.xxhash64(s["h"], x).alias("h"), s["out"].alias("out"))).otherwise(fresh)

    return F.when(F.size(keys) > 0, F.aggregate(keys, start, step, done)).otherwise(first)


def _written(hashes: Column, whole: Column) -> Column:
    """Six hexadecimal digits for each subset with terms; else those of the whole text's hash."""
    digits = F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 6, "0")), "")
    return F.when(F.size(hashes) > 0, digits).otherwise(F.concat(F.lit("text:"), F.lpad(F.lower(F.hex(whole)), 16, "0")))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """The share of equal hashes among the subsets that ``a`` or ``b`` has; without any, whether the whole texts are equal."""
    slots = lambda x: F.transform(x, lambda h: F.shiftright(h, 16))
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(slots(a), slots(b)))
    return F.when(F.size(a) + F.size(b) == 0, (whole_a == whole_b).cast("double")).otherwise(share)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id, next_chars for each row.

    The edited text is the text with its last half taken from the start of the
    next document. Null and empty texts are alike. Null ids come first in the
    order, and texts under one id go by a hash. Rows equal in id and text are
    one document in the order, and each comes out. A single document is its own
    next one. Very long texts are read to the end. No rows give none. Columns
    other than the two named are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text.alias("text"))
    docs = docs.withColumns({"k0": F.coalesce("doc_id", F.lit(0).cast("long")), "k1": F.xxhash64(F.col("doc_id").isNull(), "text"), "n_chars": F.char_length("text").cast("long")})
    terms = lexicon(docs.select("text"), rare, common)
    small = (terms.agg(F.sum(F.octet_length("term") + 8 * F.size("keys") + 72)).first()[0] or 0) <= BROADCAST
    order = cut(_order(docs), "next")
    rows, repeats = docs, docs.count() > order.count()
    if repeats:  # rows that repeat would each send their head
        docs = docs.groupBy("k0", "k1").agg(*[F.min(c).alias(c) for c in ("doc_id", "text", "n_chars")])

    half = F.floor(F.col("n_chars") / 2).cast("int")
    before = order.select(F.col("n0").alias("k0"), F.col("n1").alias("k1"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), half.alias("h"))
    # every column of the documents goes on from either side of the two joins, so that one shuffle of the texts serves both
    heads = docs.join(before, ["k0", "k1"]).select(F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.col("k0").alias("n0"), F.col("k1").alias("n1"), F.col("doc_id").alias("next_doc_id"), F.col("n_chars").alias("next_chars"), F.substring(F.col("text"), F.lit(1), F.col("h")).alias("head"))
    both = docs.join(heads, ["k0", "k1"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("head"))
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), edited.alias("t")))
    plain = ["doc_id", "n_chars", "next_doc_id", "next_chars", "n0", "n1"]
    both = both.select("k0", "k1", *plain, F.explode(versions).alias("x")).select("k0", "k1", *plain, "x.v", F.col("x.t").alias("t"))
    # the empty term, which every text has and no lexicon, carries what isn't a term
    both = both.withColumns({"sha256": F.when(F.col("v") == 1, F.unhex(F.sha2("t", 256))), "whole": F.xxhash64("t"), "terms": _terms(F.col("t"))}).drop("t")
    flat = both.withColumn("term", F.explode("terms"))
    flat = flat.select("k0", "k1", "v", "term", F.when(F.col("term") == "", F.struct(*plain, "sha256", "whole")).alias("info"))
    of = lambda v, x: F.first(F.when(F.col("v") == v, x), ignorenulls=True)
    infos = [of(0, F.col("info")).alias("own"), of(1, F.col("info")).alias("edited")]
    keys = [F.collect_list(F.when(F.col("v") == v, F.col("hash"))).alias(f"{c}0") for v, c in enumerate("ab")]
    keys += [F.flatten(F.collect_list(F.when((F.col("v") == v) & (F.size("keys") > 0), F.col("keys")))).alias(c) for v, c in enumerate("ab")]
    terms = terms.select("term", F.coalesce("hash", F.lit(0).cast("long")).alias("hash"), F.transform("keys", lambda k: F.coalesce(k, F.lit(0).cast("long"))).alias("keys"))  # never null, and now typed so
    if small:
        found = flat.join(F.broadcast(terms), "term", "left").groupBy("k0", "k1").agg(*infos, *keys)
    else:  # what isn't a term stays out of the join, where the empty term would be in every document
        flat = cut(flat, "terms")
        found = flat.where("term <> ''").join(terms, "term").groupBy("k0", "k1").agg(*keys)
        found = flat.where("term = ''").groupBy("k0", "k1").agg(*infos).join(found, ["k0", "k1"], "left")
    none = F.array().cast("array<bigint>")
    # sorted in a projection of its own, where that is compiled code
    found = found.select("k0", "k1", *[f"own.{c}" for c in (*plain, "whole")], "edited.sha256", F.col("edited.whole").alias("edited_whole"), *[F.sort_array(F.coalesce(c, none)).alias(c) for c in ("a0", "b0", "a", "b")])
    found = found.withColumns({c: _hashes(F.col(f"{c}0"), F.col(c)) for c in "ab"}).drop("a0", "b0")
    found = cut(found, "fingerprints")
    if not small:
        discard(flat)

    nexts = found.select(F.col("k0").alias("n0"), F.col("k1").alias("n1"), F.col("a").alias("c"), F.col("whole").alias("next_whole"))
    out = found.join(nexts, ["n0", "n1"])
    if repeats:
        out = rows.select("k0", "k1").join(cut(out, "found"), ["k0", "k1"])
    near = lambda x, whole: likeness(F.col("a"), F.col(x), F.col("whole"), F.col(whole))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha256")).alias("edited_sha256"), _written(F.col("a"), F.col("whole")).alias("fingerprint"), _written(F.col("b"), F.col("edited_whole")).alias("edited_fingerprint"),
        near("b", "edited_whole").alias("near_edited"), near("c", "next_whole").alias("near_next"), "next_doc_id", "next_chars",
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
