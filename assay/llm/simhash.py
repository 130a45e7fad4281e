"""Near-duplicate documents by SimHash fingerprints.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Two
fingerprints that differ in d bits are at most d apart there in Manhattan
distance, so that distance is a lower bound. The range join within radius 2
runs over a grid: the 32 counts form 8 blocks, and two points within radius 2
agree on at least 6 of them, so they share one of the 28 cells that leave two
blocks out. Pairs in a cell pass the Manhattan bound, then the exact distance.

Cells are sparse: 28 of them hash some 36 random bits each, so the number of
chance pairs stays far under the number of documents. Cells with more than
``crowd`` distinct fingerprints (families of near copies) are never paired:
their members emit the points within half the radius (65 of one bit), and all that
share a point are linked to the least of them. Two fingerprints within the
radius always share such a point, so nothing is lost, and the work is linear in
the members.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents, pick
from assay.llm.components import connected_components

WORDS, SEED, RADIUS, BLOCKS = 3, 42, 2, 8
_LOW_BITS = 0x5555555555555555
#: Bits of the filter that spares texts a shuffle (8 MB, whatever the input), and how many of them a row of it holds.
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 15


def _words(data: bytes, chunk: int) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those in about ``chunk`` bytes."""
    at, space = 0, re.compile(rb"[ \t-\r]")
    while at < len(data):
        end = space.search(data, at + chunk)
        end = end.start() if end else len(data)
        if found := data[at:end].split():
            yield found
        at = end


def fingerprint(text: str | None, words: int = WORDS, chunk: int = 1 << 20) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for null or a text without words.

    Memory beyond the text goes with ``chunk``, not with the text.
    """
    # bytes.lower changes A-Z only, and bytes.split cuts at space and \t to \r only
    ones, count, carried = np.zeros(64, dtype=np.int64), 0, []
    for found in _words((text or "").encode("utf-8", "surrogatepass").lower(), chunk):
        carried += found
        if len(carried) >= words:
            count += _add(map(b" ".join, zip(*(carried[i:] for i in range(words)), strict=False)), len(carried) - words + 1, ones)
            carried = carried[len(carried) - words + 1 :]
    if not count and carried:
        count = _add([b" ".join(carried)], 1, ones)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _add(shingles: Iterable[bytes], n: int, ones: np.ndarray) -> int:
    """Count the set bits of the shingles' hashes into ``ones``."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return n


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, h0, h1, fp): id, two hashes of id and text that tell rows apart, and the signed 64 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], dtype="<u8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h0", "h1")), pa.array(found.view("<i8"))], names=["doc_id", "h0", "h1", "fp"])

    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), *_hashes("doc_id", "text"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, h0 long, h1 long, fp long")


def _hashes(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of a row's id and text; they never are null."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    blank = key.isNull().cast("int") + text.isNull().cast("int") * 2
    return [F.xxhash64(F.lit(k), blank, key, text).alias(f"h{k}") for k in range(2)]


def near_links(fps: DataFrame, crowd: int = 64, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all within ``radius`` differing bits (0 to 4)."""
    if not 0 <= radius <= 4:
        raise ValueError("the grid takes radii from 0 to 4")
    mask = F.lit(_LOW_BITS)
    high = F.shiftrightunsigned("fp", 1)
    both, any_ = high.bitwiseAND(F.col("fp")).bitwiseAND(mask), high.bitwiseOR(F.col("fp")).bitwiseAND(mask)
    # each segment's count in unary (00, 01, 11): the Manhattan distance is then the bit count of an xor
    points = fps.select("fp", F.shiftleft(both, 1).bitwiseOR(any_).alias("at"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(0xFF << (64 // BLOCKS * b) for b in kept)) for kept in combinations(range(BLOCKS), BLOCKS - radius)]
    cells = points.select("fp", "at", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("k", "mask"))
    cells = cells.select("k", F.col("at").bitwiseAND(F.col("mask")).alias("cell"), "fp", "at")
    shared = cut(cells.groupBy("k", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("top")).where("n > 1"), "cells")

    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = shared.where("n = 2").select(F.col("low").alias("a"), F.col("top").alias("b")).where(apart <= radius)
    crowded = cut(cells.join(shared.where("n > 2").select("k", "cell", "n"), ["k", "cell"]), "crowded")
    few = crowded.where(f"n <= {crowd}")
    left, right = (few.select("k", "cell", F.col("fp").alias(f), F.col("at").alias(p)) for f, p in (("a", "p"), ("b", "q")))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius) & (apart <= radius)
    more = left.join(right, ["k", "cell"]).where(near).select("a", "b")

    many = crowded.where(f"n > {crowd}").select("fp").distinct()
    flips = F.array(*[F.lit(signed(sum(1 << i for i in x))).cast("long") for n in range(-(-radius // 2) + 1) for x in combinations(range(64), n)])
    ball = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    heads = ball.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = ball.join(heads, "point").select("a", F.col("fp").alias("b")).where("a <> b").where(apart <= radius)
    return pairs.unionAll(more).unionAll(stars).distinct()


def _components(docs: DataFrame, crowd: int, radius: int) -> DataFrame:
    """Written fingerprints to (fp, n, first, linked): rows that have it, and the first row (id, hashes) of all that it is linked with.

    Fingerprints are distinct here, so a group of copies of any size costs one
    row in the joins. Rows are ordered by id, nulls last, then by hashes.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "h0", "h1")).alias("first")
    groups = cut(docs.groupBy("fp").agg(first, F.count("*").alias("n")), "groups")
    stars = connected_components(near_links(groups.select("fp"), crowd, radius))
    nodes = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    nodes = cut(nodes.join(groups.select("fp", "first"), "fp"), "nodes")
    roots = cut(nodes.groupBy("root").agg(F.min("first").alias("of_all")), "roots")
    linked = nodes.join(roots, "root").select("fp", "of_all")
    return groups.join(linked, "fp", "left").select("fp", "n", F.coalesce("of_all", "first").alias("first"), F.col("of_all").isNotNull().alias("linked"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    ``component_id`` is the least id reachable over links of at most ``radius``
    differing bits. Null, empty and wordless texts have fingerprint 0 and link
    like any other. Null ids get their component's least id, null if it has
    none. Repeated rows and rows of one id each come out. Very long texts are
    read in parts, to the end. No rows give none. Columns other than the two
    named are not read, so their names cannot clash.
    """
    docs = cut(fingerprints(df, id_col, text_col, words), "fingerprints")
    # only fingerprints of several rows need a lookup; the rest are their own components
    known = _components(docs, crowd, radius).where("n > 1 or linked").select("fp", F.col("first.doc_id").alias("component_id"), F.lit(True).alias("known"))
    known = cut(known, "components")
    return docs.join(known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _split(keyed: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` that are not in ``wanted`` (written keys) for sure, and the others.

    A bitmap of fixed size is broadcast, so that only the others' texts need a
    shuffle. Where keys are so many that most bits are set, most rows are among
    the others, and the result of a join with them is the same.
    """
    spot = F.pmod(F.col("__h0"), F.lit(FILTER_BITS))
    page, at = F.floor(spot / PAGE_BITS).cast("int"), spot.bitwiseAND(F.lit(PAGE_BITS - 1)).cast("int")
    bits = cut(wanted.groupBy(page.alias("__page")).agg(F.bitmap_construct_agg(at).alias("__bits")), "bits")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = keyed.withColumn("__page", page).join(F.broadcast(bits), "__page", "left").withColumn("__maybe", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)))
    return tuple(marked.where(x).drop("__page", "__bits", "__maybe") for x in ("not __maybe", "__maybe"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns: that of the least id.

    Rows are told apart by id and text, never by id alone: of different texts
    under one id each is judged by its own group. Among rows of the least id
    the one with the least hash of its text stays; a null id stays only where
    its group has no other. Of rows equal in id and text the one whose JSON has
    the least SHA-256 stays. Null, empty and wordless texts are one group. Very
    long texts are read to the end. No rows give none. Names beginning with
    ``__`` aside, no column's name can clash, and columns may have any type.
    """
    found = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    known = cut(_components(found, crowd, radius).where("n > 1 or linked").select("fp", "first"), "components")
    stays = (F.col("h0") == F.col("first.h0")) & (F.col("h1") == F.col("first.h1"))
    rows = found.join(known, "fp").select("h0", "h1", stays.alias("stays"))
    rows = cut(rows.groupBy("h0", "h1", "stays").agg(F.count("*").alias("n")), "rows")
    keys = ["__h0", "__h1"]
    keyed = docs.withColumns(dict(zip(keys, _hashes(id_col, text_col), strict=True)))
    named = lambda df: df.select(F.col("h0").alias("__h0"), F.col("h1").alias("__h1"))
    # most rows are alone and stay; the joins take only those that may not be
    usual, rest = _split(keyed, named(rows.where("not stays or n > 1")))
    kept = rest.join(named(rows.where("not stays")), keys, "left_anti")
    again = cut(named(rows.where("stays and n > 1")), "again")
    if again.isEmpty():
        return usual.unionByName(kept).drop(*keys)
    once = usual.unionByName(kept.join(again, keys, "left_anti")).drop(*keys)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, keys, "left_semi").select(*keys, row.alias("__row"))
    one = one.groupBy(*keys).agg(F.min_by("__row", F.sha2(F.to_json("__row"), 256)).alias("__row"))
    return once.unionByName(one.select("__row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
