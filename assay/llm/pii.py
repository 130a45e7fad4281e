"""Personal data: exact base patterns, and more found from the contexts that they stand in.

Base spans come from four regular expressions with checks (``KINDS``). Java's
engine recurses on repeated groups and restarts at every character, so the
patterns here are rewritten with possessive repeats and may only begin at the
end of the last match or at the edge of a run; each still matches exactly what
the plain pattern does, in linear time.

Bootstrapped extraction: a mention is a run of words with a digit or an at
sign. Mentions that hold a base span are seeds of its kind, those that match
the seed pattern of a further kind (``SECRETS``) are seeds of that, and the
words around a mention are its patterns. In each round a pattern's confidence
for a kind is the share of its distinct instances that are known to be of that
kind (patterns with fewer than ``support`` of them count for nothing), an
unknown instance's score is the mean over its patterns, and those that reach
``trust`` become known, until a round finds nothing new. Only instances that
look like their kind can be learned. The graph is (pattern, instance) edges in
tables; nothing of it reaches the driver but whether there are new instances.
"""

from __future__ import annotations


from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents, let, whole_text

KINDS = ("email", "ip", "card", "phone")
SUPPORT, TRUST, BLOCK, WINDOW = 5, 0.8, 64, 80
#: A further kind: what its seeds look like, and what can be learned as one.
SECRETS = {"secret": (r"^[0-9a-f]{32,}$", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z+/_=-]{20,}$")}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
Kinds = dict[str, tuple[str, str]]
MENTION = r"(?<!\S)(?=\S*?[0-9@])\S++(?:\x20(?=\S*?[0-9@])\S++)*+"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    of = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(of, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _running(lengths: Column) -> Column:
    """The sums of all earlier elements, in blocks, so that long arrays cost little more than their length."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    push = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))

    def sums(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(lengths, at + 1, BLOCK))
        return let(blocks, within)

    def within(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), F.array(zero), push)
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(F.aggregate(b, F.array(s), push), 1, F.size(b))))

    return let(lengths, sums)


def _is_valid(kind: str, x: Column) -> Column:
    return _valid(kind, x["value"])


def _of_kind(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def _named(kind: str, x: Column) -> Column:
    return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("start"), x["start"], F.lit("end"), x["end"])


_SPANS = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def _spans(text: Column, pattern: str, context: bool) -> Column:
    """All matches with code point offsets; with ``context``, also the gaps to the matches on both sides, or as much of them as holds their nearest words."""
    of = F.lit(pattern)

    def build(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
        # the gap before a match ends where it starts
        pieces = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h"), _running(lengths).alias("s"))

        def span(x: Column) -> Column:
            start = x["s"] + F.char_length(x["g"])
            sides = [_near(x["g"], F.right), _near(x["h"], F.left)] if context else [F.lit(None).cast("string")] * 2
            return F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"), x["m"].alias("value"), sides[0].alias("left"), sides[1].alias("right"))

        return F.transform(pieces, span)

    def some(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), partial(build, found))).otherwise(F.array().cast(_SPANS))

    return let(F.regexp_extract_all(text, of, F.lit(0)), some)


def _words(gap: Column) -> Column:
    """The words of a gap: in lower case, letters and a few signs only."""
    return F.filter(F.split(F.lower(F.regexp_replace(gap, r"[^\p{L}\p{M}\s:=#]+", "")), r"\s+"), lambda w: w != "")


def _near(gap: Column, end: Callable[[Column, Column], Column]) -> Column:
    """The end of a gap that faces the match: a few characters where they hold three words, of which two then are whole, else all of it."""
    part = end(gap, F.lit(WINDOW))
    return F.when(F.size(_words(part)) >= 3, part).otherwise(gap)


def _found(df: DataFrame, text: str, mentions: bool) -> DataFrame:
    """``df`` with the base spans of column ``text`` by kind, and its mentions. Each is skipped where a character that it needs is absent."""
    t = F.col(text)
    needs = {"email": t.contains("@"), "phone": t.contains("+")}
    df = df.withColumn("__digits", t.rlike("[0-9]"))
    for kind in KINDS:
        spans = F.filter(_spans(t, PATTERNS[kind], False), partial(_is_valid, kind))
        df = df.withColumn(f"__{kind}", F.when(needs.get(kind, F.col("__digits")), F.transform(spans, lambda x: F.struct(x["start"], x["end"]))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))
    if mentions:
        df = df.withColumn("__mentions", F.when(F.col("__digits") | needs["email"], _spans(t, MENTION, True)).otherwise(F.array().cast(_SPANS)))
    return df.drop("__digits")


def _looks_like(kind: Column, value: Column, extra: Kinds) -> Column:
    """Whether an instance has the general shape of its kind."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    shapes = {
        "email": value.rlike(r"^[^@\s]+(?:@|\(at\)|\[at\])[^@\s]+$"),
        "ip": value.rlike(r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$"),
        "card": n.between(12, 19) & value.rlike(r"^[0-9][0-9\x20.-]*$"),
        "phone": n.between(6, 15) & value.rlike(r"^[+(]?[0-9][0-9\x20()./-]*$"),
    } | {k: value.rlike(shape) for k, (_, shape) in extra.items()}
    out = F.lit(False)
    for name, shape in shapes.items():
        out = F.when(kind == name, shape).otherwise(out)
    return out


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a mention: the two words before it, the word before and the one after, and the two after."""
    last = lambda a, i: F.coalesce(F.get(a, F.size(a) - i), F.lit("^"))
    first = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit("$"))

    def of(x: Column) -> Column:
        before, after = x["b"], x["a"]
        return F.array(F.concat_ws(" ", last(before, 2), last(before, 1), F.lit("_")), F.concat_ws(" ", last(before, 1), F.lit("_"), first(after, 0)), F.concat_ws(" ", F.lit("_"), first(after, 0), first(after, 1)))

    return let(F.struct(_words(left).alias("b"), _words(right).alias("a")), of)


_BEFORE, _AFTER = r"^[^0-9A-Za-z+(]+", r"[^0-9A-Za-z)]+$"


def _value(mention: Column) -> Column:
    """A mention's text without the signs around it."""
    return F.regexp_replace(F.regexp_replace(mention, _BEFORE, ""), _AFTER, "")


def _kind(base: Column, mention: Column, extra: Kinds) -> Column:
    """The kind of the first base span that overlaps a mention, or the further kind whose seed it is."""
    inside = F.filter(base, lambda b: (b["start"] < mention["end"]) & (b["end"] > mention["start"]))
    other = F.lit(None).cast("string")
    for name, (seed, _) in extra.items():
        other = F.when(_value(mention["value"]).rlike(seed), F.lit(name)).otherwise(other)
    return F.coalesce(F.get(inside, F.lit(0))["kind"], other)


def bootstrap(mentions: DataFrame, extra: Kinds | None = None, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """Written ``mentions`` (value, kind or null, patterns) to (value, learned): the instances newly known, and as what.

    Of kinds that reach ``trust`` the one with the largest score, number of
    patterns and then name counts. Rounds end when one learns nothing, which
    they must as instances are finite. No mentions give no rows.
    """
    extra = extra or {}
    kinds = [*KINDS, *extra]
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value", "kind")
    # what one pattern sees of one value, however often: the kind of its seeds, or none
    known = cut(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    learned = None
    while True:
        seen = known.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
        top = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("kind")) for k in kinds])
        scored = seen.select("pattern", "n", top.alias("top")).where(F.col("top.n") >= support)
        # written, so that Spark sees its size and may split common patterns over tasks
        scored = cut(scored.select("pattern", F.col("top.kind").alias("of"), (F.col("top.n") / F.col("n")).alias("confidence")), "patterns")
        hopes = known.where("kind is null").join(scored, "pattern").where(_looks_like(F.col("of"), F.col("value"), extra))
        # sums of rounded parts don't depend on their order
        new = hopes.groupBy("value", "of").agg((F.sum(F.round(F.col("confidence") * (1 << 40)).cast("long")) / F.count("*") / float(1 << 40)).alias("score"), F.count("*").alias("patterns")).where(F.col("score") >= trust)
        new = cut(new.groupBy("value").agg(F.max(F.struct("score", "patterns", "of")).alias("best")).select("value", F.col("best.of").alias("learned")), "learned")
        if new.isEmpty():
            return new if learned is None else learned
        learned = new if learned is None else cut(learned.unionAll(new), "learned")
        known = cut(known.join(new, "value", "left").select("pattern", "value", F.coalesce("kind", "learned").alias("kind")), "graph")


def find_pii(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, extra: Kinds | None = None, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """The columns ``keep`` (all if None) with ``base`` and ``more``: arrays of (kind, start, end), offsets in code points.

    ``base`` has the exact matches by kind as listed, then start; ``more`` the
    spans of ``extra`` kinds and those found by context, by kind and start, none
    of which overlaps a base span. ``extra`` maps a kind's name to the patterns
    of its seeds and of what can be learned. Null and empty texts have neither.
    Very long texts are read to the end. Repeated rows each come out, with equal
    spans. No rows give none. Columns named base and more are replaced; no other
    can clash.
    """
    extra = extra or {}
    kinds = [*KINDS, *extra]
    names = [c for c in (df.columns if keep is None else keep) if c not in ("base", "more")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text_col}`").alias("__t")).withColumn("__t", whole_text("__t"))
    rows = _found(rows, "__t", True).drop("__t").withColumn("__key", F.monotonically_increasing_id())
    rows = rows.withColumn("__base", F.concat(*[F.transform(F.col(f"__{k}"), partial(_named, k)) for k in KINDS])).drop(*[f"__{k}" for k in KINDS])

    def mention(m: Column) -> Column:
        start = m["start"] + F.char_length(F.regexp_extract(m["value"], _BEFORE, 0))
        return F.struct(start.alias("start"), (start + F.char_length(_value(m["value"]))).alias("end"), _kind(F.col("__base"), m, extra).alias("kind"), _value(m["value"]).alias("value"), _patterns(m["left"], m["right"]).alias("patterns"))

    rows = rows.withColumn("__mentions", F.filter(F.transform("__mentions", mention), lambda m: m["value"] != ""))
    # never null, so that each row is on one side
    learnable = lambda m: F.exists(F.array(*map(F.lit, kinds)), lambda k: F.coalesce(_looks_like(k, m["value"], extra), F.lit(False)))
    maybe = lambda m: F.when(m["kind"].isNull(), learnable(m)).otherwise(m["kind"].isin(*extra) if extra else F.lit(False))
    rows = rows.withColumn("__hope", F.coalesce(F.exists("__mentions", maybe), F.lit(False)))
    rows = cut(rows, "spans")  # one pass over the texts; from here on the keys are fixed

    mentions = rows.where(F.size("__mentions") > 0).select(F.col("__key").alias("key"), F.explode("__mentions").alias("m")).select("key", "m.*")
    mentions = cut(mentions, "mentions")
    learned = bootstrap(mentions, extra, support, trust)
    found = mentions.where("kind is null").join(learned, "value").select("key", "start", "end", F.col("learned").alias("kind"))
    if extra:
        found = found.unionAll(mentions.where(F.col("kind").isin(*extra)).select("key", "start", "end", "kind"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    more = cut(found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(order.alias("k"), "start", "end", "kind"))).alias("more")), "more")
    more = more.select(F.col("key").alias("__of"), F.transform("more", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("more"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = lambda rows, more: rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in names], F.col("__base").alias("base"), more.alias("more"))
    # rows without a mention that could have been learned take no part in the join
    hopeful = rows.where("__hope").join(more, F.col("__key") == F.col("__of"), "left")
    return out(rows.where("not __hope"), none).unionAll(out(hopeful, F.coalesce("more", none)))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def _by_kind(*arrays: str) -> Column:
    """Spans of several arrays by kind as listed, then start."""
    every = F.concat(*arrays)
    return F.concat(*[F.array_sort(F.filter(every, partial(_of_kind, k))) for k in KINDS])


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", extra: Kinds | None = None) -> DataFrame:
    """All columns of ``docs``, each span in ``text_col`` replaced by its kind in capitals and brackets, ``size_col`` counted anew where that happened.

    Spans that overlap become one mark, of the kind that starts first. Null and
    empty texts stay as they are, as do those without spans. Very long texts are
    masked to the end. Nulls in other columns stay, repeated rows each come out,
    no rows give none, and no column's name can clash.
    """
    packed = docs.select(F.struct("*").alias("__doc"), F.col(f"`{text_col}`").alias("__text"))
    spans = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = find_pii(packed, "__text", keep=["__doc"], extra=extra).select(F.col("__doc").alias("__row"), spans.alias("__spans"))
    text = F.col(f"__row.`{text_col}`").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, x: Column) -> Column:
        # a span that overlaps the one before only lengthens what is taken out
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(x["start"] - state["at"], F.lit(0).cast("long")).cast("int"))
        mark = F.when(x["start"] >= state["at"], F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], mark).alias("out"), F.greatest(state["at"], x["end"]).alias("at"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    clean = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, step, rest)).otherwise(text)
    out = found.select("__row", "__spans", clean.alias("__clean"))
    changed = {text_col: F.col("__clean"), size_col: F.when(F.size("__spans") > 0, F.char_length("__clean").cast("long")).otherwise(F.col(f"__row.`{size_col}`")) if size_col in docs.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(_by_kind("base", "more")).alias("spans"))
