"""Language identification by interpolated Kneser-Ney character models.

One model per language, for every label that has rows, learned from a bounded
sample: of the ``buckets`` hash buckets of each language the row with the least
id, and of its text at most ``row_chars`` code points from a place that a hash
of the id gives (fewer where languages are so many that all would exceed
``chars``). A model is kept as sorted arrays of 64-bit n-gram hashes with
probabilities and back-off weights. N-grams of the highest order that any
language has seen are scored for every language once (the commonest ``TABLE``
scores of them), so that most positions of a text need one lookup; the others
go down the orders, to the same values. Every character of a text is scored,
long texts in slices that overlap by the context an n-gram needs, so that the
cuts change nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents, pick

ORDER, BUCKETS, ROW_CHARS, CHARS, DISCOUNT, SPACE, SLICE, TABLE = 4, 256, 1 << 14, 1 << 25, 0.75, 32, 1 << 17, 1 << 26
#: Rows of the sample's ids that are broadcast at most; beyond that they are joined by shuffle.
BROADCAST = 1 << 20
#: Calibration of rejection: excerpts of a text for each length, log2 of the longest, fewest that a quantile is taken of, and the quantiles.
EXCERPTS, LONGEST, FEWEST, OWN, OTHERS = 8, 12, 20, 0.995, 0.05
UNKNOWN = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself if it is a letter or mark and a space otherwise; whether it is a letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    mark = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(letter | mark, np.arange(0x110000), SPACE).astype(np.uint32), letter


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _normal(codes: np.ndarray, order: int) -> np.ndarray:
    """Letters with single spaces between words, after the padding that the first n-grams need."""
    codes = np.concatenate([np.full(order - 1, SPACE, np.uint32), _letters()[0][codes], np.array([SPACE], np.uint32)])
    keep = np.ones(len(codes), bool)
    keep[order:] = (codes[order:] != SPACE) | (codes[order - 1 : -1] != SPACE)
    keep[order - 1] &= codes[order - 1] != SPACE
    return codes[keep]


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position from ``order - 1`` on, for n from 0 to ``order``, and of their contexts."""
    wide, out = codes.astype(np.uint64), [np.zeros(max(0, len(codes) - order + 1), np.uint64)]
    total = np.zeros(len(wide), np.uint64)
    for n in range(order):
        total = total.copy()
        total[n:] += (wide[: len(wide) - n] + np.uint64(1)) * _MIX[n]
        x = total ^ (total >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        out.append(x ^ (x >> np.uint64(32)))
    return out


class Sorted:
    """A sorted array of hashes with values, and where each leading 16 bits begin."""

    BITS = 16

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[by], values[by]
        self.index()

    def index(self) -> None:
        edges = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.starts = np.searchsorted(self.keys, edges).astype(np.int64)
        self.most = int(np.diff(np.append(self.starts, len(self.keys))).max(initial=0))
        self.padded = np.append(self.keys, np.zeros(1, np.uint64))

    def __getstate__(self) -> tuple:
        return self.keys, self.values

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.values = state
        self.index()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.starts[keys >> np.uint64(64 - self.BITS)]
        if self.most > 6:
            at = np.searchsorted(self.keys, keys)
            return np.where(self.padded[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)
        found = np.where((self.padded[at] == keys) & (at < len(self.keys)), at, -1)
        left = np.flatnonzero(found < 0)
        for _ in range(1, self.most):
            at_left = np.minimum(at[left] + 1, len(self.keys))
            at[left] = at_left
            hit = (self.padded[at_left] == keys[left]) & (at_left < len(self.keys))
            found[left[hit]] = at_left[hit]
            left = left[~hit]
        return found


class KneserNey:
    """Interpolated Kneser-Ney over the characters of some texts."""

    def __init__(self, texts: list[str], order: int = ORDER) -> None:
        self.order = order
        parts = [_normal(code_points(t), order) for t in texts] or [np.full(order, SPACE, np.uint32)]
        grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        contexts: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        for codes in parts:
            for n, hashes in enumerate(_grams(codes, order)):
                if n:
                    grams[n].append(hashes[order - 1 :])
                if n < order:
                    contexts[n + 1].append(hashes[order - 2 : len(codes) - 1] if n else np.zeros(len(codes) - order + 1, np.uint64))
        at = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in grams]
        before = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in contexts]
        self.base = 1.0 / (1 + len(np.unique(at[1])))
        _, where, counts = np.unique(at[order], return_index=True, return_counts=True)
        kinds = {order: (where, counts)}
        for n in range(order - 1, 0, -1):  # below the highest order, an n-gram counts once for each letter seen before it
            _, first, counts = np.unique(at[n][where], return_index=True, return_counts=True)
            where = where[first]
            kinds[n] = where, counts
        self.grams: list[Sorted | None] = [None]
        self.weights: list[Sorted | None] = [None]
        for n in range(1, order + 1):
            where, counts = kinds[n]
            context, of, types = np.unique(before[n][where], return_inverse=True, return_counts=True)
            total = np.bincount(of, weights=counts, minlength=len(context))
            back = DISCOUNT * types / np.maximum(total, 1)
            lower = self.base if n == 1 else self.grams[n - 1].values[self.grams[n - 1].find(at[n - 1][where])]
            self.grams.append(Sorted(at[n][where], (counts - DISCOUNT) / total[of] + back[of] * lower))
            self.weights.append(Sorted(context, back))

    def probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[1]), self.base)
        for n in range(1, self.order + 1):
            for table, keys, seen in ((self.weights[n], contexts[n], False), (self.grams[n], grams[n], True)):
                at = table.find(keys)
                if len(table.keys):
                    p = np.where(at >= 0, table.values[at] * (1.0 if seen else p), p)
        return p


class Identifier:
    """The models of some languages, and the score table that they share."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER) -> None:
        """Every fifth text calibrates what is rejected; the rest train."""
        self.order, self.languages = order, sorted(samples)
        self.models = [KneserNey([t for i, t in enumerate(samples[x]) if i % 5 or len(samples[x]) < 5], order) for x in self.languages]
        every: dict[int, tuple] = {}
        for name in self.languages:
            codes = [_normal(code_points(t), order) for t in samples[name]]
            for part in codes:
                grams, contexts = self._both(part)
                _, first = np.unique(grams[order], return_index=True)
                every[len(every)] = tuple(x[first] for x in (*grams, *contexts))
        self.table = None
        if every:
            columns = [np.concatenate(x) for x in zip(*every.values(), strict=True)]
            _, first, texts = np.unique(columns[order], return_index=True, return_counts=True)
            if len(first) > (most := max(1, TABLE // len(self.languages))):
                first = first[np.argsort(-texts, kind="stable")[:most]]
            columns = [x[first] for x in columns]
            scores = self._all(columns[: order + 1], columns[order + 1 :])
            self.table = Sorted(columns[order], scores)
        self._calibrate(samples)

    def _both(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hashes, n = _grams(codes, self.order), len(codes) - self.order + 1
        grams = [np.zeros(n, np.uint64), *(h[self.order - 1 :] for h in hashes[1:])]
        contexts = [np.zeros(n, np.uint64), np.zeros(n, np.uint64), *(h[self.order - 2 : len(codes) - 1] for h in hashes[1:-1])]
        return grams, contexts

    def _all(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.log(np.maximum(m.probability(grams, contexts), 1e-12)) for m in self.models], axis=1).astype(np.float32)

    def _scored(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For normal text after its context: the log-likelihood of every character scored by language, and how many each array has."""
        sizes = np.array([len(c) - self.order + 1 for c in parts])
        codes = np.concatenate(parts)
        ends = np.cumsum([len(c) for c in parts])
        hashes = _grams(codes, self.order)
        real = np.ones(len(codes), bool)  # not the context
        for i in range(self.order - 1):
            real[ends - [len(c) for c in parts] + i] = False
        top = hashes[self.order][real]
        at = self.table.find(top)
        scores = self.table.values[at]
        if len(missed := np.flatnonzero(at < 0)):
            _, first, of = np.unique(top[missed], return_index=True, return_inverse=True)
            places = np.flatnonzero(real)[missed[first]]
            grams = [np.zeros(len(places), np.uint64), *(h[places] for h in hashes[1:])]
            contexts = [grams[0], grams[0], *(h[places - 1] for h in hashes[1:-1])]
            scores[missed] = self._all(grams, contexts)[of]
        return scores, sizes

    def totals(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each array of normal text after its context: the log-likelihood by language, and the number of characters scored."""
        scores, sizes = self._scored(parts)
        out = np.zeros((len(parts), len(self.languages)))
        starts, some = np.cumsum(sizes) - sizes, sizes > 0
        if some.any():
            out[some] = np.add.reduceat(scores, starts[some], axis=0, dtype=np.float64)
        return out, sizes

    def _excerpts(self, codes: np.ndarray) -> list[np.ndarray]:
        """The cross-entropies by language of up to ``EXCERPTS`` excerpts of 2^k characters, for each k up to ``LONGEST``."""
        scores, sizes = self._scored([_normal(codes, self.order)])
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(scores, axis=0, dtype=np.float64)])
        out = []
        for k in range(LONGEST + 1):
            many = min(EXCERPTS, int(sizes[0]) >> k)
            at = np.linspace(0, sizes[0] - (1 << k), many).astype(np.int64) if many else np.zeros(0, np.int64)
            out.append((sums[at] - sums[at + (1 << k)]) / (1 << k))
        return out

    def _calibrate(self, samples: dict[str, list[str]]) -> None:
        """``limits``: the cross-entropy above which a text of 2^k characters is rejected, by language and k.

        It lies halfway between a high quantile of the language's own excerpts
        of that length, from texts kept apart, and a low one of those of other
        languages, each of which counts where this language would be taken for
        it were it unknown. Where others are no closer than halfway to the same
        texts with their letters shuffled, as with other scripts or no other
        language, that takes their place. It is never below the own quantile.
        """
        count = len(self.languages)
        self.limits = np.zeros((count, LONGEST + 1))
        own: list[list[np.ndarray]] = [[np.zeros(0)] * (LONGEST + 1)] * count
        other: list[list[list[np.ndarray]]] = [[[] for _ in range(LONGEST + 1)] for _ in range(count)]
        middle, mixed = np.zeros(count), np.zeros(count)
        for i, name in enumerate(self.languages):
            apart = [code_points(t) for k, t in enumerate(samples[name]) if not k % 5 or len(samples[name]) < 5]
            found = [np.concatenate(x) for x in zip(*map(self._excerpts, apart), strict=True)]
            own[i] = [h[:, i] for h in found]
            for k, h in enumerate(found):
                if count > 1 and len(h):
                    h = h.copy()
                    h[:, i] = np.inf
                    best = h.argmin(axis=1)
                    for j in np.unique(best):
                        other[j][k].append(h[best == j, j])
            totals, sizes = self.totals([_normal(c, self.order) for c in apart])
            middle[i] = -totals[:, i].sum() / max(1, sizes.sum())
            totals, sizes = self.totals([_normal(np.random.default_rng(0).permutation(np.concatenate(apart)), self.order)])
            mixed[i] = -totals[0, i] / max(1, sizes[0])
        for i in range(count):
            most = far = limit = np.inf
            for k in range(LONGEST + 1):
                if len(own[i][k]) >= FEWEST or not k:  # else as for shorter texts
                    most = float(np.quantile(own[i][k], OWN)) if len(own[i][k]) else np.inf
                    far = (middle[i] + mixed[i]) / 2
                    rest = np.concatenate(other[i][k]) if other[i][k] else np.zeros(0)
                    if len(rest) >= FEWEST:
                        far = min(far, float(np.quantile(rest, OTHERS)))
                    limit = max(most, (most + far) / 2)
                self.limits[i, k] = limit

    def limit(self, language: int, n: int) -> float:
        """The cross-entropy above which a text of ``n`` characters is rejected."""
        return float(np.interp(np.log2(n), np.arange(LONGEST + 1), self.limits[language]))

    def identify(self, texts: list[str | None] | pa.Array) -> list[tuple[str, float, float, bool]]:
        """Language, score, cross-entropy and whether rejected, for each text."""
        letters, parts, of = _letters()[1], [], []
        heard = np.zeros(len(texts), bool)
        likely, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        held = 0

        def score() -> None:
            if parts:
                totals, n = self.totals(parts)
                np.add.at(likely, of, totals)
                np.add.at(sizes, of, n)
                parts.clear(), of.clear()

        for i, text in enumerate(texts):
            codes = code_points(text.as_py() if isinstance(text, pa.Scalar) else text)
            heard[i] = bool(letters[codes].any())
            if heard[i] and self.languages:
                clean = _normal(codes, self.order)
                for at in range(0, len(clean) - self.order + 1, SLICE):
                    parts.append(clean[at : at + SLICE + self.order - 1]), of.append(i)
                    held += len(parts[-1])
                    if held >= SLICE:
                        score()
                        held = 0
        score()
        out = []
        for i in range(len(texts)):
            if not heard[i] or not self.languages:
                out.append((UNKNOWN, 0.0, 0.0, not heard[i]))
                continue
            n = max(1, int(sizes[i]))
            h = -likely[i] / n
            best = int(h.argmin())
            # the posterior of an excerpt of 64 characters at most: whole texts would all give 1
            odds = np.exp((h[best] - h) * min(n, 64))
            out.append((self.languages[best], float(1 / odds.sum()), float(h[best]), bool(h[best] > self.limit(best, n))))
        return out


def learn(df: DataFrame, buckets: int = BUCKETS, row_chars: int = ROW_CHARS, chars: int = CHARS, order: int = ORDER) -> Identifier:
    """``df``: doc_id, text, lang of the rows to learn from.

    At most ``buckets`` rows a language reach the driver, and of them at most
    about ``chars`` code points together, however many languages there are (but
    256 a row are always taken). Rows without id or language teach nothing; of
    rows that share both, the one with the least text counts.
    """
    named = df.where("lang is not null and doc_id is not null")
    ids = named.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")
    ids = cut(ids, "sample")
    size = ids.agg(F.count("*").alias("rows"), F.count_distinct("lang").alias("languages")).first()
    width = max(256, min(row_chars, chars // max(1, size.languages * buckets)))
    rows = named.join(F.broadcast(ids) if size.rows <= BROADCAST else ids, ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    spare = F.greatest(F.char_length("text") - width, F.lit(0)).cast("long") + 1
    rows = rows.select("lang", "doc_id", F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), spare) + 1).cast("int"), F.lit(width)).alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.lang, r.doc_id)):
        samples.setdefault(row.lang, []).append(row.text or "")
    return Identifier({k: v for k, v in samples.items() if any(x.strip() for x in v)}, order)


def identify(df: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for each row.

    ``und`` with score 0 where the text is null, empty or has no letter, or no
    language was learned. Languages that are equally likely give the first by
    name. Very long texts are read to the end. Repeated rows each come out,
    with equal results; null ids stay null; no rows give none. Columns other
    than the two named are not read, so their names cannot clash.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = shared.value.identify(part.column("text"))
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_from(df: DataFrame) -> Identifier:
    """Learn from the labelled documents that aren't held out."""
    docs = pick(df, doc_id="doc_id", text="text", lang="lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return learn(docs.where(~held_out()))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected; all columns, in any type and under any name.

    Null and empty texts and those without letters are rejected, and no others
    where nothing could be learned. Repeated rows are judged alike and each
    stays or goes; rows with null ids, languages or sources are judged by their
    text. Very long texts are read to the end. No rows give none.
    """
    model = learned_from(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        found = (shared.value.identify(texts.slice(at, 1024)) for at in range(0, len(texts), 1024))
        return pa.array([not x[3] for part in found for x in part], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learned_from(docs)).withColumn("held_out", held_out())
