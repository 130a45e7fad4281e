"""Packing of token sequences into windows by best-fit decreasing.

Documents are tokenised once, overlong ones cut into full windows, and the
pieces (a few numbers each) written. They are then dealt at random into groups
of about ``group`` pieces, and each group is packed on its own: a piece goes to
the open window with the least room that still takes it, found in a segment
tree over the remaining capacities. A group ends with at most a window or two
that are poorly filled, so the loss is some 0.1 per cent at any scale, and a
task never holds more than its group.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, documents, pick

WINDOW, END_ID, GROUP = 2048, 1, 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # Fixed value: how byte-level BPE splits words


class Encoder:
    """Token ids of a byte-level BPE file, as the ``tokenizers`` library gives them without adding special tokens.

    The same vocabulary and split pattern run through ``tiktoken``, which is
    some four times faster. The file's added tokens are found in a text first
    and have their own ids, as in the library. A file that isn't plain
    byte-level BPE, and a text that ``tiktoken`` can't take, go to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))
        self.added = {x["content"]: x["id"] for x in added}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self.path, self.library, self.fast = path, None, None
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if usual and plain and not spec["normalizer"] and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            self.fast = self._fast(model["vocab"])

    def _fast(self, vocabulary: dict[str, int]) -> object:
        import tiktoken

        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in word): n for word, n in vocabulary.items() if word not in self.added}
        return tiktoken.Encoding("assay", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self._slow(text)
        if not self.split or not self.split.search(text):
            return self._part(text)
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self._part(part)
        return out

    def _part(self, text: str) -> list[int]:
        """The ids of a text that holds no added token."""
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001  a Rust panic isn't an Exception
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            return self._slow(text)

    def _slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids


def chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts that can be encoded one by one: the split pattern always begins anew at a space between two other characters."""
    at, gap = 0, re.compile(r"(?<=\S) (?=\S)")
    while at < len(text):
        end = gap.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into full windows and a rest: where, how long, and their CRC-32."""
    path = vocabulary or default_vocabulary()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = encoder(path), 4 * window
        for batch in batches:
            ids, starts, lengths, sums, totals = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                total, rest = 0, b""
                text = text.as_py() or ""
                for part in chunks(text) if tokens.fast else [text]:
                    rest += np.array(tokens.ids(part), dtype="<u4").tobytes()
                    full = len(rest) // size * size
                    for at in range(0, full, size):
                        ids.append(doc), starts.append(total), lengths.append(window), sums.append(zlib.crc32(rest[at : at + size]))
                        total += window
                    rest = rest[full:]
                rest += end_id.to_bytes(4, "little")
                ids.append(doc), starts.append(total), lengths.append(len(rest) // 4), sums.append(zlib.crc32(rest))
                total += len(rest) // 4
                totals += [total] * (len(ids) - len(totals))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, _PIECE)


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset of each piece; ``lengths`` fall, each from 1 to ``window``."""
    size = 1
    while size <= window:
        size *= 2
    some = [0] * (2 * size)  # how many open windows have this much room, and sums of that above
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, count = [], [], 0
    for n in lengths:
        at = size + n
        if not some[at]:
            # up until a right neighbour has windows, then down to its least room
            while at > 1 and (at & 1 or not some[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < size:
                    at = 2 * at if some[2 * at] else 2 * at + 1
        if at <= 1:
            room, where, count = window, count, count + 1
        else:
            room = at - size
            where = open_[room].pop()
            while at:
                some[at] -= 1
                at >>= 1
        bins.append(where), offsets.append(window - room)
        if room > n:
            open_[room - n].append(where)
            at = size + room - n
            while at:
                some[at] += 1
                at >>= 1
    return bins, offsets


def pack(cuts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Written pieces with ``sequence_id`` and ``offset``; other columns stay."""
    total = cuts.count()
    groups = max(1, -(-total // group))
    dealt = cuts.withColumn("__g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = cuts.columns

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table.column("length").to_pylist(), window)
        first = key[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema)
    return dealt.groupBy("__g").applyInArrow(packed, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of ``end_id`` alone. Very long texts are
    encoded in parts, to the end. Repeated rows are documents of their own;
    null ids stay null. Pieces of equal length are packed by id, start and
    CRC-32. No rows give none. Columns other than the two named are not read,
    so their names cannot clash.
    """
    return pack(cut(pieces(df, vocabulary, window, end_id, id_col, text_col), "pieces"), window, group)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
