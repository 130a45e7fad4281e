"""Media columns: bytes stored in media formats, and found again by their signatures.

``store`` puts a text's bytes losslessly into a PNG, WAV or BMP file of 8-bit
samples. ``sniff`` never trusts the declared type: an Aho-Corasick automaton
finds all magic bytes, format validators walk the structure behind each and
give its length, and only what is valid counts. What starts at byte 0 corrects
the declared type; whole files further on are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import documents, pick

UNIT, BATCH_BYTES = 64, 16 << 20
PNG, WAV, BMP, GIF, JPEG = "image/png", "audio/wav", "image/bmp", "image/gif", "image/jpeg"
# The magic bytes of each format.
MAGIC = {b"\x89PNG\r\n\x1a\n": PNG, b"RIFF": WAV, b"BM": BMP, b"GIF87a": GIF, b"GIF89a": GIF, b"\xff\xd8\xff": JPEG}


def _png(data: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, i), data[i + 4 : i + 8]
        end = i + 12 + size
        if end > len(data) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(data[i + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return 0


def _riff(data: bytes, at: int) -> int:
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    total = struct.unpack_from("<I", data, at + 4)[0] + 8
    i, kinds = at + 12, []
    while i + 8 <= at + total <= len(data):
        size = struct.unpack_from("<I", data, i + 4)[0]
        kinds.append(data[i : i + 4])
        i += 8 + size + (size & 1)
    return total if i == at + total and kinds[:1] == [b"fmt "] and b"data" in kinds else 0


def _bmp(data: bytes, at: int) -> int:
    if at + 54 > len(data):
        return 0
    total, zero, start, head, width, height, planes, bits, packed, size = struct.unpack_from("<IIIIiiHHII", data, at + 2)
    if zero or head != 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width < 1 or not height or start < 54:
        return 0
    need = (width * bits + 31) // 32 * 4 * abs(height)
    return total if total <= len(data) - at and start + need == total and size in (0, need) else 0


def _gif(data: bytes, at: int) -> int:
    def blocks(i: int) -> int:
        while i < len(data) and data[i]:
            i += data[i] + 1
        return i + 1

    if at + 13 > len(data):
        return 0
    i = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while i < len(data):
        if data[i] == 0x3B:
            return i + 1 - at
        if data[i] == 0x21:
            i = blocks(i + 2)
        elif data[i] == 0x2C and i + 10 <= len(data):
            i = blocks(i + 11 + (3 << (data[i + 9] & 7) + 1 if data[i + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(data: bytes, at: int) -> int:
    i, scanned = at + 2, False
    while i + 4 <= len(data) and data[i] == 0xFF:
        kind = data[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        size = struct.unpack_from(">H", data, i + 2)[0]
        if size < 2 or i + 2 + size > len(data):
            return 0
        i += 2 + size
        if kind == 0xDA:  # entropy-coded data runs to a marker that isn't a restart or a stuffed zero
            while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data) and (data[i + 1] == 0 or 0xD0 <= data[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(data):
                return 0
            if data[i + 1] == 0xD9:
                return i + 2 - at
            scanned = True
    return i + 2 - at if scanned and data[i : i + 2] == b"\xff\xd9" else 0


VALID = {PNG: _png, WAV: _riff, BMP: _bmp, GIF: _gif, JPEG: _jpeg}


@cache
def _automaton():  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each valid file: the outermost first where they nest, none that overlaps another otherwise."""
    out: list[tuple[str, int, int]] = []
    starts = sorted((end + 1 - n, kind) for end, (n, kind) in _automaton().iter(data.decode("latin-1")))
    ends: list[int] = []  # of the files that are open at a start, the innermost last
    for at, kind in starts:
        if length := VALID[kind](data, at):
            while ends and ends[-1] <= at:
                ends.pop()
            if not ends or at + length <= ends[-1]:
                out.append((kind, at, length))
                ends.append(at + length)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8, filled with zero bytes to a positive multiple of 64, and its size before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes, kind: str) -> bytes:
    """A payload of a multiple of 64 bytes as a grey PNG or BMP image, 64 wide, or as 8-bit mono sound."""
    rows = len(payload) // UNIT
    if kind == PNG:
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    if kind == WAV:
        return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    if kind == BMP:
        grey = np.repeat(np.arange(256, dtype=np.uint8), 4)
        grey[3::4] = 0
        head = struct.pack("<IIIIiiHHIIIIII", 1078 + len(payload), 0, 1078, 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        return b"BM" + head + grey.tobytes() + payload
    raise ValueError(f"no writer for {kind}")


def load(data: bytes, kind: str) -> bytes:
    """The samples of a file that ``store`` may have written."""
    if kind == PNG:
        i, idat, size = 8, [], (0, 0)
        while i < len(data):
            (n,), chunk = struct.unpack_from(">I", data, i), data[i + 4 : i + 8]
            if chunk == b"IHDR":
                size = struct.unpack_from(">II", data, i + 8)
                if data[i + 16 : i + 21] != b"\x08\x00\x00\x00\x00":
                    raise ValueError("not 8-bit grey without interlace")
            elif chunk == b"IDAT":
                idat.append(data[i + 8 : i + 8 + n])
            i += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(size[1], size[0] + 1)
        if lines[:, 0].any():
            raise ValueError("a filter this reader doesn't know")
        return lines[:, 1:].tobytes()
    if kind == WAV:
        i = 12
        while data[i : i + 4] != b"data":
            i += 8 + struct.unpack_from("<I", data, i + 4)[0]
        return data[i + 8 : i + 8 + struct.unpack_from("<I", data, i + 4)[0]]
    if kind == BMP:
        start, _, width, height = struct.unpack_from("<IIii", data, 10)
        lines = np.frombuffer(data, np.uint8, offset=start).reshape(abs(height), -1)[:, :width]
        return (lines if height < 0 else lines[::-1]).tobytes()
    raise ValueError(f"no reader for {kind}")


def feature(payload: bytes, kind: str) -> str:
    """Type, size, mean, spread, entropy and a 16-bin histogram of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, x = counts / max(1, len(payload)), np.arange(256)
    mean = float(p @ x)
    some = p[p > 0]
    bins = ",".join(str(int(b)) for b in counts.reshape(16, 16).sum(axis=1))
    return f"{kind};n={len(payload)};mean={mean:.4f};sd={float(np.sqrt(max(0.0, p @ (x * x) - mean * mean))):.4f};bits={float(-(some @ np.log2(some))):.4f};hist={bins}"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text in a format picked by its bytes, so equal texts give equal files.

    Null texts count as empty; null ids stay null, repeated rows each come out,
    no rows give none. Columns other than the two named are not read. The declared type is left as unknown for ``sniff`` to correct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                payload, n = payload_of(text.as_py())
                files.append(store(payload, (PNG, WAV, BMP)[zlib.crc32(payload) % 3]))
                ids.append(doc), sizes.append(n)
                held += len(files[-1])
                if held >= BATCH_BYTES:
                    yield _stored(ids, sizes, files)
                    ids, sizes, files, held = [], [], [], 0
            if ids:
                yield _stored(ids, sizes, files)

    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def _stored(ids: list, sizes: list, files: list) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(["application/octet-stream"] * len(ids)), pa.array(files, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "declared", "media"])


_FOUND = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, carved array<struct<type:string,offset:long,length:long>>"


def sniff(media: DataFrame) -> DataFrame:
    """What the bytes of column ``media`` are: the corrected type, the payload's digests and features, and embedded files.

    Null or unknown bytes have a null type, payload and feature, and whatever
    can be carved from them. Needs columns doc_id, n_bytes, declared, media.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, declared, data in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "declared", "media")), strict=True):
                data = data.as_py() or b""
                found = find_media(data)
                kind = next((k for k, at, length in found if at == 0 and length == len(data)), None)
                carved = [{"type": k, "offset": at, "length": length} for k, at, length in found if at or length != len(data)]
                payload = load(data, kind) if kind in (PNG, WAV, BMP) else None
                read = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                out.append((doc.as_py(), n.as_py(), *read, len(data), hashlib.sha256(data).hexdigest(), None if payload is None else feature(payload, kind), declared.as_py(), kind, carved))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, _FOUND)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff(encode(documents(spark, sf_dir)))
