"""TIFF media columns: write texts' bytes as multi-page TIFF, walk directories and decode pages.

The reader handles both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, horizontal
differencing of 8-bit samples, one or more interleaved samples a pixel, and gives one row per page. A null file has no
page; a damaged file gives the pages before the damage and then one row with `error` set and null pixels. Directory
loops and pages of more pixels than their data can hold in their compression count as damage, so what a damaged header asks for is
never allocated; pages of any size are decoded. Empty tables give empty results; repeated rows are decoded alike; ties can't arise. A
text of any length is written and read whole. Input columns named like a new column are replaced: in read_pages also
those called `page`, `pages` and like the file column, which doesn't come back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.llm.common import with_text_udf

#: Payloads are padded with 255 to a positive multiple of UNIT; a page holds PAGE_ROWS rows of WIDTH samples.
UNIT, WIDTH, PAGE_ROWS = 576, 96, 24
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that a byte of data can stand for at most.
MOST = {NONE: 1, LZW: 2731, DEFLATE: 1033, OLD_DEFLATE: 1033, PACKBITS: 64}
#: What reading a damaged file can raise.
DAMAGE = (ValueError, KeyError, IndexError, TypeError, OverflowError, ZeroDivisionError, MemoryError, struct.error, zlib.error)
#: (compression, predictor, rows of a strip or None, (width, height) of a tile or None), by page number in turn.
LAYOUTS = ((DEFLATE, 2, 12, None), (PACKBITS, 1, 6, None), (DEFLATE, 1, None, (32, 16)), (LZW, 2, 24, None))


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height, width * samples


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals of at most 128."""
    out, at = bytearray(), 0
    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        for a in range(at, m.start(), 128):
            part = data[a : min(a + 128, m.start())]
            out += bytes([len(part) - 1]) + part
        out += bytes([257 - (m.end() - m.start())]) + m[1]
        at = m.end()
    for a in range(at, len(data), 128):
        out += bytes([len(data[a : a + 128]) - 1]) + data[a : a + 128]
    return bytes(out)


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, 9 to 12 bits, the width growing one code early."""
    fresh = {bytes([i]): i for i in range(256)}
    table, following, width = dict(fresh), 258, 9
    bits, held, out = 256, 9, bytearray()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        bits, held = bits << width | table[word], held + width
        table[longer] = following
        following += 1
        if following == 4095:
            bits, held = bits << 12 | 256, held + 12
            table, following, width = dict(fresh), 258, 9
        elif following >= 1 << width:
            width += 1
        if held > 4096:
            out += (bits >> held % 8).to_bytes(held // 8, "big")
            bits, held = bits & (1 << held % 8) - 1, held % 8
        word = data[i : i + 1]
    if word:
        bits, held = bits << width | table[word], held + width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    bits, held = bits << width | 257, held + width
    return bytes(out) + (bits << -held % 8).to_bytes((held + 7) // 8, "big")


def lzw_decode(data: bytes, limit: int) -> bytes:
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(fresh), 9, b""
    out, size = [], 0
    bits = held = at = 0
    while size < limit:
        if held < width:
            more = data[at : at + 8]
            if not more:
                break
            at += len(more)
            bits, held = (bits & (1 << held) - 1) << 8 * len(more) | int.from_bytes(more, "big"), held + 8 * len(more)
            if held < width:
                continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code beyond the table")
        out.append(word)
        size += len(word)
        if last:
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word
    return b"".join(out)


def _compress(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
    raw = block.astype(np.uint8).tobytes()
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: zlib.compress}[compression](raw)


def _decompress(data: bytes, compression: int, limit: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, limit)
    if compression == LZW:
        return lzw_decode(data, limit)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, limit)
    raise ValueError(f"compression {compression}")


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write(payload: bytes, layouts=LAYOUTS) -> bytes:
    """A little-endian TIFF of 8-bit grey pages that hold the payload row by row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, begin in enumerate(range(0, len(rows), PAGE_ROWS)):
        page, (compression, predictor, strip, tile) = rows[begin : begin + PAGE_ROWS], layouts[k % len(layouts)]
        if tile:
            across, down = -(-WIDTH // tile[0]), -(-len(page) // tile[1])
            whole = np.zeros((down * tile[1], across * tile[0]), np.uint8)
            whole[: len(page), :WIDTH] = page
            blocks = [whole[y * tile[1] : (y + 1) * tile[1], x * tile[0] : (x + 1) * tile[0]] for y in range(down) for x in range(across)]
        else:
            blocks = [page[y : y + strip] for y in range(0, len(page), strip)]
        offsets, sizes = [], []
        for block in blocks:
            data = _compress(block, compression, predictor)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        arrays = len(out)
        out += struct.pack(f"<{2 * len(blocks)}I", *offsets, *sizes)
        many, at = len(blocks) > 1, (arrays, arrays + 4 * len(blocks))
        tags = [(256, 3, 1, WIDTH), (257, 3, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
        place = (at[0] if many else offsets[0], at[1] if many else sizes[0])
        tags += [(322, 3, 1, tile[0]), (323, 3, 1, tile[1]), (324, 4, len(blocks), place[0]), (325, 4, len(blocks), place[1])] if tile else [(273, 4, len(blocks), place[0]), (278, 3, 1, strip), (279, 4, len(blocks), place[1])]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages(file: bytes) -> Iterator[Page]:
    """Walk the image directories of a TIFF; one of DAMAGE where it is damaged."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", file, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directory loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", file, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", file, at + 2 + 12 * k)
            letter, step = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, (None, 0))
            if letter:
                place = at + 10 + 12 * k
                if count * step > 4:
                    place = struct.unpack_from(order + "I", file, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", file, place)
        yield _page(file, tags)
        (at,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)


def _page(file: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples, compression, predictor = one(256), one(257), one(277, 1), one(259, NONE), one(317, 1)
    if not width or not height or not samples or set(tags.get(258, (1,))) != {8} or predictor not in (1, 2) or (samples > 1 and one(284, 1) != 1):
        raise ValueError("unsupported or damaged directory")
    tiled = 324 in tags
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if not w or not h:
        raise ValueError("no strip or tile size")
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down or len(sizes) < across * down:
        raise ValueError("too few strips or tiles")
    held = sum(len(range(o, min(o + n, len(file)))) for o, n in zip(offsets, sizes, strict=False))
    if width * height * samples > held * MOST.get(compression, 0):
        raise ValueError("more pixels than the data can hold")
    out = np.zeros((height, width * samples), np.uint8)
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        size = rows * w * samples
        raw = _decompress(file[offsets[k] : offsets[k] + sizes[k]], compression, size)
        if len(raw) < size:
            raise ValueError("strip or tile too short")
        block = np.frombuffer(raw, np.uint8, size).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = block[: height - y, : width - x].reshape(-1, min(w, width - x) * samples)
        out[y : y + len(part), x * samples : x * samples + part.shape[1]] = part
    return Page(width, height, samples, compression, predictor, tiled, out)


def encode_pages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with media: the padded UTF-8 bytes of each text (null: empty) as a TIFF."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([write(pad((t or "").encode())) for t in texts.to_pylist()], pa.binary())], ["media"])

    return with_text_udf(df, text_col, run, T.StructType([T.StructField("media", T.BinaryType())]))


_PAGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "compression", "predictor")] + [T.StructField("tiled", T.BooleanType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])


def read_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: df's other columns with page struct(page, width, height, samples, compression, predictor, tiled, pixels, error)."""
    kind = pa.struct([(n, pa.int32()) for n in ("page", "width", "height", "samples", "compression", "predictor")] + [("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])

    def rows(file: bytes | None) -> list[dict]:
        out: list[dict] = []
        try:
            for p in pages(file) if file is not None else ():
                out.append({"page": len(out), "width": p.width, "height": p.height, "samples": p.samples, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "pixels": p.pixels.tobytes()})
        except DAMAGE as e:
            out.append({"page": len(out), "error": str(e) or type(e).__name__})
        return out

    def run(files: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([rows(f) for f in files.to_pylist()], pa.list_(kind))], ["pages"])

    made = with_text_udf(df, media_col, run, T.StructType([T.StructField("pages", T.ArrayType(_PAGE))]))
    return made.select(*[F.col(f"`{c}`") for c in made.columns if c not in ("pages", "page", media_col)], F.explode("pages").alias("page"))


def features(found: list[Page]) -> str:
    """Of all pixels together: pages, mean, deviation, mean step between neighbours of a row, and shares of four brightness bands."""
    pixels = np.concatenate([p.pixels.ravel() for p in found])
    n, total = len(pixels), int(pixels.sum(dtype=np.int64))
    square = int((pixels.astype(np.int32) ** 2).sum(dtype=np.int64))
    steps = sum(int(np.abs(np.diff(p.pixels.astype(np.int16), axis=1)).sum(dtype=np.int64)) for p in found)
    bands = np.bincount(pixels >> 6, minlength=4)
    return f"pages={len(found)};mean={total / n:.4f};sd={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f};step={steps / n:.4f};bands=" + ",".join(f"{b / n:.4f}" for b in bands)


def digests(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature: written, read back and described in one pass."""
    kinds = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.dictionary_encode()
        rows = []
        for text in [*texts.dictionary, pa.scalar("")]:  # equal texts once; null counts as the last
            data = text.as_py().encode()
            media = write(pad(data))
            found = list(pages(media))
            back = b"".join(p.pixels.tobytes() for p in found)
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(found)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(7)], [k for k, _ in kinds])
        return made.take(texts.indices.fill_null(len(rows) - 1))

    return with_text_udf(df, text_col, run, T.StructType([T.StructField(*k) for k in kinds]))
