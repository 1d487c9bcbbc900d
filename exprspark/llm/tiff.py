"""TIFF columns: image directories are walked, strips and tiles decoded, predictors undone, one row per page.

Grey and multi-sample pages of 8 or 16 bits with no compression, PackBits, LZW or deflate are read, in either byte
order. A file or page that cannot be read gives a row with an error, never an exception.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Tag numbers and field sizes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PAGE_ROWS = 4096


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 2 < len(data) and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, the width growing one code early."""
    bits, held, out = 0, 0, bytearray()
    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    width, following = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for value in data:
        longer = word + bytes([value])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        elif following >= 1 << width and width < 12:
            width += 1
        word = bytes([value])
    if word:
        put(table[word])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last, total = [], 0, 0, 9, b"", 0
    for value in data:
        held, bits = (held << 8) | value, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or total >= size:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        if last:
            table.append(last + word[:1])
        out.append(word)
        total += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


ENCODE = {NONE: bytes, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: pack_bits}


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


DECODE = {NONE: lambda data, size: data[:size], LZW: unlzw, DEFLATE: inflate, 32946: inflate, PACKBITS: unpack_bits}


@dataclass
class Layout:
    """How a page is stored: compression, predictor (1 none, 2 horizontal differences), rows of a strip, or a tile's sides."""

    compression: int = DEFLATE
    predictor: int = 1
    strip_rows: int = 512
    tile: tuple[int, int] | None = None


def _segments(page: np.ndarray, layout: Layout) -> list[np.ndarray]:
    if layout.tile is None:
        return [page[at : at + layout.strip_rows] for at in range(0, len(page), layout.strip_rows)]
    high, wide = layout.tile
    padded = np.zeros((-(-page.shape[0] // high) * high, -(-page.shape[1] // wide) * wide), page.dtype)
    padded[: page.shape[0], : page.shape[1]] = page
    return [padded[y : y + high, x : x + wide] for y in range(0, padded.shape[0], high) for x in range(0, padded.shape[1], wide)]


def write(pages: list[tuple[np.ndarray, Layout]]) -> bytes:
    """A little-endian file of 8-bit grey pages."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page, layout in pages:
        offsets, counts = [], []
        for part in _segments(page, layout):
            if layout.predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            data = ENCODE[layout.compression](np.ascontiguousarray(part).tobytes())
            offsets.append(len(out)), counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        entries = {WIDTH: [page.shape[1]], HEIGHT: [page.shape[0]], BITS: [8], COMPRESSION: [layout.compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [layout.predictor]}
        if layout.tile is None:
            entries |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [layout.strip_rows], STRIP_COUNTS: counts}
        else:
            entries |= {TILE_WIDTH: [layout.tile[1]], TILE_LENGTH: [layout.tile[0]], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        fields = b""
        for tag, values in sorted(entries.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack("<I", place)
            fields += struct.pack("<HHI", tag, 4, len(values)) + data
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    compression: int = NONE
    predictor: int = 1
    tiled: bool = False
    data: bytes | None = None
    error: str | None = None


def _fields(media: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", media, at)
    found: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
        size = FIELD_BYTES.get(kind, 0) * count
        if kind not in (1, 3, 4) or size > len(media):
            continue
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", media, at + 10 + 12 * i)[0]
        found[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", media, place))
    return found, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def _decode(media: bytes, order: str, tags: dict[int, list[int]], page: Page) -> bytes:
    def one(tag: int, default: int) -> int:
        return tags.get(tag, [default])[0]

    page.width, page.height, page.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    page.bits, page.compression, page.predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    page.tiled = TILE_OFFSETS in tags
    if page.bits not in (8, 16) or len(set(tags.get(BITS, [8]))) > 1 or one(PLANAR, 1) != 1 or page.compression not in DECODE or page.predictor not in (1, 2):
        raise ValueError(f"unsupported: {page.bits} bits, compression {page.compression}, predictor {page.predictor}, planar {one(PLANAR, 1)}")
    kind = np.dtype(("<" if order == "<" else ">") + f"u{page.bits // 8}")
    row = page.width * page.samples
    if row * page.height * kind.itemsize > 1100 * len(media) + (1 << 20):
        raise ValueError("the page is larger than its data can hold")
    image = np.zeros((page.height, row), kind)
    high, wide = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0) * page.samples) if page.tiled else (min(one(ROWS_PER_STRIP, page.height), page.height), row)
    offsets, counts = (tags.get(TILE_OFFSETS, []), tags.get(TILE_COUNTS, [])) if page.tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, []))
    across = -(-row // wide) if wide else 0
    if not high or not wide or min(len(offsets), len(counts)) < across * -(-page.height // high):
        raise ValueError("strips or tiles are missing")
    for i in range(across * -(-page.height // high)):
        y, x = i // across * high, i % across * wide
        rows = high if page.tiled else min(high, page.height - y)
        raw = DECODE[page.compression](media[offsets[i] : offsets[i] + counts[i]], rows * wide * kind.itemsize)
        if len(raw) < rows * wide * kind.itemsize:
            raise ValueError("a strip or tile is short")
        part = np.frombuffer(raw, kind).reshape(rows, wide)
        if page.predictor == 2:
            part = np.cumsum(part.reshape(rows, wide // page.samples, page.samples), axis=1, dtype=kind.newbyteorder("=")).reshape(rows, wide)
        image[y : y + rows, x : x + wide] = part[: page.height - y, : row - x]
    return image.tobytes()


def read(media: bytes | None) -> Iterator[Page]:
    """The pages of a file in order of their directories; a broken link or loop ends the walk with an error page."""
    media = media or b""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(media[:4])
    if order is None or len(media) < 8:
        yield Page(0, error="not a TIFF file")
        return
    (at,) = struct.unpack_from(order + "I", media, 4)
    if not at:
        yield Page(0, error="no directory")
        return
    seen: set[int] = set()
    while at:
        page = Page(len(seen))
        if at in seen:
            page.error = "directories form a loop"
            yield page
            return
        seen.add(at)
        try:
            tags, at = _fields(media, order, at)
        except struct.error:
            page.error = "directory outside the file"
            yield page
            return
        try:
            page.data = _decode(media, order, tags, page)
        except (ValueError, IndexError, ArithmeticError, struct.error, zlib.error, MemoryError, TypeError) as error:
            page.error = str(error) or type(error).__name__
        yield page


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def pages(rows: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per page: `key` and the page's directory and samples. A null, empty or broken file is one row with an error."""
    names = [f.split()[0] for f in PAGE.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0), batch.column(1)):
                for page in read(value.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.schema.field(0).type), *(
                        pa.array([getattr(page, n)], t) for n, t in zip(names, [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]))], names=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(media).cast("binary")).mapInArrow(walk, f"`{key}` {kind}, {PAGE}")


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a file of pages 64 samples wide.

    Up to 1 KiB one LZW strip, up to 2 KiB PackBits; more is deflated: the first page in tiles with differences,
    later ones in strips. So equal payloads give equal files and all decoders see real data.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    if len(payload) <= 2048:
        return write([(image, Layout(LZW if len(payload) <= 1024 else PACKBITS))])
    parts = [image[at : at + PAGE_ROWS] for at in range(0, len(image), PAGE_ROWS)]
    return write([(part, Layout(DEFLATE, 1) if i else Layout(DEFLATE, 2, tile=(256, 64))) for i, part in enumerate(parts)])


def text_media(docs: DataFrame) -> DataFrame:
    """Each row's text stored as TIFF and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A null text is empty and stored as one row of zeros. feature: pages, width, height, compression of
    the first page, mean sample and share of distinct samples of what was read."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode()
                media = store(data + b"\0" * (-len(data) % 64 if data else 64))
                found = list(read(media))
                back = b"".join(p.data or b"" for p in found)
                samples = np.frombuffer(back, np.uint8)
                counts = np.bincount(samples, minlength=256)
                mean = float(counts @ np.arange(256)) / len(samples)
                feature = f"pages={len(found)};size={found[0].width}x{sum(p.height for p in found)};codec={found[0].compression};mean={mean:.4f};distinct={np.count_nonzero(counts)}"
                for column, value in zip(out, (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") or n == "feature" else pa.int64()) for n, c in zip(names, out)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        measure, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
