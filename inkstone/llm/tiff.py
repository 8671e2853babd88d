"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors, one row for each page.

Reads both byte orders; chunky or planar samples of 8 or 16 bits; strips and tiles; no compression, PackBits, LZW
(either variant of deflate as well); horizontal differencing. The writer stores bytes losslessly as 8-bit grey pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from inkstone.llm.common import map_arrow, widen

# Fixed values of the format: tags, compressions, field types (struct code, bytes).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}
CLEAR, END = 256, 257

#: The writer's layout: bytes in a row, rows in a strip, rows in a page.
ROW, STRIP_ROWS, PAGE_ROWS = 64, 512, 4096


def unpack_packbits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = at + 1
        while run < n and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at > 1:
            out += bytes((257 - (run - at), data[at]))
        else:
            while run < n and run - at < 128 and not (run + 1 < n and data[run] == data[run + 1]):
                run += 1
            out += bytes((run - at - 1,)) + data[at:run]
        at = run
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; widths grow one code early."""
    out: list[bytes] = []
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, width, held, bits, last = list(base), 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR:
            entries, width, last = list(base), 9, b""
            continue
        if code < len(entries):
            word = entries[code]
        elif code == len(entries) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last:
            entries.append(last + word[:1])
        out.append(word)
        last = word
        if len(entries) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    base = {bytes((i,)): i for i in range(256)}
    codes, free, width, word = dict(base), 258, 9, b""
    put(CLEAR, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word], width)
        codes[longer], free, word = free, free + 1, data[i : i + 1]
        if free == 4094:
            put(CLEAR, width)
            codes, free, width = dict(base), 258, 9
        elif free >= 1 << width:
            width += 1
    if word:
        put(codes[word], width)
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    put(END, width)
    put(0, -bits % 8)
    return bytes(out)


def inflate(data: bytes) -> bytes:
    """Deflate; more than a page may hold is an error before it is made."""
    d = zlib.decompressobj()
    out = d.decompress(data, MOST[DEFLATE] * len(data))
    if not d.eof:
        raise ValueError("deflate data that end too early or never")
    return out


#: Bytes that one stored byte can stand for, at most.
MOST = {NONE: 1, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100, PACKBITS: 64}
UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_packbits}
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_packbits}


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray  # height, width, channels


def directories(raw: bytes) -> Iterator[dict[int, tuple]]:
    """Tags of each image directory, and under key 0 the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", raw[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(raw):
            raise ValueError("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags: dict[int, tuple] = {0: (order,)}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind in TYPES:
                code, size = TYPES[kind]
                where = at + 10 + 12 * i
                if size * count > 4:
                    where = struct.unpack_from(order + "I", raw, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        yield tags
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def decode_page(raw: bytes, tags: dict[int, tuple]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16) or compression not in UNPACK or predictor not in (1, 2) or not width or not height:
        raise ValueError(f"not supported: {bits} bits, compression {compression}, predictor {predictor}")
    tiled = TILES in tags
    block_w, block_h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    depth = channels if planar == 1 else 1
    across, down = -(-width // block_w), -(-height // block_h)
    kind = np.dtype(f"{tags[0][0]}u{bits // 8}")
    held = sum(max(0, min(start + size, len(raw)) - start) for start, size in zip(offsets, counts, strict=True))
    if width * height * channels * kind.itemsize > held * MOST[compression] or block_w * block_h * depth * kind.itemsize > held * MOST[compression]:
        raise ValueError("the page claims more than the file can hold")
    out = np.zeros((height, width, channels), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * block_h, rest % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        if plane * depth >= channels or rows <= 0:
            raise ValueError("more blocks than the page has")
        flat = np.frombuffer(UNPACK[compression](raw[start : start + size]), kind, rows * block_w * depth)
        block = flat.reshape(rows, block_w, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        h, w = min(rows, height - y), min(block_w, width - x)
        out[y : y + h, x : x + w, plane * depth : (plane + 1) * depth] = block[:h, :w]
    return Page(width, height, channels, bits, compression, predictor, tiled, out)


def pages(raw: bytes) -> Iterator[Page]:
    for tags in directories(raw):
        yield decode_page(raw, tags)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """A TIFF file of one page for each array (height, width, channels) of 8- or 16-bit samples.

    tile: (height, width) in multiples of 16, else strips of `rows` rows.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, channels = image.shape
        bits = image.dtype.itemsize * 8
        th, tw = tile or (rows, width)
        offsets, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                data = PACK[compression](block.astype(f"{order}u{bits // 8}").tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
                out += b"\0" * (len(out) % 2)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bits] * channels), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if channels == 1 else 2]), SAMPLES: (3, [channels]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            fields |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILES: (4, offsets), TILE_BYTES: (4, counts)}
        else:
            fields |= {STRIPS: (4, offsets), ROWS: (4, [rows]), STRIP_BYTES: (4, counts)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(text: str | None, row: int = ROW) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with zero bytes to a positive multiple of the row."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (row * max(1, -(-len(data) // row)) - len(data))


def store(data: bytes, compression: int = DEFLATE, predictor: int = 2, page_rows: int = PAGE_ROWS) -> bytes:
    """Pages of rows of 64 grey samples; a payload of any length becomes as many pages as it needs."""
    grey = np.frombuffer(data, np.uint8).reshape(-1, ROW, 1)
    return encode([grey[i : i + page_rows] for i in range(0, len(grey), page_rows)], compression, predictor)


def features(data: bytes) -> str:
    """Mean, deviation, entropy, and mean square steps along and across rows of the samples, to 6 digits."""
    grey = np.frombuffer(data, np.uint8)
    share = np.bincount(grey, minlength=256) / len(grey)
    level = np.arange(256.0)
    mean = float(share @ level)
    used = share[share > 0]
    image = grey.reshape(-1, ROW).astype(np.int32)
    steps = [(float((np.diff(image, axis=a).ravel().astype(np.float64) ** 2).mean()) if image.shape[a] > 1 else 0.0) for a in (1, 0)]
    return ":".join(f"{x:.6f}" for x in (mean, float(share @ (level - mean) ** 2) ** 0.5, float(-(used * np.log2(used)).sum()) + 0.0, *steps))


def write_media(df: DataFrame, compression: int = DEFLATE, predictor: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media (binary): each text as a TIFF file; null counts as the empty text (one row of zeros)."""

    def run(c: dict) -> dict:
        found = [payload(t) for t in c["text"]]
        return {"key": c["key"], "n_bytes": [n for n, _ in found], "media": [store(p, compression, predictor) for _, p in found]}

    schema = f"key {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary"
    return map_arrow(widen(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")), schema, run).withColumnRenamed("key", key)


def read_pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each page: key, page, width, height, channels, bits, compression, predictor, tiled, samples (binary), error.

    Pages come one by one, so a task holds one decoded page. A file that is null or broken gives its readable pages and
    a row whose error says what is wrong; other columns of that row are null but for key and page.
    """
    fields = ("width", "height", "channels", "bits", "compression", "predictor", "tiled")

    def run(batches):
        for c in batches:
            for key_, raw in zip(c["key"], c["media"], strict=True):
                n = 0
                try:
                    for p in pages(raw or b""):
                        yield {"key": [key_], "page": [n], **{f: [getattr(p, f)] for f in fields}, "samples": [p.data.tobytes()], "error": [None]}
                        n += 1
                except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
                    yield {"key": [key_], "page": [n], **{f: [None] for f in fields}, "samples": [None], "error": [str(e) or type(e).__name__]}

    run.whole = True
    schema = f"key {df.schema[key].dataType.simpleString()}, page int, width int, height int, channels int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"
    return map_arrow(df.selectExpr(f"`{key}` AS key", f"`{media}` AS media"), schema, run).withColumnRenamed("key", key)


def media_digests(df: DataFrame, compression: int = DEFLATE, predictor: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text, reads it back page by page, and returns sizes, digests and features of one row for each row of df."""

    def run(c: dict) -> dict:
        out: dict = {k: [] for k in ("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for key_, t in zip(c["key"], c["text"], strict=True):
            n, data = payload(t)
            media = store(data, compression, predictor)
            back = b"".join(p.data.tobytes() for p in pages(media))
            row = (key_, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    schema = f"key {df.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_arrow(widen(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")), schema, run).withColumnRenamed("key", key)
