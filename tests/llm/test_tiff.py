import os
import struct

import numpy as np
import pytest

from inkstone.llm import tiff


@pytest.mark.parametrize("pack,unpack", [(tiff.pack_packbits, tiff.unpack_packbits), (tiff.pack_lzw, tiff.unpack_lzw)])
def test_codecs_round_trip(pack, unpack):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 300, 5000, 40_000):
        for high in (1, 2, 5, 256):
            data = rng.integers(0, high, n, dtype=np.uint8).tobytes()
            assert unpack(pack(data)) == data
    text = ("the of and " * 9000).encode()
    assert unpack(pack(text)) == text


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_come_back(compression, predictor, tile, order):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (h, w, c), dtype=t) for h, w, c, t in ((5, 7, 1, np.uint8), (40, 70, 3, np.uint8), (33, 20, 1, np.uint16))]
    back = list(tiff.pages(tiff.encode(images, compression, predictor, tile, rows=9, order=order)))
    assert len(back) == 3 and all((a == b.data).all() for a, b in zip(images, back))
    assert [p.tiled for p in back] == [tile is not None] * 3


def test_known_file():
    # 2 x 2 grey pixels without compression, written out by hand
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 4)]
    raw = b"II*\0" + struct.pack("<I", 12) + b"\x01\x02\x03\x04" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    assert [p.data[:, :, 0].tolist() for p in tiff.pages(raw)] == [[[1, 2], [3, 4]]]
    # the sample stream of the PackBits note
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.unpack_packbits(packed) == bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [0x80, 0, 0x2A, 0x22] + [0xAA] * 10)


def test_payload_and_pages_of_long_texts():
    assert tiff.payload(None) == (0, b"\0" * 64) == tiff.payload("")
    assert tiff.payload("é" * 32)[1] == "é".encode() * 32
    data = os.urandom(64 * 9000)
    back = list(tiff.pages(tiff.store(data)))
    assert [p.height for p in back] == [4096, 4096, 808] and b"".join(p.data.tobytes() for p in back) == data


def test_media_columns(spark):
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", "z"), (4, "abc", None), (None, "d" * 200, None), (1, "abc", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, page string")
    media = tiff.write_media(df)
    got = tiff.read_pages(media).collect()
    assert len(got) == 6 and all(r.error is None and r.width == 64 for r in got)
    bad = tiff.read_pages(spark.createDataFrame([(1, b"junk"), (2, None), (3, tiff.store(b"\0" * 64)[:60])], "doc_id bigint, media binary")).collect()
    assert [r.error is not None for r in bad] == [True] * 3
    out = tiff.media_digests(df).collect()
    assert len(out) == 6 and len({r[1:] for r in out if r.doc_id in (1, 4)}) == 1
    assert {r.n_bytes: r.payload_bytes for r in out} == {3: 64, 0: 64, 200: 256}
    assert tiff.media_digests(df.limit(0)).count() == 0
