import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import gif


@pytest.mark.parametrize("size", [64, 128, 64 * 1024, 64 * 1025, 64 * 4000])
@pytest.mark.parametrize("kind", ["noise", "zeros", "few", "text"])
def test_round_trip(size, kind):
    rng = np.random.default_rng(size)
    data = {"noise": lambda: rng.integers(0, 256, size, dtype=np.uint8).tobytes(), "zeros": lambda: bytes(size), "few": lambda: rng.integers(0, 3, size, dtype=np.uint8).tobytes(), "text": lambda: (b"the quick brown fox " * size)[:size]}[kind]()
    stored = gif.encoded(data)
    assert stored[:6] == b"GIF89a" and stored[-1:] == b";"
    _, _, frames = gif.decode(stored)
    assert b"".join(f.indices.tobytes() for f in frames) == data and len(frames) == -(-size // 65536)
    if kind == "text" and size > 1000:
        assert len(stored) < size / 2


def plain_lzw(codes, least):
    """A decoder as the format's description has it, code by code."""
    clear, out, table, last = 1 << least, b"", [], None
    for c in codes:
        if c == clear:
            table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
        elif c == clear + 1:
            return out
        else:
            now = table[c] if c < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + now[:1])
            out, last = out + now, now
    return out


@pytest.mark.parametrize("least", [2, 4, 8])
def test_codes_agree_with_a_plain_decoder(least):
    data = np.random.default_rng(least).integers(0, 1 << least, 30000, dtype=np.uint8).tobytes()
    codes = gif.lzw_codes(data, least)
    assert plain_lzw(codes, least) == data == gif.lzw_decode(gif.packed(codes, least), least, len(data))


def test_a_full_table_without_a_clear_code():
    """Deferred clear: the table fills up and codes of twelve bits go on."""
    data = np.random.default_rng(5).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    codes = [256, *data, 257]
    bits = np.concatenate([[9], gif.widths(8, len(codes) - 1)])
    stream = sum(int(c) << int(at) for c, at in zip(codes, np.cumsum(bits) - bits, strict=True))
    assert gif.lzw_decode(stream.to_bytes(int(bits.sum()) // 8 + 1, "little"), 8, len(data)) == data


def image(indices, left=0, top=0, disposal=0, transparent=None, delay=3, palette=None, interlaced=False):
    h, w = indices.shape
    flags = (0x40 if interlaced else 0) | (0x81 if palette is not None else 0)
    rows = indices
    if interlaced:
        rows = np.concatenate([indices[a::b] for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0) + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags)
    return head + (palette or b"") + b"\x02" + gif.blocks(gif.packed(gif.lzw_codes(rows.astype(np.uint8).tobytes(), 2), 2))


RED, GREEN, BLUE, GREY = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (9, 9, 9, 255)


def film(*images):
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    return b"GIF89a" + struct.pack("<HHBBB", 4, 20, 0x81, 0, 0) + colours + b"\x21\xfe\x03abc\x00" + b"".join(images) + b";"


def test_palettes_disposal_transparency_and_times(spark):
    full, dot = np.zeros((20, 4), int), np.array([[1, 2]])
    local = bytes([9, 9, 9, 0, 0, 255, 0, 255, 0, 255, 0, 0])
    data = film(image(full), image(dot, 1, 5, disposal=2, transparent=2, delay=7), image(dot, 0, 0, disposal=3), image(dot, 2, 19, palette=local), image(np.arange(80).reshape(20, 4) // 4 % 4, interlaced=True))
    wide, high, frames = gif.decode(data)
    shots = list(gif.composed(wide, high, frames))
    at = lambda k, y, x: tuple(int(v) for v in shots[k][y, x])
    assert at(0, 5, 1) == RED and at(1, 5, 1) == GREEN and at(1, 5, 2) == RED
    assert at(2, 5, 1) == (0, 0, 0, 0) and at(2, 5, 2) == (0, 0, 0, 0) and at(2, 0, 0) == GREEN and at(2, 0, 1) == BLUE
    assert at(3, 0, 0) == RED and at(3, 19, 2) == BLUE and at(3, 19, 3) == GREEN
    assert [at(4, y, 0) for y in range(4)] == [RED, GREEN, BLUE, GREY]
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(data[:150]))], "doc_id long, media binary")
    rows = [r for r in gif.frames(df).orderBy("doc_id", "frame").collect() if r.doc_id == 1]
    assert [(r.start_ms, r.delay_ms) for r in rows] == [(0, 30), (30, 70), (100, 30), (130, 30), (160, 30)]
    assert bytes(rows[1].pixels) == shots[1].tobytes() and rows[0].histogram[48] == 80 and sum(rows[2].histogram) == 78
    assert {r.doc_id for r in gif.frames(df).where("status = 'ok'").collect()} <= {1, 4} and {r.status for r in rows} == {"ok"}


def test_what_ends_a_stream_early_is_said(spark):
    whole = film(image(np.zeros((20, 4), int)), image(np.zeros((20, 4), int)))
    lie = b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x4c\x01\x00"
    rows = [(1, whole), (2, None), (3, b"GIF89a"), (4, whole[:-12]), (5, film(image(np.zeros((20, 4), int)), lie)), (6, whole.replace(struct.pack("<HH", 4, 20), struct.pack("<HH", 9000, 9000), 1))]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in rows], "doc_id long, media binary")
    out = {}
    for r in gif.frames(df).orderBy("doc_id", F.col("frame").asc_nulls_last()).collect():
        out.setdefault(r.doc_id, []).append(r.status)
    assert out == {1: ["ok", "ok"], 2: ["no stream"], 3: ["damaged"], 4: ["ok", "damaged"], 5: ["ok", "damaged"], 6: ["too large"]}
    assert gif.frames(df.where("doc_id = 6"), most_pixels=10**8).where("status = 'ok'").count() == 2


def test_payloads(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long text " * 20000, "a"]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)] + [(None, "a", b"")], "doc_id long, text string, media binary")
    out = {r.doc_id: r for r in gif.payload_features(gif.media(df)).collect()}
    for i, t in enumerate(texts):
        own = (t or "").encode()
        want = own + bytes(-len(own) % 64 if own else 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(own), len(want), sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert tuple(out[2])[1:] == tuple(out[7])[1:] == tuple(out[None])[1:]
    assert gif.payload_features(gif.media(df.limit(0))).count() == 0


def test_a_hostile_stream_takes_no_memory():
    """34 bytes that declare 65,535 x 65,535 pixels; a good frame before a frame that its stream can't fill."""
    lie = b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x4c\x01\x00"
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + lie + b";"
    assert gif.decode(huge) == (65535, 65535, []) and list(gif.timed(huge)) == []
    wide, high, found = gif.decode(film(image(np.zeros((20, 4), int)), lie))
    assert (wide, high, len(found)) == (4, 20, 1)


def test_the_feature_is_of_composed_frames(spark):
    """Palette, transparency and disposal change the feature of a stored form."""
    full, dot = np.zeros((20, 4), int), np.array([[1, 2]])
    films = [film(image(full), image(dot, 1, 5)), film(image(full), image(dot, 1, 5, transparent=2)), film(image(full, disposal=2), image(dot, 1, 5)), film(image(full), image(dot, 1, 5, delay=9))]
    df = spark.createDataFrame([(i, 0, bytearray(x)) for i, x in enumerate(films)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r.feature for r in gif.payload_features(df).collect()}
    assert got[0] == "4x20; 0+30 30+30 ms; 3:1,12:1,48:158" and got[1] == "4x20; 0+30 30+30 ms; 12:1,48:159"
    assert got[2] == "4x20; 0+30 30+30 ms; 3:1,12:1,48:80" and got[3] == "4x20; 0+30 30+90 ms; 3:1,12:1,48:158"
