"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

``encoded`` stores bytes losslessly as 8-bit palette indices in frames of 64 columns and at most 1,024 rows, with real
LZW compression. ``decode`` reads any GIF87a or GIF89a stream: global and local palettes, interlacing, all four disposal
methods, transparent indices, frame delays. ``media`` and ``frames`` apply them to a table in Arrow batches; both are
map-only, so nothing is shuffled.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal values; a stream that is null, damaged or
cut gives the frames before the damage (none for null), and so does one that declares more pixels than it can encode or a
canvas beyond ``most_pixels``, a parameter (a canvas can be declared far beyond what its stream fills, and would take all
memory); what ends a stream early is said in a row of its own in ``frames``, whose frame is null and whose status tells why, so
nothing is lost unseen; texts of any length are stored whole, and
read back one frame at a time; repeated rows and null ids pass; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.texts import column, pieces, raw

WIDTH, ROWS, DELAY = 64, 1024, 10
MOST_CODES = 4096
#: Pixels of a canvas or frame that are decoded unless the caller says otherwise; pixels that one code can stand for.
MOST_PIXELS, LONGEST_RUN = 1 << 24, 4096

#: An RGB 3-3-2 palette, as all 256 indices are used.
PALETTE = np.stack([np.arange(256) >> 5, (np.arange(256) >> 2) & 7, np.arange(256) & 3], 1)
PALETTE = (PALETTE * 255 // np.array([7, 7, 3])).astype(np.uint8)


def widths(least: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: a new entry follows each code but the first."""
    entries = np.minimum((1 << least) + 1 + np.arange(n), MOST_CODES - 1)
    return np.maximum(least + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1)


WIDTHS = {least: widths(least, MOST_CODES + 2) for least in range(1, 9)}


def lzw_codes(data: bytes, least: int = 8) -> list[int]:
    """The codes of a stream, with a clear code at the start and whenever the table is full, and the end code."""
    clear = 1 << least
    codes = [clear]
    add = codes.append
    table: dict[int, int] = {}
    known = table.get
    new = clear + 2
    bytes_left = iter(data)
    for prefix in bytes_left:  # the first byte; the loop below takes the others
        for byte in bytes_left:
            code = known(prefix << 8 | byte)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            if new < MOST_CODES:
                table[prefix << 8 | byte] = new
                new += 1
            else:
                add(clear)
                table.clear()
                new = clear + 2
            prefix = byte
        add(prefix)
    add(clear + 1)
    return codes


def code_bits(codes: np.ndarray, least: int) -> np.ndarray:
    """The width of each code; a clear code has the width in force before it."""
    clear = 1 << least
    at = np.flatnonzero(codes == clear)
    since = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes)))) - 1
    bits = WIDTHS[least][np.maximum(since, 0)]
    later = at[1:]
    bits[later] = WIDTHS[least][since[later - 1] + 1]
    bits[0] = least + 1
    return bits


def packed(codes: list[int], least: int = 8) -> bytes:
    """Codes as a stream of bits, the low bits first."""
    c = np.array(codes, np.int64)
    bits = code_bits(c, least)
    ends = np.cumsum(bits)
    at = ends - bits
    value, byte, n = c << (at & 7), at >> 3, int(ends[-1] + 7) // 8
    out = sum(np.bincount(byte + k, (value >> (8 * k)) & 255, n + 3) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def unpacked(data: bytes, least: int) -> Iterator[np.ndarray]:
    """Codes between clear codes, without these; ends at the end code or with the data."""
    raw_bytes = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    word = raw_bytes[:-2] | raw_bytes[1:-1] << 8 | raw_bytes[2:] << 16
    clear, at, total = 1 << least, 0, 8 * len(data)
    bits = WIDTHS[least]
    ends = np.cumsum(bits)
    run: list[np.ndarray] = []
    while at + least + 1 <= total:
        if run:  # a full table that isn't cleared: codes of twelve bits go on
            places, size = at + 12 * np.arange(MOST_CODES), np.full(MOST_CODES, 12)
        else:
            places, size = at + ends - bits, bits
        fits = places + size <= total
        places, size = places[fits], size[fits]
        codes = (word[places >> 3] >> (places & 7)) & ((1 << size) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop):
            run.append(codes)
            if not len(codes) or not fits.all():
                break
            at = int(places[-1] + size[-1])
            continue
        first = int(stop[0])
        yield np.concatenate([*run, codes[:first]])
        run = []
        if codes[first] == clear + 1:
            return
        at = int(places[first] + size[first])
    if run:
        yield np.concatenate(run)


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """The indices of a code stream, at most ``most``; what precedes a code that can't be, if the stream is damaged."""
    clear = 1 << least
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    for codes in unpacked(data, least):
        run = codes.tolist()
        if not run:
            continue
        table = single.copy()
        if run[0] >= clear:
            break
        before = table[run[0]]
        put(before)
        full = 1 + MOST_CODES - len(table)
        for c in run[1:full]:
            try:
                now = table[c]
            except IndexError:
                if c > len(table):
                    return b"".join(out)[:most]
                now = before + before[:1]  # the entry that this very code makes
            table.append(before + now[:1])
            put(now)
            before = now
        out += [table[c] for c in run[full:]]
    return b"".join(out)[:most]


def blocks(data: bytes) -> bytes:
    """Data as sub-blocks of at most 255 bytes."""
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encoded(payload: bytes, delay: int = DELAY) -> bytes:
    """Bytes, a positive multiple of 64 of them, as a GIF of one frame for each 64 KiB."""
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), PALETTE.tobytes()]
    for at in range(0, len(payload), WIDTH * ROWS):
        part = payload[at : at + WIDTH * ROWS]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0))
        out.append(b"\x08" + blocks(packed(lzw_codes(part))))
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int | None
    indices: np.ndarray  # height x width
    palette: np.ndarray  # n x 3


def deinterlaced(rows: np.ndarray) -> np.ndarray:
    """GIF stores rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, .."""
    out = np.empty_like(rows)
    order = np.concatenate([np.arange(a, len(rows), b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out[order] = rows
    return out


def canvas_size(data: bytes | None) -> tuple[int, int]:
    return struct.unpack_from("<HH", data, 6) if data and len(data) >= 13 and data[:6] in (b"GIF87a", b"GIF89a") else (0, 0)


def decode(data: bytes | None) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and frames."""
    return *canvas_size(data), list(decoded(data))


def decoded(data: bytes | None, most_pixels: int = MOST_PIXELS, said: list[str] | None = None) -> Iterator[Frame]:
    """Frames one by one, up to the first that is broken; ``said`` receives why an incomplete stream ended.

    Memory follows the data: a frame of more pixels than its stream could encode (a code stands for ``LONGEST_RUN`` pixels at
    the most) is damage. A canvas may be larger than its frames, so ``most_pixels`` bounds both.
    """
    wide, high = canvas_size(data)
    said = [] if said is None else said
    if not wide * high:
        said.append("no stream" if data is None else "damaged")
        return
    if wide * high > most_pixels:
        said.append("too large")
        return
    flags, at, shared = data[10], 13, np.zeros((0, 3), np.uint8)

    def palette(bits: int, at: int) -> np.ndarray:
        return np.frombuffer(data[at : at + 3 * (2 << bits)], np.uint8).reshape(-1, 3)

    def chained(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    try:
        if flags & 0x80:
            shared = palette(flags & 7, at)
            at += 3 * (2 << (flags & 7))
        control = (0, 0, None)
        while data[at] != 0x3B:
            if data[at] == 0x21:
                body, to = chained(at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    control = (body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0], body[3] if body[0] & 1 else None)
                at = to
            elif data[at] == 0x2C:
                left, top, width, height, own = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                colours = shared
                if own & 0x80:
                    colours = palette(own & 7, at)
                    at += 3 * (2 << (own & 7))
                least = data[at]
                if not 1 <= least <= 8:
                    said.append("damaged")
                    return
                body, at = chained(at + 1)
                if width * height > 8 * len(body) // (least + 1) * LONGEST_RUN:
                    said.append("damaged")
                    return
                if width * height > most_pixels:
                    said.append("too large")
                    return
                pixels = np.frombuffer(lzw_decode(body, least, width * height).ljust(width * height, b"\0"), np.uint8).reshape(height, width)
                yield Frame(left, top, width, height, control[1], control[0], control[2], deinterlaced(pixels) if own & 0x40 else pixels, colours)
                control = (0, 0, None)
            else:
                said.append("damaged")
                return
    except (IndexError, struct.error, ValueError):
        said.append("damaged")


def shown(wide: int, high: int, frames: Iterable[Frame]) -> Iterator[np.ndarray]:
    """The canvas (RGBA) while each frame shows; the same array, changed from frame to frame. Disposal 2 clears the frame's
    area after it, 3 restores what was there."""
    canvas = np.zeros((high, wide, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        seen = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent is None:
            area.view("<u4")[..., 0] = colours.view("<u4")[:, 0][seen]
        else:
            opaque = seen != f.transparent
            area[opaque] = colours[seen[opaque]]
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas[:] = before


def composed(wide: int, high: int, frames: Iterable[Frame]) -> Iterator[np.ndarray]:
    """A copy of the canvas while each frame shows."""
    for canvas in shown(wide, high, frames):
        yield canvas.copy()


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Pixels that are seen by colour, in 4 x 4 x 4 bins of RGB."""
    high = pixels.reshape(-1, 4) >> 6
    bins = high[:, 0] << 4
    bins |= high[:, 1] << 2
    bins |= high[:, 2]
    return np.bincount(bins if high[:, 3].all() else bins[high[:, 3] > 0], minlength=64)


def timed(data: bytes | None, most_pixels: int = MOST_PIXELS, said: list[str] | None = None) -> Iterator[tuple[int, Frame, np.ndarray, np.ndarray]]:
    """Each frame with its start in milliseconds, the canvas while it shows (not to be kept) and its colour histogram."""
    start, now = 0, []

    def kept() -> Iterator[Frame]:
        for f in decoded(data, most_pixels, said):
            now[:] = [f]
            yield f

    first = next(own := kept(), None)
    if first is None:
        return
    for canvas in shown(*canvas_size(data), chain([first], own)):
        yield start, now[0], canvas, histogram(canvas)
        start += 10 * now[0].delay


FRAMES = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, disposal int, transparent int, pixels binary, histogram array<long>, status string"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form of each text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            texts = raw(batch, "text")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encoded(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def frames(table: DataFrame, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row for each frame of the GIFs in ``media``: times, the composed canvas as RGBA bytes, its colour histogram, status
    ``ok``. A stream that ended early has a last row without a frame whose status is ``no stream``, ``damaged`` or ``too large``."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(column(batch, "doc_id").to_pylist(), column(batch, "media"), strict=True):
                data = data.as_py()
                wide, high = canvas_size(data)
                said: list[str] = []
                for k, (start, f, canvas, seen) in enumerate(timed(data, most_pixels, said)):
                    row = {"doc_id": doc, "frame": k, "start_ms": start, "delay_ms": 10 * f.delay, "width": wide, "height": high, "disposal": f.disposal, "transparent": f.transparent, "pixels": canvas.tobytes(), "histogram": seen.tolist(), "status": "ok"}
                    yield pa.RecordBatch.from_pylist([row], schema=FRAME_SCHEMA)
                if said:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "width": wide, "height": high, "status": said[0]}], schema=FRAME_SCHEMA)

    return table.select("doc_id", "media").mapInArrow(show, FRAMES)


FRAME_SCHEMA = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("status", pa.string())])


def payload_features(table: DataFrame) -> DataFrame:
    """What is read back from stored payloads: digests, and a feature of the timed frames as composed (palette, disposal and
    transparency applied): canvas, start and delay of each frame, and the summed colour histogram."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            rows = []
            for doc, n, data in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                wide, high = canvas_size(data)
                payload, times, bins = [], [], np.zeros(64, np.int64)
                for start, f, _, seen in timed(data):
                    payload.append(f.indices.tobytes())
                    times.append(f"{start}+{10 * f.delay}")
                    bins += seen
                own = b"".join(payload)
                feature = f"{wide}x{high}; {' '.join(times)} ms; " + ",".join(f"{b}:{bins[b]}" for b in np.flatnonzero(bins))
                rows.append((doc, n, len(own), sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(data), sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2, strict=True)], names)

    return table.mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
