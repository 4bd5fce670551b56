"""Operator 6: GIF media columns.

``decode_gif`` reads any GIF87a/89a: it unpacks LZW code streams (variable code width, clear and
deferred clear), applies local or global palettes, interlacing, transparency and the disposal rules,
and gives timed RGB frames. ``media_frames`` is the DataFrame form: one row per frame with its time
and colour-histogram columns. ``encode_gif`` stores 8-bit samples losslessly as palette indices.

Code widths depend only on how many codes came since the last clear, so the bit positions of a
stream are computed with numpy at once, for packing and for unpacking; only the dictionary steps run
code by code. One row is handled at a time: memory holds one document, its stream and its frames.

Null texts count as empty. Repeated rows and null ids keep their rows. Broken streams raise
ValueError in ``decode_gif``; ``media_frames`` gives such a row one frame row with ``error`` set.
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

MEDIA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
FRAMES = (
    "media_id long, frame int, start_ms long, delay_ms int, width int, height int, "
    "red_histogram array<long>, green_histogram array<long>, blue_histogram array<long>, pixels_sha256 string, error string"
)
UNIT = 192
FRAME_ROWS = 256
MOST_PIXELS = 1 << 24
TABLE = 4096
SINGLE = [bytes([i]) for i in range(256)]


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    pixels: np.ndarray  # height x width x 3, the whole canvas as shown
    box: tuple[int, int, int, int]  # left, top, width, height of the image that made it


def code_widths(n: int, bits: int) -> np.ndarray:
    """Width of each of the first n codes after a clear code, as a decoder expects them: it has
    one entry less than codes read, and widens when its next free entry needs one more bit."""
    free = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.frexp(free.astype(float))[1], bits + 1, 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW code stream of symbols below 2**bits."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[list[int]] = []
    out: list[int] = []
    table: dict[int, int] = {}
    get, put, free = table.get, out.append, end + 1
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = b
        if free < TABLE:
            table[key] = free
            free += 1
        else:
            runs.append(out)
            out = []
            put = out.append
            table.clear()
            free = end + 1
    if prefix >= 0:
        put(prefix)
    runs.append(out)
    codes, widths = [np.array([clear])], [np.array([bits + 1])]
    for k, run in enumerate(runs):
        own = np.array([*run, clear if k < len(runs) - 1 else end])
        codes.append(own)
        widths.append(code_widths(len(own), bits))
    return pack_codes(np.concatenate(codes), np.concatenate(widths))


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    ends = np.cumsum(widths)
    at = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 4, np.uint8)
    value = codes.astype(np.uint32) << (at & 7).astype(np.uint32)
    for k in range(3):  # 12 bits and a shift of 7 reach over three bytes at most; bits never overlap
        np.add.at(out, (at >> 3) + k, ((value >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """Symbols of an LZW code stream."""
    if not 1 <= bits <= 8:
        raise ValueError("bad LZW code size")
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total = 8 * len(stream)
    ramp = np.concatenate([[0], np.cumsum(code_widths(2 * TABLE, bits))])
    parts: list[bytes] = []
    at = 0
    while True:  # one round for each clear code
        fit = int(np.searchsorted(ramp, total - at, side="right")) - 1
        codes = read_codes(raw, at + ramp[:fit], np.diff(ramp[: fit + 1]))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if fit == len(ramp) - 1 and not len(stop):  # a full table that is used on: all codes have 12 bits
            more = (total - at - int(ramp[-1])) // 12
            late = at + int(ramp[-1]) + 12 * np.arange(more)
            codes = np.concatenate([codes, read_codes(raw, late, np.full(more, 12))])
            stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        table = SINGLE[:clear] + [b"", b""]
        grow, last = table.append, b""
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
                if last and len(table) < TABLE:
                    grow(last + entry[:1])
            elif code == len(table) and last:
                entry = last + last[:1]
                grow(entry)
            else:
                raise ValueError("bad LZW code")
            parts.append(entry)
            last = entry
        if not len(stop) or codes[n] == end:
            return b"".join(parts)
        at += int(ramp[n + 1]) if n + 1 < len(ramp) else int(ramp[-1]) + 12 * (n + 2 - len(ramp))


def read_codes(raw: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    k = at >> 3
    value = raw[k] | raw[k + 1] << np.uint32(8) | raw[k + 2] << np.uint32(16)
    return (value >> (at & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def blocks(data: bytes) -> bytes:
    """A stream as GIF data sub-blocks."""
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


def encode_gif(payload: bytes, width: int = UNIT, rows: int = FRAME_ROWS, delay_ms: int = 100) -> bytes:
    """Samples as grey palette indices, ``width`` to a line, in frames of up to ``rows`` lines."""
    lines = len(payload) // width
    if not payload or len(payload) % width:
        raise ValueError("the payload must be whole lines")
    palette = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a" + struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0) + palette]
    for top in range(0, lines, rows):
        part = payload[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the GIF ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        return np.frombuffer(self.take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3)


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames as shown, in order. A header may claim a canvas of any size: one of more than
    ``most_pixels`` is refused before memory is taken."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = r.unpack("<HHBBB")
    if width * height > most_pixels:
        raise ValueError(f"more than {most_pixels} pixels")
    shared = r.palette(flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    if shared is not None and background < len(shared):
        canvas[:] = shared[background]
    ground = canvas.copy()
    disposal, delay, clear_index, now = 0, 0, None, 0
    while True:
        kind = r.take(1)[0]
        if kind == 0x3B:
            return
        if kind == 0x21:
            if r.take(1)[0] == 0xF9:
                body = r.blocks()
                if len(body) < 4:
                    raise ValueError("short graphic control block")
                bits, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            else:
                r.blocks()
            continue
        if kind != 0x2C:
            raise ValueError("bad GIF block")
        left, top, w, h, flags = r.unpack("<HHHHB")
        palette = r.palette(flags)
        palette = shared if palette is None else palette
        if palette is None:
            raise ValueError("no palette")
        if w * h > most_pixels:
            raise ValueError(f"more than {most_pixels} pixels")
        bits = r.take(1)[0]
        found = np.frombuffer(lzw_decode(r.blocks(), bits), np.uint8)
        if len(found) < w * h:
            raise ValueError("too few pixels")
        index = found[: w * h].reshape(h, w)
        if flags & 0x40:  # interlaced: lines come in four passes
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            index = index[np.argsort(order)]
        seen = index != clear_index if clear_index is not None else np.ones((h, w), bool)
        if int(index[seen].max(initial=0)) >= len(palette):
            raise ValueError("index outside the palette")
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        fits = seen[: part.shape[0], : part.shape[1]]
        part[fits] = palette[np.minimum(index, len(palette) - 1)][: part.shape[0], : part.shape[1]][fits]
        yield Frame(now, 10 * delay, canvas.copy(), (left, top, w, h))
        now += 10 * delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = ground[top : top + h, left : left + w]
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, None


def histogram(channel: np.ndarray, bins: int = 16) -> np.ndarray:
    return np.bincount(channel.ravel() // (256 // bins), minlength=bins)


def media_frames(media: DataFrame, id_col: str = "media_id", data_col: str = "data", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per frame of each GIF in a binary column; a null has no frames. A canvas or image of more than ``most_pixels`` is an
    error row; a task needs some ten bytes for each pixel."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                own = 0
                try:
                    for f in decode_gif(data, most_pixels):
                        h, w, _ = f.pixels.shape
                        red, green, blue = (histogram(f.pixels[:, :, c]).tolist() for c in range(3))
                        out.append((key, own, f.start_ms, f.delay_ms, w, h, red, green, blue, hashlib.sha256(f.pixels.tobytes()).hexdigest(), None))
                        own += 1
                except ValueError as e:
                    out.append((key, own, None, None, None, None, None, None, None, None, str(e)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FRAMES.split(", ")])

    return media.select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(task, FRAMES)


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def read_back(gif: bytes) -> tuple[bytes, str]:
    """The samples that a GIF of ``encode_gif`` holds, and a feature of its frames."""
    parts, total, frames, length = [], np.zeros(16, np.int64), 0, 0
    for f in decode_gif(gif):
        left, top, w, h = f.box
        grey = f.pixels[top : top + h, left : left + w, 0]
        parts.append(grey.tobytes())
        total += histogram(grey)
        frames, length = frames + 1, f.start_ms + f.delay_ms
    return b"".join(parts), f"frames={frames};ms={length};histogram=" + ",".join(map(str, total.tolist()))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_id, data): every text as a GIF."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode_gif(padded(t or b"")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["media_id", "data"])

    return docs.select(F.col(id_col).cast("long").alias("media_id"), F.encode(F.col(text_col), "UTF-8")).mapInArrow(task, "media_id long, data binary")


def text_media(docs: DataFrame) -> DataFrame:
    """Digests of every text's GIF and of the samples read back from it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                gif = encode_gif(padded(text or b""))
                payload, feature = read_back(gif)
                out.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            names = [f.split()[0] for f in MEDIA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8")).mapInArrow(task, MEDIA)
