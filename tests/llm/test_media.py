import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from haltbook.llm import media


def slow_lzw_decode(stream, bits):
    """Bit by bit, straight from the format's description."""
    clear, end = 1 << bits, (1 << bits) + 1
    pos, width, table, last, out = 0, bits + 1, None, None, bytearray()
    while True:
        code = sum((stream[(pos + k) // 8] >> (pos + k) % 8 & 1) << k for k in range(width))
        pos += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [None, None], bits + 1, None
        elif code == end:
            return bytes(out)
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            last = entry


def samples():
    rng = random.Random(1)
    yield b"a"
    yield b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50
    yield bytes(range(256)) * 40
    yield rng.randbytes(30_000)
    yield ("the of and " * 9000).encode()


@pytest.mark.parametrize("data", list(samples()), ids=len)
def test_lzw(data):
    stream = media.lzw_encode(data)
    assert slow_lzw_decode(stream, 8) == data
    assert media.lzw_decode(stream, 8) == data


def slow_pack(codes, widths):
    value = n = 0
    for c, w in zip(codes, widths, strict=True):
        value |= c << n
        n += w
    return value.to_bytes((n + 7) // 8, "little")


def test_deferred_clear():
    """An encoder may go on with a full table; code widths stay at 12."""
    rng = random.Random(2)
    data = bytes(rng.randrange(4) for _ in range(60_000))
    clear, end, table, codes, prefix = 4, 5, {bytes([i]): i for i in range(4)}, [4], b""
    free, widths, width, read = 6, [3], 3, 0
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if free < 4096:
            table[prefix + bytes([b])] = free
            free += 1
        prefix = bytes([b])
    codes += [table[prefix], end]
    size, first = 6, True
    for c in codes[1:]:
        widths.append(width)
        if not first and size < 4096:
            size += 1
        first = False
        if size == 1 << width and width < 12:
            width += 1
    stream = slow_pack(codes, widths)
    assert slow_lzw_decode(stream, 2) == data and media.lzw_decode(stream, 2) == data


def gif(frames, width=4, height=2, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), background=0):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, background, 0) + bytes(v for p in palette for v in p)
    for f in frames:
        out += b"\x21\xfe\x03abc\x00"
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", f.get("disposal", 0) << 2 | (f.get("clear") is not None), f.get("delay", 5), f.get("clear") or 0, 0)
        local = f.get("palette")
        flags = (0x80 | 0 if local else 0) | (0x40 if f.get("interlaced") else 0)
        left, top, w, h = f["box"]
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags)
        if local:
            out += bytes(v for p in local for v in p)
        out += b"\x02" + media.blocks(media.lzw_encode(bytes(f["pixels"]), 2))
    return out + b"\x3b"


def test_disposal_transparency_palettes():
    data = gif(
        [
            {"box": (0, 0, 4, 2), "pixels": [1] * 8, "disposal": 1},
            {"box": (1, 0, 2, 1), "pixels": [2, 3], "clear": 3, "disposal": 3, "delay": 7},
            {"box": (0, 1, 2, 1), "pixels": [0, 1], "palette": ((9, 9, 9), (7, 7, 7)), "disposal": 2},
            {"box": (3, 1, 1, 1), "pixels": [2]},
        ]
    )
    a, b, c, d = media.decode_gif(data)
    red, green, black = [255, 0, 0], [0, 255, 0], [0, 0, 0]
    assert (a.pixels == red).all() and a.delay_ms == 50 and b.start_ms == 50 and c.start_ms == 120
    assert b.pixels[0].tolist() == [red, green, red, red]
    assert c.pixels[0].tolist() == [red] * 4 and c.pixels[1].tolist() == [[9, 9, 9], [7, 7, 7], red, red]
    assert d.pixels[1].tolist() == [black, black, red, green]


def test_interlaced():
    rows = [[y % 4] * 4 for y in range(11)]
    order = [0, 8, 4, 2, 6, 10, 1, 3, 5, 7, 9]
    data = gif([{"box": (0, 0, 4, 11), "pixels": [v for y in order for v in rows[y]], "interlaced": True}], height=11)
    (f,) = media.decode_gif(data)
    assert [int(np.argmax(r[0])) + 1 if r[0].any() else 0 for r in f.pixels] == [y % 4 for y in range(11)]


def test_broken_streams(spark):
    good = media.encode_gif(b"x" * 192)
    rows = [(1, good), (2, good[:-20]), (3, b"nonsense"), (4, None), (None, good)]
    got = media.media_frames(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert sorted((r.media_id or 0, r.error is None) for r in got) == [(0, True), (1, True), (2, False), (3, False)]
    one = next(r for r in got if r.media_id == 1)
    assert one.red_histogram[ord("x") // 16] == 192 and (one.width, one.height, one.delay_ms) == (192, 1, 100)
    assert media.media_frames(spark.createDataFrame([], "media_id long, data binary")).count() == 0


def test_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "long text " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "q", "f")], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
    assert got[2][1:] == got[6][1:]
    stored = media.store_texts(docs).collect()
    assert next(hashlib.sha256(r.data).hexdigest() for r in stored if r.media_id == 5) == got[5].media_sha256
    assert media.text_media(docs.limit(0)).count() == 0


def test_malformed_blocks(spark):
    good = media.encode_gif(b"x" * 192)
    at = good.index(b"\x21\xf9\x04")
    short = good[:at] + b"\x21\xf9\x02ab\x00" + good[at + 8 :]
    huge = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    wide = bytearray(good)
    wide[at + 13 : at + 17] = b"\xff\xff\xff\xff"
    for bad in (short, huge, bytes(wide), good[:at], good[:-1]):
        with pytest.raises(ValueError):
            list(media.decode_gif(bad))
    rows = media.media_frames(spark.createDataFrame([(1, bytearray(short)), (2, bytearray(huge)), (3, bytearray(good))], "media_id long, data binary")).collect()
    assert sorted((r.media_id, r.error is None) for r in rows) == [(1, False), (2, False), (3, True)]


def test_canvas_bound_is_a_parameter(spark):
    gif = media.encode_gif(media.padded(b"some text " * 100))
    df = spark.createDataFrame([(1, gif), (2, None)], "media_id long, data binary")
    refused = media.media_frames(df, most_pixels=10).collect()
    assert [(r.media_id, r.error) for r in refused] == [(1, "more than 10 pixels")]
    frames = media.media_frames(df, most_pixels=1 << 25).collect()
    assert frames and all(r.error is None and sum(r.red_histogram) == r.width * r.height for r in frames)
