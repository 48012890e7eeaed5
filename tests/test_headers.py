import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framequill.sources import headers


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(w, h, cut=0):
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
    return raw[: len(raw) - cut]


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xff\xc4\x00\x05abc" + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00\xff\xd9"


def webp(kind, w, h):
    body = {b"VP8X": bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"), b"VP8L": b"\x2f" + ((w - 1) | (h - 1) << 14).to_bytes(4, "little"),
            b"VP8 ": b"abc\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h)}[kind]
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def wav(seconds, rate=8000):
    data = bytes(int(seconds * rate))
    return b"RIFF" + struct.pack("<I", 99) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"xyz\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def mp3(frames, tag=True, version=3):
    head = bytes([0xFF, 0xE2 | version << 3 | 1, 9 << 4, 0])
    size = 144 * 128000 // 44100 if version == 3 else 72 * 80000 // 22050
    return (b"ID3\x03\0\0" + bytes([0, 0, 1, 2]) + bytes(130) if tag else b"") + (head + bytes(size - 4)) * frames


def box(name, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, name, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, name) + body


def track(kind, entry, per_second, runs, extra=b""):
    sample = struct.pack(">I4s", 8 + len(extra) + 78, entry) + bytes(24) + struct.pack(">HH", 640, 360) + bytes(50) + extra
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), sample), box(b"stts", struct.pack(">II", 0, len(runs)), b"".join(struct.pack(">II", *r) for r in runs)))
    return box(b"trak", box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, per_second, 1)), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", stbl)))


def mp4(seconds=5, codec=b"avc1", sound=(b"mp4a",), runs=((100, 1001), (50, 1001)), brand=b"isom", version=0):
    mvhd = struct.pack(">IIIII", 0, 0, 0, 600, seconds * 600) if not version else struct.pack(">IQQIQ", 1 << 24, 0, 0, 600, seconds * 600)
    return box(b"ftyp", brand, bytes(4)) + box(b"free", bytes(5), wide=True) + box(b"moov", box(b"mvhd", mvhd), *(track(b"soun", s, 44100, [(1, 1)]) for s in sound), track(b"vide", codec, 30000, runs))


def heif(w, h):
    return box(b"ftyp", b"heic", bytes(4)) + box(b"meta", bytes(4), box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 32, 32)), box(b"ispe", struct.pack(">III", 0, w, h)))))


MPEG_LAYER = box(b"esds", bytes(4), b"\x03\x19\x00\x01\x00\x04\x11\x6b\x15")


@pytest.mark.parametrize("raw,want", [
    (png(300, 400), {"format": "png", "width": 300, "height": 400}), (png(300, 400, cut=3), {}), (png(3, 4)[:-20] + b"x" + png(3, 4)[-19:], {}),
    (jpeg(500, 260), {"format": "jpeg", "width": 500, "height": 260}), (b"\xff\xd8\xff\xd9", {}),
    (webp(b"VP8X", 700, 16384), {"format": "webp", "width": 700, "height": 16384}), (webp(b"VP8L", 700, 800), {"format": "webp", "width": 700, "height": 800}), (webp(b"VP8 ", 700, 800), {"format": "webp", "width": 700, "height": 800}),
    (heif(4000, 3000), {"format": "heif", "width": 4000, "height": 3000}), (wav(2.5), {"format": "wav", "seconds": 2.5}), (wav(2.5)[:-8000], {"format": "wav", "seconds": 1.5}), (wav(1)[:30], {}),
    (mp3(100), {"format": "mp3", "seconds": 100 * 1152 / 44100}), (mp3(40, False, 2), {"format": "mp3", "seconds": 40 * 576 / 22050}), (b"ID3", {}),
    (mp4(), {"format": "mp4", "seconds": 5.0, "sound": ["aac"], "codec": "h264", "width": 640, "height": 360, "rate": 30000 / 1001}),
    (mp4(7, b"hvc1", (), ((10, 1000), (10, 2000)), b"qt  ", 1), {"format": "mp4", "seconds": 7.0, "sound": [], "codec": "hevc", "width": 640, "height": 360, "rate": 20.0}),
    (mp4(5, b"vp09", (b"Opus", b".mp3")), {"format": "mp4", "seconds": 5.0, "sound": ["Opus", "mp3"], "codec": "vp09", "width": 640, "height": 360, "rate": 30000 / 1001}),
    (mp4()[:-4], {}), (b"", {}), (b"plain text that is no medium", {}),
])
def test_headers_of_own_small_files(raw, want):
    found = headers.probe(raw)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v) if isinstance(v, float) else found[k] == v for k, v in want.items())


def test_sound_of_older_layers():
    raw = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1, 3)), track(b"soun", b"mp4a", 44100, [(1, 1)], MPEG_LAYER))
    assert headers.probe(raw) == {"format": "mp4", "seconds": 3.0, "sound": ["mp3"]}


def test_figures_against_the_declared_type(spark):
    rows = [
        ("image/png", png(300, 400), None), ("image/jpeg", png(300, 400), "mime"), ("IMAGE/JPEG", jpeg(500, 260), None), ("image/png", png(255, 400), "side"), ("image/png", png(1000, 300), "ratio"),
        ("image/heic", heif(4000, 3000), None), ("audio/x-wav", wav(2.5), None), ("audio/wav", wav(1.0), "seconds"), ("audio/mpeg", wav(2.5), "mime"), ("audio/mp3", mp3(100), None),
        ("video/mp4", mp4(), None), ("video/quicktime", mp4(brand=b"qt  "), None), ("video/mp4", mp4(16), "seconds"), ("video/mp4", mp4(codec=b"vp09"), "codec"), ("video/mp4", mp4(sound=(b"Opus",)), "sound"),
        ("video/mp4", mp4(runs=((9, 2000),)), "rate"), ("image/webp", b"oops", "format"), ("image/webp", None, "format"), (None, png(300, 400), "mime"), ("audio/wav", wav(2.5, 7_000_000), "bytes"),
    ]
    df = spark.createDataFrame([(i, m, None if c is None else bytearray(c)) for i, (m, c, _) in enumerate(rows)], "i int, mime string, content binary")
    found = {r["i"]: r for r in headers.probed(df).withColumn("problem", headers.problem(F.col("mime"))).collect()}
    assert {i: found[i]["problem"] for i in range(len(rows))} == {i: r[2] for i, r in enumerate(rows)}
    assert found[0]["bytes"] == len(rows[0][1]) and len(found[0]["sha256"]) == 64 and found[17]["bytes"] is None
