"""Size, duration, rate, codecs and container of media, read from their bytes in an Arrow kernel.

Known are PNG (chunk sums checked), JPEG, WebP, HEIF, WAV, MP3 (all frames counted) and MP4 or QuickTime boxes. Nothing is decoded. What
is none of these, or breaks off before its figures, has the format null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framequill.operators.requests import MOST_BYTES, RATES, RATIOS, SECONDS, SIDES
from framequill.session import ship

ship(__name__)

#: Types that may be declared for each format; codecs of video and of its sound.
MIMES = {"jpeg": ("image/jpeg",), "png": ("image/png",), "webp": ("image/webp",), "heif": ("image/heif", "image/heic"), "mp4": ("video/mp4", "video/quicktime"),
         "wav": ("audio/wav", "audio/x-wav", "audio/vnd.wave"), "mp3": ("audio/mpeg", "audio/mp3")}
VIDEO_CODECS, SOUND_CODECS = ("h264", "hevc"), ("aac", "mp3")
KINDS = {"jpeg": "image", "png": "image", "webp": "image", "heif": "image", "mp4": "video", "wav": "audio", "mp3": "audio"}
#: Sample entries of MP4 and the codec each stands for; brands of still images.
ENTRIES = {b"avc1": "h264", b"avc3": "h264", b"hvc1": "hevc", b"hev1": "hevc", b".mp3": "mp3", b"mp4a": "aac"}
STILLS = {b"heic", b"heix", b"heim", b"heis", b"mif1", b"hevc"}
#: kbit/s of layer III frames by number, of version 1 and of later ones; Hz.
BITRATES = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
HERTZ = (44100, 48000, 32000)


def png(raw: memoryview) -> dict:
    at, found = 8, {}
    while True:
        size, name = struct.unpack_from(">I4s", raw, at)
        if struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(raw[at + 4 : at + 8 + size]):
            raise ValueError("sum")
        if name == b"IHDR":
            found["width"], found["height"] = struct.unpack_from(">II", raw, at + 8)
        if name == b"IEND":
            return found
        at += size + 12


def jpeg(raw: memoryview) -> dict:
    at = 2
    while raw[at] == 0xFF:
        mark = raw[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD7 or mark == 0x01:
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return {"width": width, "height": height}
        at += 2 + size
    raise ValueError("no frame")


def webp(raw: memoryview) -> dict:
    name = bytes(raw[12:16])
    if name == b"VP8X":
        return {"width": int.from_bytes(raw[24:27], "little") + 1, "height": int.from_bytes(raw[27:30], "little") + 1}
    if name == b"VP8L" and raw[20] == 0x2F:
        bits = int.from_bytes(raw[21:25], "little")
        return {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1}
    if name == b"VP8 " and bytes(raw[23:26]) == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", raw, 26)
        return {"width": width & 0x3FFF, "height": height & 0x3FFF}
    raise ValueError("no picture")


def wav(raw: memoryview) -> dict:
    at, rate = 12, 0
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", raw, at + 16)[0]
        if name == b"data":
            return {"seconds": min(size, len(raw) - at - 8) / rate}
        at += 8 + size + size % 2
    raise ValueError("no data")


def mp3(raw: memoryview) -> dict:
    at, seconds = 0, 0.0
    if bytes(raw[:3]) == b"ID3":
        at = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(raw[6:10]))
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] & 0xE6 == 0xE2:
        version, rate, hertz = raw[at + 1] >> 3 & 3, raw[at + 2] >> 4, raw[at + 2] >> 2 & 3
        if version == 1 or not 0 < rate < 15 or hertz == 3:
            break
        first = version == 3
        samples, per_second = 1152 if first else 576, HERTZ[hertz] >> {3: 0, 2: 1, 0: 2}[version]
        seconds += samples / per_second
        at += samples // 8 * BITRATES[0 if first else 1][rate - 1] * 1000 // per_second + (raw[at + 2] >> 1 & 1)
    if not seconds:
        raise ValueError("no frame")
    return {"seconds": seconds}


def boxes(raw: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the boxes in a stretch."""
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", raw, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("box")
        yield name, at + head, at + size
        at += size


def inside(raw: memoryview, at: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    for name, a, b in boxes(raw, at, end):
        if name == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from inside(raw, a, b, *path[1:])


def clock(raw: memoryview, at: int) -> tuple[int, int]:
    """(ticks a second, ticks) of a header box of either version."""
    return struct.unpack_from(">IQ", raw, at + 20) if raw[at] else struct.unpack_from(">II", raw, at + 12)  # type: ignore[return-value]


def heif(raw: memoryview) -> dict:
    sizes = [struct.unpack_from(">II", raw, c + 4) for a, b in inside(raw, 0, len(raw), b"meta") for c, _ in inside(raw, a + 4, b, b"iprp", b"ipco", b"ispe")]
    width, height = max(sizes, key=lambda s: s[0] * s[1])
    return {"width": width, "height": height}


def mp4(raw: memoryview) -> dict:
    found: dict = {"sound": []}
    for moov in inside(raw, 0, len(raw), b"moov"):
        for at, _ in inside(raw, *moov, b"mvhd"):
            per_second, ticks = clock(raw, at)
            found["seconds"] = ticks / per_second
        for trak in inside(raw, *moov, b"trak"):
            kind = [bytes(raw[at + 8 : at + 12]) for at, _ in inside(raw, *trak, b"mdia", b"hdlr")]
            for at, end in inside(raw, *trak, b"mdia", b"minf", b"stbl", b"stsd"):
                size, name = struct.unpack_from(">I4s", raw, at + 8)
                codec = ENTRIES.get(name, name.decode("latin-1"))
                if name == b"mp4a" and (esds := bytes(raw[at + 8 : at + 8 + size]).find(b"esds")) >= 0:
                    tail = bytes(raw[at + 8 + esds + 8 : at + 8 + size])
                    config = tail.find(b"\x04")
                    codec = "mp3" if config >= 0 and set(tail[config + 1 : config + 6]) & {0x69, 0x6B} else codec
                if kind == [b"soun"]:
                    found["sound"].append(codec)
                elif kind == [b"vide"] and "codec" not in found:
                    found["codec"] = codec
                    found["width"], found["height"] = struct.unpack_from(">HH", raw, at + 8 + 32)
                    per_second = next(clock(raw, a)[0] for a, _ in inside(raw, *trak, b"mdia", b"mdhd"))
                    for a, _ in inside(raw, *trak, b"mdia", b"minf", b"stbl", b"stts"):
                        n = struct.unpack_from(">I", raw, a + 4)[0]
                        runs = struct.unpack_from(f">{2 * n}I", raw, a + 8)
                        ticks = sum(c * d for c, d in zip(runs[::2], runs[1::2]))
                        found["rate"] = sum(runs[::2]) * per_second / ticks if ticks else None
    if "seconds" not in found:
        raise ValueError("no movie")
    return found


def probe(content: bytes | memoryview) -> dict:
    """What a medium's bytes say; empty for none that is known."""
    raw = memoryview(content).cast("B")
    head = bytes(raw[:12])
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        kind, read = "png", png
    elif head[:3] == b"\xff\xd8\xff":
        kind, read = "jpeg", jpeg
    elif head[:4] == b"RIFF" and head[8:] == b"WEBP":
        kind, read = "webp", webp
    elif head[:4] == b"RIFF" and head[8:] == b"WAVE":
        kind, read = "wav", wav
    elif head[4:8] == b"ftyp":
        kind, read = ("heif", heif) if head[8:] in STILLS else ("mp4", mp4)
    elif head[:3] == b"ID3" or len(head) > 1 and head[0] == 0xFF and head[1] & 0xE6 == 0xE2:
        kind, read = "mp3", mp3
    else:
        return {}
    try:
        return {"format": kind, **read(raw)}
    except (ValueError, IndexError, struct.error, ZeroDivisionError, StopIteration):
        return {}


FIGURES = {"format": pa.string(), "width": pa.int64(), "height": pa.int64(), "seconds": pa.float64(), "rate": pa.float64(), "codec": pa.string(), "sound": pa.list_(pa.string())}


def probed(media: DataFrame, content: str = "content") -> DataFrame:
    """Adds bytes, sha256, format, width, height, seconds, rate, codec and sound (codecs) to media; ``content`` itself is dropped."""
    kept = [c for c in media.columns if c != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != content), "bytes long, sha256 string",
                        "format string, width long, height long, seconds double, rate double, codec string, sound array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            raw = [None if not v.is_valid else memoryview(v.as_buffer()) for v in batch.column(batch.schema.get_field_index(content))]
            found = [{} if r is None else probe(r) for r in raw]
            extra = [pa.array([None if r is None else len(r) for r in raw], pa.int64()), pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in raw])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in kept), *extra, *(pa.array([f.get(k) for f in found], t) for k, t in FIGURES.items())],
                [*kept, "bytes", "sha256", *FIGURES])

    return media.select(*kept, content).mapInArrow(run, schema)


def problem(mime: Column) -> Column:
    """The first rule that figures of ``probed`` break under a declared type, null for none: format, bytes, mime, seconds, codec, sound, rate, side, ratio."""
    table = lambda d, lit: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), lit(v))])
    kind = F.try_element_at(table(KINDS, F.lit), F.col("format"))
    types = F.try_element_at(table(MIMES, lambda v: F.array(*[F.lit(t) for t in v])), F.col("format"))
    most = F.try_element_at(table(MOST_BYTES, lambda v: F.lit(v).cast("long")), kind)
    within = lambda c, limits: F.coalesce(c.between(*limits), F.lit(False))
    w, h = F.col("width"), F.col("height")
    return (F.when(F.col("format").isNull(), "format").when(F.col("bytes") > most, "bytes").when(~F.coalesce(F.array_contains(types, F.lower(mime)), F.lit(False)), "mime")
            .when((kind != "image") & ~within(F.col("seconds"), SECONDS), "seconds")
            .when((kind == "video") & ~F.coalesce(F.col("codec").isin(*VIDEO_CODECS), F.lit(False)), "codec")
            .when((kind == "video") & F.exists("sound", lambda s: ~s.isin(*SOUND_CODECS)), "sound")
            .when((kind == "video") & ~within(F.col("rate"), RATES), "rate")
            .when((kind != "audio") & ~(within(F.least(w, h), SIDES) & within(F.greatest(w, h), SIDES)), "side")
            .when((kind != "audio") & ~within(w / h, RATIOS), "ratio"))
