"""Operator 5, media columns: MPEG audio.

The reader walks an MPEG audio stream frame by frame: it reads ID3v2 (2.2 to 2.4, with extended headers, footers and
unsynchronisation), ID3v1 and APE tags, finds the next sound frame header where one is lost (a candidate counts only if
a header of the same stream, a tag or the end follows it), reads the Xing/Info or VBRI table of variable bitrates,
verifies the CRC-16 of protected frames of all layers, and gives the exact number of samples, the duration as a
fraction, and the byte offset of every frame.

The writer stores any bytes losslessly in a valid stream: MPEG-1 Layer III, mono, 32 kHz, each frame protected,
without main data of its own (silence), the payload in the frames' ancillary bytes.  All frames but the last have
1440 bytes; the last one takes the smallest bitrate that holds the rest.  An ID3v2 tag names the payload's size,
a Xing frame the number of frames and bytes and a seek table.  Where payload would stand in the place of an ID3v1 or APE
tag and look like one, an empty frame follows.  Reading columns fails if a payload is shorter than its tag says.

Defined results: a null or empty text is 64 zero bytes; a null media value has null columns; bytes without any
frame have 0 frames and samples, and last 0/1 s; very long texts are one stream each, worked on alone; other columns are
ignored, whatever their names; repeated rows are repeated; an empty table stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import BATCH_BYTES, map_batches, rows_of, table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, samples/s by index.
_V1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
_V2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_NAMES = {3: "1", 2: "2", 0: "2.5"}

#: Bits of an allocation by subband in Layer II: (number of subbands, bits) runs of tables B.2a to d and of the low rates.
_ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}

_SIDE = 17
_OVERHEAD = 4 + 2 + _SIDE
_ALIGN = 64


@functools.lru_cache(4096)
def parse_header(head: bytes) -> tuple | None:
    """(version bits, layer, protected, rate, channels, frame bytes, samples, side bytes) of 4 bytes; None: no header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    kbit, rate, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    hz, bps = _RATES[version][rate], (_V1 if version == 3 else _V2)[layer][kbit] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * bps // hz + pad) * 4 if layer == 1 else samples // 8 * bps // hz + pad
    channels = 1 if head[3] >> 6 == 3 else 2
    side = ((17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)) if layer == 3 else 0
    return version, layer, not head[1] & 1, hz, channels, size, samples, side


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """The CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for byte in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ byte]) & 0xFFFF
    return c


def _allocation(version: int, hz: int, kbit: int) -> list[int]:
    """Bits of each subband's allocation in Layer II, by the bitrate of one channel."""
    if version != 3:
        name = "low"
    elif kbit < 56:
        name = "d" if hz == 32000 else "c"
    else:
        name = "b" if kbit >= 96 and hz != 48000 else "a"
    return [bits for count, bits in _ALLOCATIONS[name] for _ in range(count)]


def protected_bits(head: bytes, body: bytes) -> int:
    """How many bits behind the checksum of a Layer I or II frame it covers: the allocations and, in Layer II, the
    selections of scale factors."""
    version, layer, _, hz, channels, *_ = parse_header(head)
    mode, extension = head[3] >> 6, head[3] >> 4 & 3
    each = [4] * 32 if layer == 1 else _allocation(version, hz, (_V1 if version == 3 else _V2)[2][head[2] >> 4] // channels)
    bound = 4 * extension + 4 if mode == 1 else len(each)  # from here on both channels share an allocation
    widths = [bits for k, bits in enumerate(each) for _ in range(channels if k < bound else 1)]
    total = sum(widths)
    if layer == 1:
        return total
    value, size = int.from_bytes(body, "big"), 8 * len(body)
    at, used = 0, 0
    for k, bits in enumerate(each):
        for _ in range(channels if k < bound else 1):
            at += bits
            if at <= size and value >> (size - at) & ((1 << bits) - 1):
                used += 1 if k < bound else channels
    return total + 2 * used


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16() of the first bits of data."""
    c = crc16(bytes(data[: bits // 8]))
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        c = (c << 1 ^ (0x8005 if c >> 15 ^ bit else 0)) & 0xFFFF
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3(fields: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + struct.pack(">IH", len(v), 0) + v for v in (b"\0" + k.encode() + b"\0" + x.encode() for k, x in fields.items()))
    return b"ID3\x03\0\0" + _syncsafe(len(body)) + body


def _frame_head(kbit: int, protected: bool = True) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, kbit << 4 | 2 << 2, 0xC0))


def _room(kbit: int) -> int:
    return parse_header(_frame_head(kbit))[5] - _OVERHEAD


_ROOMS = [0, *(_room(k) for k in range(1, 15))]


def write_audio(payload: bytes) -> bytes:
    """An MPEG audio stream that holds `payload`."""
    full, rest = divmod(len(payload), _ROOMS[14])
    parts = []
    for kbit, count, data in ((14, full, payload[: full * _ROOMS[14]]), *([(next(k for k in range(1, 15) if _ROOMS[k] >= rest), 1, payload[full * _ROOMS[14] :])] if rest else [])):
        if count:
            head = _frame_head(kbit)
            lead = head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)
            frames = np.zeros((count, _OVERHEAD + _ROOMS[kbit]), np.uint8)
            frames[:, :_OVERHEAD] = np.frombuffer(lead, np.uint8)
            own = np.frombuffer(data, np.uint8)
            if len(own) == count * _ROOMS[kbit]:
                frames[:, _OVERHEAD:] = own.reshape(count, -1)
            else:
                frames[0, _OVERHEAD : _OVERHEAD + len(own)] = own
            parts.append(frames.tobytes())
    ends = [full * (_OVERHEAD + _ROOMS[14]), sum(map(len, parts))]  # of the full frames and of the payload
    last = b"".join(parts[-2:])[-128:]
    if last[:3] == b"TAG" or last[-32:-24] == b"APETAGEX":
        empty = _frame_head(1)
        parts.append((empty + struct.pack(">H", crc16(empty[2:] + bytes(_SIDE)))).ljust(_OVERHEAD + _ROOMS[1], b"\0"))
    sound = b"".join(parts)
    n = full + bool(rest) + (len(sound) > ends[1])
    head = _frame_head(5, protected=False)
    size = parse_header(head)[5]
    total = size + len(sound)
    starts = [(k * (_OVERHEAD + _ROOMS[14]) if k <= full else ends[1]) + size for k in (n * i // 100 for i in range(100))]
    xing = (head + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, n, total) + bytes(min(255, s * 256 // total) for s in starts)).ljust(size, b"\0")
    return _id3({"payload_bytes": str(len(payload))}) + xing + sound


def _big(raw: bytes, bits: int = 8) -> int:
    return functools.reduce(lambda a, b: a << bits | b & ((1 << bits) - 1), raw, 0)


def _text(value: bytes) -> str:
    return value[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")


def _id3v2(media: bytes, start: int, fields: dict[str, str]) -> int:
    """Reads the text frames of the tag at `start`; where it ends."""
    version, flags = media[start + 3], media[start + 5]
    stop = start + 10 + _big(media[start + 6 : start + 10], 7)
    body = media[start + 10 : stop]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version == 3:
        at = 4 + _big(body[:4])
    elif flags & 0x40 and version == 4:
        at = _big(body[:4], 7)
    wide = 3 if version == 2 else 4  # bytes of names and sizes
    lead = 2 * wide + (0 if version == 2 else 2)
    while at + lead <= len(body) and body[at : at + wide].strip(b"\0"):
        name, n = body[at : at + wide].decode("latin-1"), _big(body[at + wide : at + 2 * wide], 7 if version == 4 else 8)
        value, marks = body[at + lead : at + lead + n], body[at + 9] if version == 4 else 0
        if marks & 1:  # the length of the data stands in front of it
            value = value[4:]
        if marks & 2 or (version == 4 and flags & 0x80 and not marks & 1):
            value = value.replace(b"\xff\x00", b"\xff")
        if name[:1] == "T" and value:
            key, _, rest = _text(value).partition("\0")
            own = name in ("TXXX", "TXX")
            fields[f"TXXX:{key}" if own else name] = rest.rstrip("\0") if own else _text(value).rstrip("\0")
        at += lead + n
    return min(len(media), stop + 10 * bool(version == 4 and flags & 0x10))


def _ape(media: bytes, at: int, stop: int, count: int, fields: dict[str, str]) -> None:
    for _ in range(count):
        if at + 9 > stop:
            return
        n, kind = struct.unpack_from("<II", media, at)
        end = media.find(b"\0", at + 8, stop)
        if end < 0:
            return
        if kind >> 1 & 3 == 0:  # text
            fields[f"APE:{media[at + 8 : end].decode('latin-1')}"] = media[end + 1 : min(stop, end + 1 + n)].decode("utf-8", "replace")
        at = end + 1 + n


def _tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Fields of ID3v2, ID3v1 and APE tags; where the frames may start and must end."""
    fields, start, end = {}, 0, len(media)
    while len(media) >= start + 10 and (media[start : start + 3] == b"ID3" or media[start : start + 8] == b"APETAGEX"):
        if media[start : start + 3] == b"ID3":
            start = _id3v2(media, start, fields)
            continue
        size, count, flags = struct.unpack_from("<III", media.ljust(start + 32, b"\0"), start + 12)
        if not flags >> 29 & 1:  # no header
            break
        _ape(media, start + 32, min(len(media), start + size), count, fields)
        start = min(len(media), start + 32 + size)
    if end - start >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            fields[f"v1:{name}"] = media[end + a : end + b].split(b"\0")[0].decode("latin-1").rstrip()
    if end - start >= 32 and media[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack_from("<III", media, end - 20)
        whole = size + 32 * (flags >> 31)
        if 32 <= size and whole <= end - start:
            _ape(media, end - size, end - 32, count, fields)
            end -= whole
    return fields, start, end


def _table(media: bytes, at: int, layer: int, body: int, side: int) -> dict | None:
    """The Xing, Info or VBRI table of the frame at `at`: frames, bytes, toc, kind."""
    mark = media[body + side : body + side + 4]
    if layer == 3 and mark in (b"Xing", b"Info"):
        flags, spot = _big(media[body + side + 4 : body + side + 8]), body + side + 8
        vbr = {"frames": None, "bytes": None, "toc": b"", "start": at, "kind": mark.decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                vbr[key] = _big(media[spot : spot + 4])
                spot += 4
        if flags & 4:
            vbr["toc"] = media[spot : spot + 100]
        return vbr
    if layer == 3 and media[at + 36 : at + 40] == b"VBRI":
        size, frames, entries, scale, wide, each = struct.unpack_from(">IIHHHH", media.ljust(at + 62, b"\0"), at + 46)
        toc = [scale * _big(media[at + 62 + i * wide : at + 62 + (i + 1) * wide]) for i in range(entries)]
        return {"frames": frames, "bytes": size, "toc": toc, "start": at, "kind": "VBRI", "frames_per_entry": each}
    return None


def _follows(media: bytes, at: int, end: int, like: tuple) -> bool:
    if at == end:
        return True
    got = parse_header(media[at : at + 4])
    return got is not None and (got[0], got[1], got[3]) == (like[0], like[1], like[3])


def read_audio(media: bytes) -> dict:
    """What the stream says: see the keys of the result.  `ancillary` are the bytes behind the side information of
    protected Layer III frames without main data."""
    fields, at, end = _tags(media)
    offsets: list[int] = []
    pieces: list[bytes] = []
    samples = good = bad = skipped = 0
    vbr, first = None, None
    while at + 4 <= end:
        head = media[at : at + 4]
        got = parse_header(head)
        if got is None or at + got[5] > end or (first and (got[0], got[1], got[3]) != (first[0], first[1], first[3])) or (first is None and not _follows(media, at + got[5], end, got)):
            lost = at
            at = media.find(b"\xff", at + 1, end)
            while at >= 0 and not ((got := parse_header(media[at : at + 4])) and at + got[5] <= end and _follows(media, at + got[5], end, first or got)):
                at = media.find(b"\xff", at + 1, end)
            if at < 0:
                at = end
            skipped += at - lost
            continue
        _, layer, protected, _, _, size, count, side = got
        body = at + 4 + 2 * protected
        if first is None:
            first = got
            if (vbr := _table(media, at, layer, body, side)) is not None:
                at += size
                continue
        if protected and layer == 3:
            info = media[body : body + side]
            if crc16(head[2:] + info) == int.from_bytes(media[at + 4 : at + 6], "big"):
                good += 1
                if not any(info):
                    pieces.append(media[body + side : at + size])
            else:
                bad += 1
        elif protected:
            bits = protected_bits(head, media[body : min(at + size, body + 64)])
            sound = bits <= 8 * (size - 6) and crc16_bits(head[2:] + media[body : at + size], 16 + bits) == int.from_bytes(media[at + 4 : at + 6], "big")
            good, bad = good + sound, bad + (not sound)
        offsets.append(at)
        samples += count
        at += size
    skipped += max(0, end - at)
    ancillary = b"".join(pieces)
    declared = fields.get("TXXX:payload_bytes", "")
    rate = first[3] if first else 0
    exact = bool(vbr) and vbr["frames"] in (None, len(offsets)) and vbr["bytes"] in (None, at - vbr["start"])
    return {
        "version": _NAMES[first[0]] if first else None,
        "layer": first[1] if first else None,
        "sample_rate": rate,
        "channels": first[4] if first else 0,
        "n_samples": samples,
        "duration": Fraction(samples, rate) if rate else Fraction(0),
        "offsets": np.array(offsets, np.int64),
        "crc_ok": good,
        "crc_bad": bad,
        "skipped": skipped,
        "vbr": vbr,
        "vbr_exact": exact,
        "tags": fields,
        "payload": ancillary[: int(declared)] if declared.isdigit() else ancillary,
    }


_MEDIA = "{id} long, n_bytes long, media binary"


def to_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the unpadded UTF-8 text), media: the text, padded with zeros to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                media = (write_audio((x := t or b"") + bytes(-len(x) % _ALIGN or (_ALIGN if not x else 0))) for t in texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).cast("long").alias(id_col), text_col), run, _MEDIA.format(id=id_col))


_READ = (
    "{id} long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, version string, layer int, sample_rate int, "
    "channels int, n_frames long, n_samples long, duration_num long, duration_den long, duration_s double, frame_offsets array<long>, crc_ok long, crc_bad long, skipped_bytes long, vbr_exact boolean, tags map<string,string>"
)


def read_audio_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The columns of read_audio() for each media value, with digests of the payload that was read back."""
    schema = _READ.format(id=id_col)
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string())]

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 20
        x = read_audio(media)
        p, declared = x["payload"], x["tags"].get("TXXX:payload_bytes", "")
        if declared.isdigit() and len(p) < int(declared):
            raise ValueError(f"payload of {len(p)} bytes, {declared} declared")
        return (
            len(media), hashlib.sha256(media).hexdigest(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-_ALIGN:]), x["version"], x["layer"], x["sample_rate"], x["channels"],
            len(x["offsets"]), x["n_samples"], x["duration"].numerator, x["duration"].denominator, float(x["duration"]), x["offsets"].tolist(), x["crc_ok"], x["crc_bad"], x["skipped"], x["vbr_exact"], list(x["tags"].items()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, BATCH_BYTES):
                columns = list(zip(*(row(m.as_py()) for m in part.column(2)), strict=True)) or [()] * 20
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, types[2:], strict=True))], names)

    return map_batches(df.select(F.col(id_col).cast("long").alias(id_col), "n_bytes", media_col), run, schema)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_audio_columns(to_audio(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("mpeg"), "version", F.lit("-layer"), F.col("layer").cast("string")),
        F.concat(F.col("sample_rate").cast("string"), F.lit("Hz")),
        F.concat(F.lit("channels="), F.col("channels").cast("string")),
        F.concat(F.lit("frames="), F.col("n_frames").cast("string")),
        F.concat(F.lit("samples="), F.col("n_samples").cast("string")),
        F.concat(F.lit("crc="), F.col("crc_ok").cast("string"), F.lit("/"), (F.col("crc_ok") + F.col("crc_bad")).cast("string")),
        F.concat(F.lit("vbr="), F.col("vbr_exact").cast("string")),
        F.concat(F.lit("skipped="), F.col("skipped_bytes").cast("string")),
        F.concat(F.lit("seek="), F.crc32(F.array_join("frame_offsets", ",")).cast("string")),
    )
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_s")
