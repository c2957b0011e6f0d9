"""MPEG audio columns: a reader that resynchronises, parses tags and variable-bitrate tables and verifies checksums, and a
writer that stores bytes losslessly as 8-bit samples.

Reader: skips ID3v2 tags (syncsafe sizes, footers), finds frame headers of MPEG 1, 2 and 2.5, layers I to III, by a chain of two
headers that agree (or one at the end of the stream), resynchronises over junk, reads Xing/Info and VBRI tables, checks the CRC-16 of protected frames, and ends at ID3v1 or
APE tags. It yields exact durations (samples and sampling rate) and the byte offset of each frame for seeking.

Writer: MPEG 1 layer I, 48 kHz, mono, CRC protected, variable bitrate. A frame's 12 x 32 subband samples take eight bits each
(bit allocation code 7), so a full frame holds 384 payload bytes; the last one uses as few subbands as it needs and the lowest
bitrate that fits. A byte 0xFF isn't a legal eight-bit sample code; payloads that hold one are refused. UTF-8 never does, and bytes that are no UTF-8 are read as U+FFFD.
An ID3v2.4 tag holds the payload's length; a first frame without samples holds a VBRI table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import slices, utf8

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG 1 or not, layer), sampling rates, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ (0x8005 if _c & 0x8000 else 0)) & 0xFFFF
    _CRC.append(_c)


def crc16(data: bytes, bits: int | None = None) -> int:
    """MPEG's CRC-16 (polynomial 0x8005, start 0xFFFF) of the first ``bits`` bits."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for k in range((bits or 0) % 8 if bits is not None else 0):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ data[whole] >> (7 - k) & 1) else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int  # 3: mono
    extension: int
    size: int
    samples: int


_headers: dict[bytes, Header | None] = {}


def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames, whose size no header tells, aren't read."""
    if word in _headers:
        return _headers[word]
    out = None
    if len(word) == 4 and word[0] == 0xFF and word[1] >= 0xE0:
        version, layer = {0: 25, 2: 2, 3: 1}.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
        index, rate = word[2] >> 4, word[2] >> 2 & 3
        if version and layer < 4 and 0 < index < 15 and rate < 3 and word[3] & 3 != 2:
            own = 1 if version == 1 else 2
            kbps, hz, pad, samples = BITRATES[own, layer][index], RATES[version][rate], word[2] >> 1 & 1, SAMPLES[own, layer]
            size = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
            out = Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6, word[3] >> 4 & 3, size, samples)
    if len(_headers) > 65_536:
        _headers.clear()
    _headers[word] = out
    return out


def _side_bytes(h: Header) -> int:
    return (17 if h.mode == 3 else 32) if h.version == 1 else (9 if h.mode == 3 else 17)


def _protected_bits(h: Header) -> int:
    """Bits after the checksum that it covers; layer II's depend on its allocation tables and aren't verified (-1)."""
    if h.layer == 1:
        return 128 if h.mode == 3 else (4 * (h.extension + 1) * 8 + (32 - 4 * (h.extension + 1)) * 4 if h.mode == 1 else 256)
    return 8 * _side_bytes(h) if h.layer == 3 else -1


@dataclass
class Stream:
    """What the reader found. offsets: byte offset of each audio frame; junk: bytes skipped to resynchronise."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    junk: int = 0
    checked: int = 0
    bad: int = 0
    table: dict = field(default_factory=dict)

    @property
    def microseconds(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at ``at`` and returns where it ends."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    p, end = at + 10, min(len(data), at + 10 + size)
    if flags & 0x40 and end - p >= 4:  # extended header
        p += _syncsafe(data[p : p + 4]) if major == 4 else int.from_bytes(data[p : p + 4], "big") + 4
    while major > 2 and p + 10 <= end and data[p] != 0:
        name = data[p : p + 4].decode("latin-1")
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + 10 : min(end, p + 10 + n)]
        if name[0] == "T" and body:
            kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
            value = body[1:].decode(kind, "replace").strip("\0")
            if name == "TXXX":
                name, _, value = value.partition("\0")
            tags[name] = value
        p += 10 + n
    return min(len(data), end + (10 if flags & 0x10 else 0))


def _tails(data: bytes, start: int) -> list[tuple[int, dict[str, str]]]:
    """Where audio may end, and the tags behind it: the data's end first, then before what looks like ID3v1 and APE tags."""
    end = len(data)
    found: list[tuple[int, dict[str, str]]] = [(end, {})]
    # an APE tag stands at the end or before an ID3v1 tag
    if end - 128 >= start and data[end - 128 : end - 125] == b"TAG":
        found.append((end - 128, {"id3v1_title": data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")}))
    end, tags = found[-1]
    if end - 32 >= start and data[end - 32 : end - 24] == b"APETAGEX":
        end -= int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        found.append((max(start, end), tags))
    return found


def _bitrate_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table in a first frame."""
    at = 4 + 2 * h.protected + _side_bytes(h)
    for p in (at, 4 + _side_bytes(h)):
        if frame[p : p + 4] in (b"Xing", b"Info"):
            flags, out, q = int.from_bytes(frame[p + 4 : p + 8], "big"), {"kind": frame[p : p + 4].decode()}, p + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], q = int.from_bytes(frame[q : q + 4], "big"), q + 4
            if flags & 4:
                out["toc"] = list(frame[q : q + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n, scale, width, per = (int.from_bytes(frame[p : p + 2], "big") for p in (54, 56, 58, 60))
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "per": per, "toc": toc}
    return {}


_crcs: dict[bytes, bool] = {}


def _sound(data: bytes, at: int, h: Header) -> bool | None:
    """Does the frame's checksum hold? None: it has none that can be verified."""
    bits = _protected_bits(h) if h.protected else -1
    if bits < 0:
        return None
    part = data[at + 2 : at + 6 + (bits + 7) // 8]
    if part not in _crcs:
        if len(_crcs) > 65_536:
            _crcs.clear()
        _crcs[part] = len(part) == 4 + (bits + 7) // 8 and crc16(part[:2] + part[4:], 16 + bits) == int.from_bytes(part[2:4], "big")
    return _crcs[part]


def parse(data: bytes) -> Stream:
    """Reads a whole stream. Bytes that are no audio give a stream without frames; a cut last frame isn't counted.

    What looks like a tag at the end is none if frames without a gap cover it from its beginning to its end.
    """
    tags: dict[str, str] = {}
    start = 0
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data):
        start = _id3v2(data, start, tags)
    ends = _tails(data, start)
    for k, (end, more) in enumerate(ends):
        s, run, last = _walk(data, start, end)
        if k + 1 == len(ends) or last == end and run <= ends[k + 1][0]:
            break
    s.tags = tags | more
    return s


def _walk(data: bytes, at: int, end: int) -> tuple[Stream, int, int]:
    """The frames between two offsets, and where the last run of frames without a gap begins and ends."""
    s, run, last = Stream(), end, -1
    held = None  # the header that the stream holds to
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and at + h.size <= end
        if good and (held is None or (h.version, h.layer, h.rate) != (held.version, held.layer, held.rate)):
            nxt = header(data[at + h.size : at + h.size + 4])
            good = at + h.size == end or nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)
        if not good:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            s.junk += step - at
            at, held = step, None
            continue
        sound = _sound(data, at, h)
        s.checked += sound is not None
        s.bad += sound is False
        table = _bitrate_table(data[at : at + h.size], h) if not s.offsets and not s.table else {}
        if table:
            s.table = table
        else:
            s.offsets.append(at)
            s.headers.append(h)
            s.samples += h.samples
            s.rate = s.rate or h.rate
        if at != last:
            run = at
        held = h
        at += h.size
        last = at
    s.junk += end - at
    return s, run, last


# ---- the writer

_SAMPLES, _SUBBANDS = 12, 32
FULL = _SAMPLES * _SUBBANDS


def _head(subbands: int) -> tuple[bytes, int]:
    """(header, checksum, allocation and scale factors of a frame with so many subbands, its size)."""
    need = 4 + 2 + 16 + subbands * 6 // 8 + subbands * _SAMPLES
    index = next(i for i in range(1, 15) if BITRATES[1, 1][i] >= 32 and 12_000 * BITRATES[1, 1][i] // 48_000 * 4 >= need)
    first, second = bytes([0xFF, 0xFE]), bytes([index << 4 | 1 << 2, 0xC0])
    nibbles = [7] * subbands + [0] * (_SUBBANDS - subbands)
    allocation = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    check = crc16(second + allocation).to_bytes(2, "big")
    # scale factor index 0 (factor 2) for each subband: six bits
    return first + second + check + allocation + bytes(subbands * 6 // 8), 12_000 * BITRATES[1, 1][index] // 48_000 * 4


#: Subbands come by fours, so that samples start at a whole byte.
_HEADS = {k: _head(k) for k in range(0, _SUBBANDS + 1, 4)}


def _subbands(n: int) -> int:
    return -(-n // (_SAMPLES * 4)) * 4


def encode(payload: bytes) -> bytes:
    """The payload as an MPEG layer I stream."""
    if b"\xff" in payload:
        raise ValueError("0xFF is no sample code of eight bits")
    parts = []
    head, size = _HEADS[_SUBBANDS]
    tail = bytes(size - len(head) - FULL)
    whole = len(payload) // FULL * FULL
    for i in range(0, whole, FULL):
        parts += (head, payload[i : i + FULL], tail)
    sizes = [size] * (whole // FULL)
    if whole < len(payload):
        rest = payload[whole:]
        head, size = _HEADS[_subbands(len(rest))]
        parts += (head, rest, bytes(size - len(head) - len(rest)))
        sizes.append(size)
    frames = len(sizes)
    note = f"payload_bytes\0{len(payload)}".encode()
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    tag = b"TXXX" + safe(len(note) + 1) + b"\0\0\x03" + note
    id3 = b"ID3\x04\0\0" + safe(len(tag)) + tag
    # the table's frame: no subband has bits, so all after the allocation is ancillary data; 16 entries at most, of four bytes
    per = max(1, -(-frames // 16))
    entries = [sum(sizes[i : i + per]) for i in range(0, frames, per)]
    head, _ = _HEADS[0]
    size = 128
    index = next(i for i in range(1, 15) if 12_000 * BITRATES[1, 1][i] // 48_000 * 4 == size)
    second = bytes([index << 4 | 1 << 2, 0xC0])
    head = head[:2] + second + crc16(second + head[6:]).to_bytes(2, "big") + head[6:]
    vbri = b"VBRI" + b"\0\x01\0\0\0\0" + (size + sum(sizes)).to_bytes(4, "big") + frames.to_bytes(4, "big")
    vbri += b"".join(x.to_bytes(2, "big") for x in (len(entries), 1, 4, per)) + b"".join(e.to_bytes(4, "big") for e in entries)
    first = (head.ljust(36, b"\0") + vbri).ljust(size, b"\0")
    return b"".join([id3, first, *parts])


def decode(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream that ``encode`` made: the eight-bit samples of all frames in order."""
    s = stream or parse(data)
    out = []
    for at, h in zip(s.offsets, s.headers, strict=True):
        if h.layer != 1 or h.mode != 3:
            raise ValueError("not a stream of eight-bit samples")
        allocation = data[at + 6 : at + 22]
        used = allocation.count(0x77) * 2
        if allocation != b"\x77" * (used // 2) + bytes(16 - used // 2):
            raise ValueError("not a stream of eight-bit samples")
        start = at + 22 + used * 6 // 8
        out.append(data[start : start + used * _SAMPLES])
    joined = b"".join(out)
    n = int(s.tags.get("payload_bytes", len(joined)))
    if n > len(joined) or s.bad:
        raise ValueError("frames are missing or damaged")
    return joined[:n]


def pad(body: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")


def valid(body: bytes) -> bytes:
    """The bytes if they are UTF-8, else with U+FFFD for what isn't: strings cast from bytes may hold anything."""
    try:
        body.decode()
    except UnicodeDecodeError:
        return body.decode("utf-8", "replace").encode()
    return body


# ---- columns


def _encode_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = [valid(t or b"") for t in part.column("text").to_pylist()]
        media = [encode(pad(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8 (null: empty), padded, as an MPEG stream."""
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


_PROBE = "frames int, samples long, sample_rate int, duration_us long, kbps_low int, kbps_high int, tagged_bytes long, table_kind string, table_frames long, crc_checked int, crc_bad int, junk_bytes long, seek array<int>"


def _probe(s: Stream) -> tuple:
    kbps = [h.kbps for h in s.headers]
    tagged = s.tags.get("payload_bytes", "")
    return (len(s.offsets), s.samples, s.rate, s.microseconds, min(kbps, default=0), max(kbps, default=0), int(tagged) if tagged.isdigit() else None, s.table.get("kind"), s.table.get("frames"), s.checked, s.bad, s.junk, s.offsets)


def _probe_batches(with_payload: bool):
    names = [x.split()[0] for x in _PROBE.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in _PROBE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows, extra = [], []
            for media in part.column("media").to_pylist():
                s = parse(media or b"")
                rows.append(_probe(s))
                if with_payload:
                    payload = decode(media, s)
                    extra.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_payload:
                arrays += [pa.array(c, k) for c, k in zip(zip(*extra, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            keep = [c for c in part.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], [*keep, *names, *(["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"] if with_payload else [])])

    return run


def probe_media(media: DataFrame) -> DataFrame:
    """Any table (doc_id, media) of MPEG audio bytes with what the reader finds, exact duration and seek offsets among it.

    Null and empty bytes give no frames. Damaged streams never fail: junk is skipped and counted, bad checksums are counted.
    """
    return media.select("doc_id", "media").mapInArrow(_probe_batches(False), f"doc_id long, {_PROBE}")


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op2's rows: every text stored as MPEG audio, read back and described. Equal texts give equal values; null counts as empty;
    repeated rows each give a row; bytes that are no UTF-8 are read as U+FFFD; other columns are ignored; an empty table gives an empty table."""
    stored = encode_texts(docs)
    kinds = "doc_id long, n_bytes long, " + _PROBE + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    read = stored.mapInArrow(_probe_batches(True), kinds)
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in ("frames", "samples", "sample_rate", "duration_us", "kbps_low", "kbps_high", "table_kind", "table_frames", "crc_checked", "crc_bad", "junk_bytes")),
        F.concat(F.lit("seek="), F.lower(F.hex(F.crc32(F.array_join("seek", ",").cast("binary"))))),
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_us", "frames", "seek")
