"""Matroska media columns: writing, and parsing into packet tables.

The parser walks variable-length EBML elements, clusters, all four kinds of
lacing and cues, and gives each packet its track, timestamp and byte range; the
payload is read back through those ranges alone.
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

from docloom.llm.arrow import add_columns, blocks
from docloom.llm.common import text_of

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, NUMBER, CODEC, RATE, DEFAULT_DURATION = 0x2AD7B1, 0xD7, 0x86, 0xB5, 0x23E383
MASTERS = {SEGMENT, CLUSTER, GROUP, TRACKS, TRACK, AUDIO, INFO, CUES, CUE, CUE_AT}
UNKNOWN = -1

FRAME, SAMPLE_RATE, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 576, 8000, 8, 8
FRAME_MS = 1000 * FRAME // SAMPLE_RATE


class MediaError(ValueError):
    """The bytes are not a Matroska file that the parser can read."""


def vint(value: int, width: int = 0) -> bytes:
    """A size as EBML has it: a length marker, then the value (not all ones)."""
    width = width or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and block data of frames laced as ``kind``: none, xiph, fixed or ebml."""
    if kind == "none":
        if len(frames) != 1:
            raise MediaError("one frame a block without lacing")
        return 0, frames[0]
    head, body, sizes = bytes([len(frames) - 1]), b"".join(frames), [len(f) for f in frames]
    if kind == "fixed":
        if len(set(sizes)) != 1:
            raise MediaError("frames of one size for fixed lacing")
        return 4, head + body
    if kind == "xiph":
        return 2, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + body
    out = vint(sizes[0]) if len(sizes) > 1 else b""
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(n for n in range(1, 9) if abs(b - a) < (1 << (7 * n - 1)) - 1)
        out += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return 6, head + out + body


def write(payload: bytes, frame: int = FRAME, lacing: str = "fixed") -> bytes:
    """One track of 8-bit PCM samples in clusters of laced blocks, with cues."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"docloom") + element(0x5741, b"docloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + uint(0x9F, 1) + uint(0x6264, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    per_block = 1 if lacing == "none" else FRAMES_A_BLOCK
    for c in range(0, len(payload), frame * per_block * BLOCKS_A_CLUSTER):
        part, time = [], c // frame * FRAME_MS
        for b in range(c, min(len(payload), c + frame * per_block * BLOCKS_A_CLUSTER), frame * per_block):
            frames = [payload[i : i + frame] for i in range(b, min(len(payload), b + frame * per_block), frame)]
            flags, data = lace(frames, lacing)
            part.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b // frame * FRAME_MS - time, 0x80 | flags) + data))
        cluster = element(CLUSTER, uint(TIMESTAMP, time) + b"".join(part))
        cues.append(element(CUE, uint(CUE_TIME, time) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length() if at < len(data) and data[at] else 9
    if width > 4 or at + width > len(data):
        raise MediaError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """Value, width and the next byte; all ones are the unknown size."""
    width = 9 - data[at].bit_length() if at < len(data) and data[at] else 9
    if width > 8 or at + width > len(data):
        raise MediaError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (UNKNOWN if value == (1 << (7 * width)) - 1 else value), width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its data) for each child."""
    while at < end:
        eid, size_at = read_id(data, at)
        size, _, begin = read_vint(data, size_at)
        if size == UNKNOWN:
            stop = begin if eid != SEGMENT else end
            while eid != SEGMENT and stop < end:  # a cluster of unknown size ends where a top-level element begins
                child, child_at = read_id(data, stop)
                if child in (CLUSTER, CUES, INFO, TRACKS, EBML, SEGMENT):
                    break
                n, _, child_begin = read_vint(data, child_at)
                stop = child_begin + n
        else:
            stop = begin + size
        if stop > end:
            raise MediaError(f"element {eid:x} at byte {at} passes its parent's end")
        yield eid, at, begin, stop
        at = stop


@dataclass
class Packets:
    """Columns of a packet table; cues as (time in ns, track, byte of the cluster)."""

    track: list[int]
    time_ns: list[int]
    start: list[int]
    size: list[int]
    keyframe: list[bool]
    cluster: list[int]
    cues: list[tuple[int, int, int]]
    codec: dict[int, str]


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block's data."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise MediaError("a laced block without a count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise MediaError("fixed lacing does not divide the block")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise MediaError("lace sizes pass the block's end")
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, width, at = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - (1 << (7 * width - 1)) + 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise MediaError("laced frames pass the block's end")
    return [*out, (at, end - at)]


def parse(data: bytes) -> Packets:
    """The packets of a file in order."""
    out = Packets([], [], [], [], [], [], [], {})
    scale, step = 1_000_000, {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")

    def block(begin: int, end: int, base: int, cluster: int, key: bool | None) -> None:
        track, _, at = read_vint(data, begin)
        if at + 3 > end:
            raise MediaError("a block without a head")
        offset, flags = struct.unpack_from(">hB", data, at)
        time = (base + offset) * scale
        for k, (start, size) in enumerate(_laced(data, at + 3, end, flags >> 1 & 3)):
            out.track.append(track)
            out.time_ns.append(time + k * step.get(track, 0))
            out.start.append(start)
            out.size.append(size)
            out.keyframe.append(bool(flags & 0x80) if key is None else key)
            out.cluster.append(cluster)

    def segment(begin: int, end: int) -> None:
        nonlocal scale
        for eid, start, a, b in elements(data, begin, end):
            if eid == INFO:
                for x, _, p, q in elements(data, a, b):
                    scale = number(p, q) if x == SCALE else scale
            elif eid == TRACKS:
                for x, _, p, q in elements(data, a, b):
                    fields = {y: (r, s) for y, _, r, s in elements(data, p, q)} if x == TRACK else {}
                    if NUMBER in fields:
                        n = number(*fields[NUMBER])
                        out.codec[n] = data[slice(*fields.get(CODEC, (0, 0)))].decode("ascii", "replace")
                        step[n] = number(*fields[DEFAULT_DURATION]) if DEFAULT_DURATION in fields else 0
            elif eid == CLUSTER:
                base = 0
                for x, _, p, q in elements(data, a, b):
                    if x == TIMESTAMP:
                        base = number(p, q)
                    elif x == SIMPLE_BLOCK:
                        block(p, q, base, start - begin, None)
                    elif x == GROUP:
                        inner = [(y, r, s) for y, _, r, s in elements(data, p, q)]
                        for y, r, s in inner:
                            if y == BLOCK:
                                block(r, s, base, start - begin, all(z[0] != REFERENCE for z in inner))
            elif eid == CUES:
                for x, _, p, q in elements(data, a, b):
                    time, at = 0, []
                    for y, _, r, s in elements(data, p, q) if x == CUE else ():
                        if y == CUE_TIME:
                            time = number(r, s) * scale
                        elif y == CUE_AT:
                            f = {z: number(t, u) for z, _, t, u in elements(data, r, s)}
                            at.append((f.get(CUE_TRACK, 0), f.get(CUE_CLUSTER, 0)))
                    out.cues += [(time, track, pos) for track, pos in at]

    found = False
    for eid, _, a, b in elements(data, 0, len(data)):
        if eid == SEGMENT:
            found = True
            segment(a, b)
    if not found:
        raise MediaError("no segment")
    return out


def pad(text: bytes, frame: int = FRAME) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of ``frame``."""
    return text + b"\xff" * (max(frame, -(-len(text) // frame) * frame) - len(text))


def features(payload: bytes, packets: Packets) -> str:
    """Frame, cue and cluster counts, duration, and mean, deviation, peak and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    sync = len(packets.cues) == len(set(packets.cluster)) and all(c in packets.cluster for _, _, c in packets.cues)
    end = max(packets.time_ns, default=0) // 1_000_000 + FRAME_MS
    return f"frames={len(packets.start)};clusters={len(set(packets.cluster))};cues={len(packets.cues)};cued={int(sync)};ms={end};mean={s / n if n else 0:.4f};rms={(q / n if n else 0) ** 0.5:.4f};peak={int(abs(x).max()) if n else 0};crossings={cross}"


def to_matroska(df: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None, lacing: str = "fixed") -> DataFrame:
    """``df`` (or its columns ``keep``) with each whole text stored as a Matroska file.

    The payload is the text's UTF-8 bytes, padded with 255 to a positive
    multiple of the frame; null is the empty text, which takes one frame. Equal
    texts give equal files. An empty table gives an empty table; a column named
    as ``media`` is replaced.
    """

    def make(values, _):
        return [pa.array([write(pad(t), lacing=lacing) for t in values.cast(pa.binary()).to_pylist()], pa.binary())]

    return add_columns(df.withColumn(text, text_of(text)), text, f"`{media}` binary", make, keep)


def packet_table(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """A row a packet: (id_col, packet, track, codec, time_ms, cluster, offset, size, keyframe, error).

    A null file has no packets; one that can't be read has a row with the reason
    in ``error`` and null elsewhere.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, packet int, track int, codec string, time_ms double, cluster long, offset long, size long, keyframe boolean, error string"

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1):
                ids, cols = [], [[] for _ in range(9)]
                for key, data in zip(part.column(0), part.column(1), strict=True):
                    if not data.is_valid:
                        continue
                    try:
                        p = parse(data.as_py())
                    except MediaError as e:
                        rows = [(None, None, None, None, None, None, None, None, str(e))]
                    else:
                        rows = [(k, t, p.codec.get(t), ns / 1e6, c, s, n, f, None) for k, (t, ns, c, s, n, f) in enumerate(zip(p.track, p.time_ns, p.cluster, p.start, p.size, p.keyframe, strict=True))]
                    ids += [key.as_py()] * len(rows)
                    for col, values in zip(cols, zip(*rows, strict=True), strict=False):
                        col += values
                kinds = [part.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *cols], kinds, strict=True)], names=[id_col, "packet", "track", "codec", "time_ms", "cluster", "offset", "size", "keyframe", "error"])

    return df.select(id_col, media).mapInArrow(run, schema)


def read_back(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with payload_bytes, payload_sha256, tail_crc32 and feature of the stored packets.

    All four are null where the file is null or can't be read.
    """

    def make(values, _):
        rows = []
        for data in values.to_pylist():
            try:
                p = parse(data) if data is not None else None
            except MediaError:
                p = None
            if p is None:
                rows.append((None,) * 4)
                continue
            payload = b"".join([data[s : s + n] for s, n in zip(p.start, p.size, strict=True)])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), features(payload, p)))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]

    return add_columns(df, media, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", make, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document stored as Matroska and read back: sizes, digests and features."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = to_matroska(docs.select("doc_id", "text", F.octet_length(text_of()).cast("long").alias("n_bytes")), keep=["doc_id", "n_bytes"])
    return read_back(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
