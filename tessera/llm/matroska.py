"""Matroska: variable-length EBML elements, clusters, lacing and cues, read into packet tables.

`parse` reads any Matroska bytes: element ids and sizes of 1 to 8 bytes, unknown sizes of segment and
clusters, Void and CRC-32 elements wherever they stand, SimpleBlocks and BlockGroups, and the three
lacings.  Its packets carry track, timestamp in nanoseconds, key flag and byte range within the file.
`mux` writes a payload as one track of unsigned 8-bit PCM, using all lacings, with cues.

Defined results: null or empty media have no packets and the error "empty"; media that end early or
break the format keep the packets before the fault and name it in `error`; repeated rows give repeated
results; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean, lots

# Fixed values of the format: element ids.
EBML, VOID, CRC32 = 0x1A45DFA3, 0xEC, 0xBF
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
#: Elements that end a segment's or a cluster's child of unknown size.
TOP = {SEGMENT, EBML}
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: What `mux` writes: samples a second, bytes of a frame, frames of a laced block and of a cluster.
RATE, FRAME, LACED, CLUSTERED = 8000, 1024, 8, 128
#: Payloads are padded to a positive multiple of this.
UNIT = 64
ROWS = 256


class Broken(ValueError):
    """The bytes don't follow the format."""


@dataclass
class Packet:
    track: int
    cluster: int
    block: int
    lace: int
    timestamp_ns: int
    keyframe: bool
    offset: int
    size: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, the cluster's byte offset
    clusters: list[int] = field(default_factory=list)  # byte offsets
    error: str = ""


def vint(data: bytes, at: int, *, marker: bool) -> tuple[int, int]:
    """A variable-length integer at a place, with its length's marker bit (ids) or without (sizes, -1: unknown); and the place behind it."""
    if at >= len(data):
        raise Broken("ends within an element's head")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or (marker and length > 4):
        raise Broken(f"no variable-length integer at {at}")
    if at + length > len(data):
        raise Broken("ends within an element's head")
    value = int.from_bytes(data[at : at + length], "big")
    if not marker:
        rest = (1 << 7 * length) - 1
        value &= rest
        if value == rest:
            value = -1
    return value, at + length


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def elements(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, its place, its content's start and end) of each child up to end; before an id in stop the parent of unknown size ends."""
    while at < end:
        place = at
        kind, at = vint(data, at, marker=True)
        if kind in stop:
            return
        size, at = vint(data, at, marker=False)
        if size >= 0 and at + size > end:
            raise Broken(f"element {kind:X} at {place} goes beyond its parent")
        if size < 0 and kind not in (SEGMENT, CLUSTER):
            raise Broken(f"element {kind:X} at {place} has no size")
        close = at + size if size >= 0 else end
        yield kind, place, at, -1 if size < 0 else close
        if size < 0:  # whoever reads it says where it ended
            at = unknown_end(data, at, end, TOP if kind == SEGMENT else TOP | LEVEL_1)
        else:
            at = close


def unknown_end(data: bytes, at: int, end: int, stop: set) -> int:
    while at < end:
        kind, behind = vint(data, at, marker=True)
        if kind in stop:
            return at
        size, behind = vint(data, behind, marker=False)
        at = behind + size if size >= 0 else unknown_end(data, behind, end, stop | LEVEL_1)
    return end


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The frames' sizes of a block whose lacing starts at a place, and where the frames start."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Broken("ends within a lacing")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise Broken("fixed lacing of unequal frames")
        return [(end - at) // n] * n, at
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Broken("ends within a lacing")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            before = at
            value, at = vint(data, at, marker=False)
            if k:  # a difference, stored with a bias
                value = sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(value)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Broken("lacing goes beyond its block")
    return [*sizes, last], at


def read_block(media: Media, data: bytes, at: int, end: int, time: int, block: int, key: bool | None) -> None:
    track, at = vint(data, at, marker=False)
    if at + 3 > end:
        raise Broken("ends within a block's head")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    start = (time + relative) * media.scale
    each = media.tracks.get(track, {}).get("default_ns", 0)
    for lace, size in enumerate(sizes):
        media.packets.append(Packet(track, len(media.clusters) - 1, block, lace, start + lace * each, bool(flags & 0x80) if key is None else key, at, size))
        at += size


def read_cluster(media: Media, data: bytes, place: int, at: int, end: int) -> None:
    media.clusters.append(place)
    time = block = 0
    for kind, _, a, b in elements(data, at, end):
        if kind == TIMESTAMP:
            time = unsigned(data, a, b)
        elif kind == SIMPLE_BLOCK:
            read_block(media, data, a, b, time, block, None)
            block += 1
        elif kind == BLOCK_GROUP:
            inner = [(k, x, y) for k, _, x, y in elements(data, a, b)]
            key = all(k != REFERENCE_BLOCK for k, _, _ in inner)
            for k, x, y in inner:
                if k == BLOCK:
                    read_block(media, data, x, y, time, block, key)
                    block += 1


def read_tracks(media: Media, data: bytes, at: int, end: int) -> None:
    for kind, _, a, b in elements(data, at, end):
        if kind != TRACK_ENTRY:
            continue
        track = {"number": 0, "type": 0, "codec": "", "default_ns": 0, "bit_depth": 0}
        for k, _, x, y in elements(data, a, b):
            name = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}.get(k)
            if name:
                track[name] = unsigned(data, x, y)
            elif k == CODEC_ID:
                track["codec"] = data[x:y].decode("ascii", "replace").rstrip("\0")
            elif k == AUDIO:
                track["bit_depth"] = next((unsigned(data, p, q) for m, _, p, q in elements(data, x, y) if m == BIT_DEPTH), 0)
        media.tracks[track["number"]] = track


def read_cues(media: Media, data: bytes, at: int, end: int, base: int) -> None:
    for kind, _, a, b in elements(data, at, end):
        if kind != CUE_POINT:
            continue
        time = 0
        for k, _, x, y in elements(data, a, b):
            if k == CUE_TIME:
                time = unsigned(data, x, y) * media.scale
            elif k == CUE_POSITIONS:
                found = {m: unsigned(data, p, q) for m, _, p, q in elements(data, x, y)}
                media.cues.append((time, found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))


def parse(data: bytes | None) -> Media:
    media = Media()
    if not data:
        media.error = "empty"
        return media
    try:
        seen = False
        for kind, _, a, b in elements(data, 0, len(data)):
            if kind != SEGMENT:
                continue
            seen = True
            close = unknown_end(data, a, len(data), TOP) if b < 0 else b
            for k, place, x, y in elements(data, a, close):
                if y < 0:
                    y = unknown_end(data, x, close, TOP | LEVEL_1)
                if k == INFO:
                    media.scale = next((unsigned(data, p, q) for m, _, p, q in elements(data, x, y) if m == TIMESTAMP_SCALE), media.scale)
                elif k == TRACKS:
                    read_tracks(media, data, x, y)
                elif k == CLUSTER:
                    read_cluster(media, data, place, x, y)
                elif k == CUES:
                    read_cues(media, data, x, y, a)
        if not seen:
            media.error = "no segment"
    except Broken as e:
        media.error = str(e)
    return media


def encoded_id(kind: int) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big")


def encoded_size(size: int, length: int = 0) -> bytes:
    """The shortest form whose value isn't all ones, or one of a given length."""
    length = length or next(n for n in range(1, 9) if size < (1 << 7 * n) - 1)
    return (size | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, content: bytes | int) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    return encoded_id(kind) + encoded_size(len(content)) + content


def laced(frames: list[bytes], kind: int) -> bytes:
    sizes = [len(f) for f in frames]
    head = b"" if kind == NO_LACING else bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:  # the last size is never written, not even a block's only one
        head += encoded_size(sizes[0])
        for one, two in zip(sizes, sizes[1:-1], strict=False):
            length = next(n for n in range(1, 9) if abs(two - one) < (1 << 7 * n - 1) - 1)
            head += encoded_size(two - one + (1 << 7 * length - 1) - 1, length)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """One track of unsigned 8-bit PCM whose samples are the payload's bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    frame_ms = FRAME * 1000 // RATE
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, frame_ms * 1_000_000) + audio))
    body, cues, kind = [info, tracks], b"", NO_LACING
    at = len(info) + len(tracks)
    for first in range(0, len(frames), CLUSTERED):
        group, blocks, i = frames[first : first + CLUSTERED], [element(TIMESTAMP, first * frame_ms)], 0
        while i < len(group):
            part = group[i : i + (1 if kind == NO_LACING else LACED)]
            how = EBML_LACING if kind == FIXED and len({len(f) for f in part}) > 1 else kind
            head = encoded_size(1) + (i * frame_ms).to_bytes(2, "big", signed=True) + bytes([0x80 | how << 1])
            blocks.append(element(SIMPLE_BLOCK, head + laced(part, how)))
            i += len(part)
            kind = (kind + 1) % 4
        cluster = element(CLUSTER, b"".join(blocks))
        cues += element(CUE_POINT, element(CUE_TIME, first * frame_ms) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at)))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, cues))
    head = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(body))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes (null: none), padded with bytes 0, as a Matroska file."""
    kept = df.select(id_col, F.col(text_col).cast("binary").alias("__bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1, ROWS):
            data = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], [id_col, "n_bytes", "media"])

    return kept.mapInArrow(lean(run), T.StructType([kept.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


PACKETS = "track int, cluster int, block int, lace int, timestamp_ns long, keyframe boolean, byte_offset long, byte_size long"


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each media value: id, track, cluster, block, lace, timestamp_ns, keyframe, byte_offset, byte_size."""
    kept = df.select(id_col, media_col)
    schema = T.StructType([kept.schema[0], *T._parse_datatype_string(PACKETS).fields])
    types = [pa.int32()] * 4 + [pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1, ROWS):
            found = [parse(x).packets for x in batch.column(1).to_pylist()]
            rows = [p for ps in found for p in ps]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(ps) for ps in found])))
            names = ("track", "cluster", "block", "lace", "timestamp_ns", "keyframe", "offset", "size")
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([getattr(p, n) for p in rows], t) for n, t in zip(names, types, strict=True))], schema.names)

    return kept.mapInArrow(lean(run), schema)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Every input row's id and n_bytes with the payload that its packets' byte ranges hold: size, digests and a feature of packets and samples."""
    kept = df.select(id_col, "n_bytes", media_col)
    schema = T.StructType([*kept.schema.fields[:2], *T._parse_datatype_string(READ).fields])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def of(data: bytes | None) -> tuple:
        media = parse(data)
        payload = b"".join([data[p.offset : p.offset + p.size] for p in media.packets])
        samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        last = max((p.timestamp_ns for p in media.packets), default=0)
        energy = int((samples * samples).sum())
        crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
        feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ns={last};energy={energy};crossings={crossings}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature, media.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 2, ROWS):
            rows = [of(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], schema.names)

    return kept.mapInArrow(lean(run), schema)
