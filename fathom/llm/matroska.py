"""Media columns: Matroska files in binary columns, and packet tables parsed from them.

``parse`` reads variable-length EBML elements (also of unknown size), clusters, simple blocks and block groups with
all kinds of lacing, and cues, into packets with track, timestamp and byte range. ``mux`` writes 8-bit audio samples
into such a file. Both work on one file, inside tasks; files are rows, so Spark deals them out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, let_go, text_chunks, written

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME = 192
RATE = 8000
_LACE = 32
_CLUSTER_FRAMES = 512


# ---------------------------------------------------------------- writing


def _size(n: int) -> bytes:
    """n as an EBML size of the fewest bytes (all ones mean unknown, so they are left out)."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return ((1 << 7 * length) | n).to_bytes(length, "big")


def element(kind: int, body: bytes | int | float) -> bytes:
    if isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return b"".join((kind.to_bytes((kind.bit_length() + 7) // 8, "big"), _size(len(body)), body))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_TRACK = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """A file with one track of 8-bit samples; their number must be a multiple of FRAME. Frames of equal size share blocks, and each cluster has a cue. Timestamps are milliseconds."""
    if len(samples) % FRAME:
        raise ValueError(f"the number of samples must be a multiple of {FRAME}")
    ms = FRAME * 1000 // RATE
    n = len(samples) // FRAME
    parts = [element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, float(n * ms))), _TRACK]
    at, cues = sum(map(len, parts)), []
    for first in range(0, n, _CLUSTER_FRAMES):
        last = min(first + _CLUSTER_FRAMES, n)
        body = [element(TIMESTAMP, first * ms)]
        for f in range(first, last, _LACE):
            to = min(f + _LACE, last)
            # track 1; keyframe; fixed-size lacing if there are several frames
            head = struct.pack(">BhB", 0x81, (f - first) * ms, 0x84 if to - f > 1 else 0x80) + (bytes([to - f - 1]) if to - f > 1 else b"")
            body.append(element(SIMPLE_BLOCK, head + samples[f * FRAME : to * FRAME]))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, first * ms) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# ---------------------------------------------------------------- reading


@dataclass
class Media:
    """packets: (track, timestamp in ns, keyframe, start, size); start and size are the byte range in the file. cues: (time in ns, track, position of the cluster in the file). tracks: number to codec."""

    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    duration_ns: float = 0.0
    scale: int = 1_000_000


def vint(data, at: int, marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; marker=True keeps the length bit (ids), else all ones are None (unknown)."""
    first = data[at]
    length = 9 - first.bit_length()
    if not first or at + length > len(data):
        raise ValueError(f"no number at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            return None, at + length
    return value, at + length


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between at and end; one of unknown size reaches to the end, or for a cluster to the next top-level element."""
    while at < end:
        kind, at = vint(data, at, marker=True)
        size, at = vint(data, at)
        stop = min(at + size, end) if size is not None else _next_top(data, at, end) if kind == CLUSTER else end
        yield kind, at, stop
        at = stop


def _next_top(data, at: int, end: int) -> int:
    while at < end:
        kind, body = vint(data, at, marker=True)
        if kind in (CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML):
            return at
        size, body = vint(data, body)
        at = body + (size or 0)
    return end


def _number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def block(data, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags, and (start, size) of each frame of a block."""
    track, a = vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, a)
    a += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(a, b - a)]
    n, a = data[a] + 1, a + 1
    if lacing == 2:  # all of one size
        sizes = [(b - a) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == 1:  # runs of 255
                size = 0
                while data[a] == 255:
                    size, a = size + 255, a + 1
                size, a = size + data[a], a + 1
            else:  # EBML: the first size, then signed differences
                start = a
                raw, a = vint(data, a, marker=True)
                bits = 7 * (a - start)
                raw &= (1 << bits) - 1
                size = raw if not i else sizes[-1] + raw - ((1 << bits - 1) - 1)
            sizes.append(size)
        sizes.append(b - a - sum(sizes))
    frames = []
    for size in sizes:
        if size < 0 or a + size > b:
            raise ValueError("frames don't fit into their block")
        frames.append((a, size))
        a += size
    return track, relative, flags, frames


def _lasting(data, entry: dict[int, tuple[int, int]]) -> tuple[float, float]:
    """Of a track: nanoseconds of each frame, and of each of its bytes (of samples as they are); zero where the file doesn't tell."""
    if DEFAULT_DURATION in entry:
        return float(_number(data, *entry[DEFAULT_DURATION])), 0.0
    codec = bytes(data[slice(*entry[CODEC_ID])]) if CODEC_ID in entry else b""
    if AUDIO not in entry or not codec.startswith(b"A_PCM"):
        return 0.0, 0.0
    audio = {k: (a, b) for k, a, b in elements(data, *entry[AUDIO])}
    rate = _float(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 8000.0  # the format's default
    channels = _number(data, *audio[CHANNELS]) if CHANNELS in audio else 1
    bits = _number(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0
    return 0.0, 8e9 / (rate * channels * bits) if rate * channels * bits else 0.0


def seek(data: bytes, media: Media, time_ns: int, track: int = 1) -> int | None:
    """Where the cluster begins in which to look for a time: that of the last cue up to it. None without such a cue."""
    at = [(t, p) for t, number, p in media.cues if number == track and t <= time_ns]
    return max(at)[1] if at else None


def leads(data: bytes, cue: tuple[int, int, int], scale: int) -> bool:
    """Whether a cluster begins at the cue's position, and at its time or before."""
    try:
        kind, a, b = next(elements(data, cue[2], len(data)))
        stamp = next((_number(data, x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP), None)
    except (ValueError, IndexError, StopIteration):
        return False
    return kind == CLUSTER and stamp is not None and stamp * scale <= cue[0]


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a file; raises ValueError if it isn't one. Frames that share a block begin one after another where the file tells how long a frame lasts, else all at the block's time."""
    out, scale = Media(), 1_000_000
    durations: dict[int, tuple[float, float]] = {}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("not an EBML file")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        base, raw_cues = a, []
        for kind, a, b in elements(data, a, b):  # noqa: PLW2901
            if kind == INFO:
                for k, x, y in elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        scale = _number(data, x, y)
                    elif k == DURATION:
                        out.duration_ns = _float(data, x, y)
            elif kind == TRACKS:
                for k, x, y in elements(data, a, b):
                    if k == TRACK_ENTRY:
                        got = {kk: (xx, yy) for kk, xx, yy in elements(data, x, y)}
                        if TRACK_NUMBER in got:
                            number = _number(data, *got[TRACK_NUMBER])
                            out.tracks[number] = bytes(data[slice(*got[CODEC_ID])]).decode("ascii", "replace") if CODEC_ID in got else ""
                            durations[number] = _lasting(data, got)
            elif kind == CLUSTER:
                out.clusters += 1
                stamp = 0
                for k, x, y in elements(data, a, b):
                    if k == TIMESTAMP:
                        stamp = _number(data, x, y)
                        continue
                    if k == SIMPLE_BLOCK:
                        inner = [(x, y, None)]
                    elif k == BLOCK_GROUP:
                        got = {kk: (xx, yy) for kk, xx, yy in elements(data, x, y)}
                        inner = [(*got[BLOCK], _number(data, *got[BLOCK_DURATION]) if BLOCK_DURATION in got else None)] if BLOCK in got else []
                    else:
                        inner = []
                    for start, stop, lasts in inner:
                        track, relative, flags, frames = block(data, start, stop)
                        each, of_byte = (lasts * scale / len(frames), 0.0) if lasts is not None else durations.get(track, (0.0, 0.0))
                        t, key = float((stamp + relative) * scale), bool(flags & 0x80) or k == BLOCK_GROUP
                        for p, n in frames:
                            out.packets.append((track, int(t), key, p, n))
                            t += each or n * of_byte
            elif kind == CUES:
                for k, x, y in elements(data, a, b):
                    if k == CUE_POINT:
                        time, track, position = 0, 0, 0
                        for kk, xx, yy in elements(data, x, y):
                            if kk == CUE_TIME:
                                time = _number(data, xx, yy)
                            elif kk == CUE_TRACK_POSITIONS:
                                got = {c: (p, q) for c, p, q in elements(data, xx, yy)}
                                track = _number(data, *got[CUE_TRACK]) if CUE_TRACK in got else 0
                                position = _number(data, *got[CUE_CLUSTER_POSITION]) if CUE_CLUSTER_POSITION in got else 0
                        raw_cues.append((time, track, position))
        out.cues += [(t * scale, track, base + p) for t, track, p in raw_cues]
        out.duration_ns *= scale
        out.scale = scale
    return out


def feature(samples: bytes, packets: int, data: bytes, media: Media) -> str:
    """Packets, clusters, cues that lead to their cluster, milliseconds, then mean, deviation and mean step of the samples, in thousandths."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    steps = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    cues = sum(leads(data, c, media.scale) for c in media.cues)
    numbers = [packets, media.clusters, cues, int(media.duration_ns // 1_000_000), *(int(round(1000 * float(v))) for v in ((x.mean(), x.std(), steps) if len(x) else (0, 0, 0)))]
    return ":".join(map(str, numbers))


# ---------------------------------------------------------------- with Spark


def padded(text: bytes) -> bytes:
    """text and spaces up to a positive multiple of FRAME bytes."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for a, b, texts in text_chunks(batch):
            media = pa.array([mux(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as samples of a file. Null texts are empty and give one frame of spaces; every row gives a row, whatever its doc_id."""
    return id_and_text(docs).mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


PACKETS = {"packet": pa.int32(), "track": pa.int32(), "timestamp_ns": pa.int64(), "keyframe": pa.bool_(), "start": pa.int64(), "size": pa.int64()}


def packet_table(media: Media) -> pa.RecordBatch:
    """A row for each packet of a file, in the order of the file."""
    columns = list(zip(*((i, *p) for i, p in enumerate(media.packets)), strict=True)) or [()] * len(PACKETS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PACKETS.values(), strict=True)], list(PACKETS))


def payload(data: bytes, packets: pa.RecordBatch, track: int = 1) -> bytes:
    """The bytes of a track's packets, by their ranges in the packet table."""
    mine = packets.filter(pc.equal(packets.column("track"), track))
    return b"".join([data[p : p + n] for p, n in zip(mine.column("start").to_pylist(), mine.column("size").to_pylist(), strict=True)])


def _packet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data in enumerate(batch.column("media")):
            if data.is_valid and len(raw := data.as_py()):
                rows = packet_table(parse(raw))
                doc_id = pa.repeat(batch.column("doc_id")[i], rows.num_rows)
                yield pa.RecordBatch.from_arrays([doc_id, *rows.columns], ["doc_id", *PACKETS])


def packets(media: DataFrame) -> DataFrame:
    """A row for each packet of each file (columns doc_id, media). Null and empty files have none; a file that can't be read raises."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_packet_batches, "doc_id long, packet int, track int, timestamp_ns long, keyframe boolean, start long, size long")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for value in batch.column("media"):
            data = value.as_py()
            media = parse(data)
            found = packet_table(media)
            samples = payload(data, found)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, found.num_rows, data, media)))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])


def op6(docs: DataFrame) -> DataFrame:
    stored = written(docs.sparkSession, to_media(docs), "media")
    return stored.mapInArrow(_digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
