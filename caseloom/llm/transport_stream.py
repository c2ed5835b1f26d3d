"""Operator 3, media columns: MPEG transport streams in a binary column.

``mux`` stores bytes as a single-program transport stream: program association
and program map tables before each random-access point, and one elementary
packet with a timestamp per access unit. ``demux`` reads any such stream back:
it follows the tables, checks continuity counters, joins the elementary packets
and lists timestamps with random-access points.

Defined results: a null or empty text is one unit of padding. Bytes that are no
whole number of packets, or packets out of sync, are counted as faults and left
out; a stream without usable tables has no units. Rows stand alone, so repeated
rows repeat results. Work per row is linear in its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.common import encode, mapped, pick

UNIT = 576
PACKET = 188
PMT_PID = 0x1000
MEDIA_PID = 0x0100
STREAM_ID = 0xBD  # private stream 1
STREAM_TYPE = 0x06
TICKS = 3600  # 90 kHz clock, 25 units a second
GROUP = 25  # units from one random-access point to the next


@lru_cache(256)
def section_crc(data: bytes) -> int:
    """CRC-32 of the section format: polynomial 04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(
    PMT_PID,
    _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _clock(value: np.ndarray, mark: int) -> np.ndarray:
    """A 33-bit timestamp as five bytes with marker bits."""
    v = value.astype(np.uint64)
    parts = [mark | (v >> 30 & 7) << 1 | 1, v >> 22 & 255, (v >> 15 & 127) << 1 | 1, v >> 7 & 255, (v & 127) << 1 | 1]
    return np.stack(parts, -1).astype(np.uint8)


def mux(payload: bytes) -> bytes:
    """A transport stream holding the payload, whose length is a multiple of the unit."""
    n = len(payload) // UNIT
    units = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    index = np.arange(n)
    pts = index.astype(np.int64) * TICKS % (1 << 33)
    head = np.tile(np.frombuffer(bytes([0, 0, 1, STREAM_ID, 0, 0, 0x84, 0x80, 5]), np.uint8), (n, 1))
    head[:, 4], head[:, 5] = (UNIT + 8) >> 8, (UNIT + 8) & 255
    pes = np.concatenate([head, _clock(pts, 0x20), units], 1)
    packets = np.full((n, 4, PACKET), 255, np.uint8)
    packets[:, :, 0] = 0x47
    packets[:, :, 1] = MEDIA_PID >> 8
    packets[:, 0, 1] |= 0x40
    packets[:, :, 2] = MEDIA_PID & 255
    counter = (index[:, None] * 4 + np.arange(4)) % 16
    packets[:, :, 3] = counter | np.array([0x30, 0x10, 0x10, 0x30])
    # First packet: clock reference and the random-access mark. Last packet: stuffing.
    packets[:, 0, 4] = 7
    packets[:, 0, 5] = np.where(index % GROUP == 0, 0x50, 0x10)
    packets[:, 0, 6:10] = (pts >> 1).astype(">u4").view(np.uint8).reshape(n, 4)
    packets[:, 0, 10] = (pts & 1) << 7 | 0x7E
    packets[:, 0, 11] = 0
    left = pes.shape[1] - 176 - 2 * 184
    packets[:, 0, 12:] = pes[:, :176]
    packets[:, 1, 4:] = pes[:, 176:360]
    packets[:, 2, 4:] = pes[:, 360:544]
    packets[:, 3, 4] = 183 - left
    packets[:, 3, 5] = 0
    packets[:, 3, PACKET - left :] = pes[:, 544:]
    groups = np.arange((n + GROUP - 1) // GROUP)
    out = np.empty((4 * n + 2 * len(groups), PACKET), np.uint8)
    at = (2 * (index // GROUP + 1) + 4 * index)[:, None] + np.arange(4)
    out[at] = packets
    tables = groups * (4 * GROUP + 2)
    for shift, packet in ((0, PAT), (1, PMT)):
        out[tables + shift] = packet
        out[tables + shift, 3] = 0x10 | groups % 16
    return out.tobytes()


@dataclass
class Stream:
    """What was read: bytes by elementary pid, access units and faults."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: dict[int, bytes] = field(default_factory=dict)
    #: By pid: start in the payload, timestamp (-1: none) and random-access mark of each unit.
    units: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    out_of_sync: int = 0
    lost: int = 0
    bad_tables: int = 0


def _sections(rows: np.ndarray, starts: np.ndarray, stream: Stream) -> list[bytes]:
    """Distinct sections that begin in one pid's packets and whose checksum is right."""
    out = []
    for row, start in zip(rows, starts, strict=True):
        if row[1] & 0x40 and start < PACKET:
            at = int(start) + 1 + int(row[start])
            raw = row[at:].tobytes()
            size = 3 + ((raw[1] & 15) << 8 | raw[2]) if len(raw) > 3 else 0
            section = raw[:size]
            if section in out:
                continue
            if size < 12 or size > len(raw) or section_crc(section):
                stream.bad_tables += 1
            else:
                out.append(section)
    return out


def demux(data: bytes) -> Stream:
    """Read a transport stream."""
    whole = len(data) // PACKET
    stream = Stream(packets=whole, out_of_sync=int(len(data) % PACKET > 0))
    rows = np.frombuffer(data, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = (rows[:, 0] == 0x47) & (rows[:, 1] & 0x80 == 0)
    stream.out_of_sync += int((~good).sum())
    rows = rows[good]
    pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    has_field, has_bytes = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    starts = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    starts = np.where(has_bytes, np.minimum(starts, PACKET), PACKET)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    # Equal table packets but for the counter are one: read each kind once.
    mine = np.flatnonzero(pid == 0)
    for section in _sections(rows[mine], starts[mine], stream):
        if section[0] == 0:
            for k in range(8, len(section) - 4, 4):
                if number := int.from_bytes(section[k : k + 2], "big"):
                    stream.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
    for table_pid in sorted(set(stream.programs.values())):
        mine = np.flatnonzero(pid == table_pid)
        for section in _sections(rows[mine], starts[mine], stream):
            k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while section[0] == 2 and k + 5 <= len(section) - 4:
                stream.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    for own in sorted(stream.streams):
        mine = np.flatnonzero((pid == own) & has_bytes)
        counter = rows[mine, 3] & 15
        step = np.diff(counter) & 15
        repeat = np.concatenate([[False], step == 0]) if len(mine) else np.zeros(0, bool)
        stream.lost += int(((step > 1) & (flags[mine][1:] & 0x80 == 0)).sum())
        mine = mine[~repeat]
        _elementary(stream, own, rows[mine], starts[mine], flags[mine])
    return stream


def _elementary(stream: Stream, pid: int, rows: np.ndarray, starts: np.ndarray, flags: np.ndarray) -> None:
    """Join the payloads of one pid and take the headers of its elementary packets off."""
    data = rows[np.arange(PACKET) >= starts[:, None]]
    sizes = PACKET - starts
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = rows[:, 1] & 0x40 > 0
    at = begin[first].astype(np.int64)
    random_access = (flags[first] & 0x40) > 0
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    peek = padded[at[:, None] + np.arange(14)].astype(np.int64) if len(at) else np.zeros((0, 14), np.int64)
    usable = (peek[:, 0] == 0) & (peek[:, 1] == 0) & (peek[:, 2] == 1)
    stream.bad_tables += int((~usable).sum())
    at, peek, random_access = at[usable], peek[usable], random_access[usable]
    if not len(at):
        stream.payload[pid] = b""
        stream.units[pid] = (at, at, random_access)
        return
    header = 9 + peek[:, 8]
    p = peek[:, 9:14]
    pts = (p[:, 0] >> 1 & 7) << 30 | p[:, 1] << 22 | (p[:, 2] >> 1) << 15 | p[:, 3] << 7 | p[:, 4] >> 1
    pts = np.where(peek[:, 7] & 0x80 > 0, pts, -1)
    length = peek[:, 4] << 8 | peek[:, 5]
    following = np.append(at[1:], len(data))
    end = np.where(length > 0, np.minimum(at + 6 + length, following), following)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.minimum(at + header, end), 1)
    np.add.at(change, end, -1)
    keep = np.cumsum(change[:-1]) > 0
    stream.payload[pid] = data[keep].tobytes()
    kept = np.maximum(end - at - header, 0)
    stream.units[pid] = (np.concatenate([[0], np.cumsum(kept)])[:-1], pts, random_access)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and with padding to a positive multiple of the unit."""
    data = encode(text or "")
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def _mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A few rows at a time, so that long texts do not add up.
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            made = [padded(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream."""
    rows = pick(docs, doc_id="doc_id", text="text")
    return mapped(rows, _mux_rows, rows.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


FIELDS = (
    ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"),
)
ARROW = {"long": pa.int64(), "string": pa.string()}


def features(media: bytes) -> tuple:
    """What the query returns of a stored stream, all of it read back from the bytes."""
    stream = demux(media)
    pid = min(stream.streams, default=-1)
    payload = stream.payload.get(pid, b"")
    _, pts, marks = stream.units.get(pid, (np.zeros(0), np.zeros(0, int), np.zeros(0, bool)))
    points = pts[marks]
    text = (
        f"programs={len(stream.programs)} pid={pid} type={stream.streams.get(pid, -1)} packets={stream.packets} units={len(pts)} "
        f"first={pts[0] if len(pts) else -1} last={pts[-1] if len(pts) else -1} access={len(points)} last_access={points[-1] if len(points) else -1} "
        f"lost={stream.lost} unsynced={stream.out_of_sync} bad={stream.bad_tables}"
    )
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), text


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(m.as_py() or b"") for m in batch.column("media")]
        columns = list(zip(*found, strict=True)) if found else [[] for _ in FIELDS]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, FIELDS, strict=True))],
            ["doc_id", "n_bytes", *(name for name, _ in FIELDS)],
        )


def read(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, ...features) of stored streams (doc_id, n_bytes, media)."""
    rows = pick(media, doc_id="doc_id", n_bytes="n_bytes", media="media")
    schema = rows.select("doc_id", "n_bytes").schema
    for name, kind in FIELDS:
        schema = schema.add(name, kind)
    return mapped(rows, _read_rows, schema)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            stream = demux(row["media"] or b"")
            for pid, (offset, pts, marks) in stream.units.items():
                n = len(offset)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * n, batch.schema.field("doc_id").type), pa.array([pid] * n, pa.int32()), pa.array(offset, pa.int64()),
                     pa.array(pts, pa.int64()), pa.array(marks, pa.bool_())],
                    ["doc_id", "pid", "start", "pts", "random_access"],
                )


def access_units(media: DataFrame) -> DataFrame:
    """(doc_id, pid, start, pts, random_access): one row per elementary packet of stored streams."""
    rows = pick(media, doc_id="doc_id", media="media")
    schema = rows.select("doc_id").schema.add("pid", "integer").add("start", "long").add("pts", "long").add("random_access", "boolean")
    return mapped(rows, _unit_rows, schema)


def media_features(docs: DataFrame) -> DataFrame:
    return read(store(docs))
