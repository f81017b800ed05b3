"""Media columns: MPEG transport streams as values of a binary column.

``mux_column`` stores bytes losslessly as a transport stream: one program with one private
elementary stream, cut into packetised access units with presentation timestamps; every
``gop``-th unit is a random-access point.  ``demux_column`` reads any such column back: it
parses the program association and map tables (sections may go on over packets, and there may be several programs
and streams), checks continuity counters, reassembles the packets of the first declared elementary stream that has
any, and returns its timestamps and random-access points beside the list of all declared streams.

Defined results: a null stream gives null from ``demux_column``; an empty payload is a stream
with one empty unit; bytes that are no transport stream (wrong size or sync byte), or whose tables are missing or
declare no stream within their own length, give an empty payload with ``valid`` false.  Equal payloads give equal streams.  All work is per row, so there is no shuffle and a
lost executor repeats only its own rows; a task holds one Arrow batch at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import OWN, struct_of

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PRIVATE_TYPE = 0x1000, 0x0100, 0x06
UNIT_BYTES, GOP, PTS_STEP = 4096, 12, 3600


@lru_cache(maxsize=64)
def _mpeg_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, key: int, body: bytes) -> bytes:
    """One packet that holds one section of a program table."""
    rest = struct.pack(">HBBB", key, 0xC1, 0, 0) + body
    section = bytes([table_id]) + struct.pack(">H", 0xB000 | len(rest) + 4) + rest
    section += struct.pack(">I", _mpeg_crc(section))
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10)
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table(0, 0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _table(
    PMT_PID, 2, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)
)
_HEADS = {(start, control, n): struct.pack(">BHB", SYNC, start << 14 | DATA_PID, control << 4 | n) for start in (0, 1) for control in (1, 3) for n in range(16)}


def _pts(value: int) -> bytes:
    return bytes([0x21 | value >> 29 & 0x0E]) + struct.pack(">HH", (value >> 14 & 0xFFFE) | 1, (value << 1 & 0xFFFE) | 1)


def _pcr(value: int) -> bytes:
    return struct.pack(">IH", value >> 1 & 0xFFFFFFFF, (value & 1) << 15 | 0x7E00)


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, gop: int = GOP) -> bytes:
    """The payload as one transport stream."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit_bytes)):
        chunk, pts = payload[at : at + unit_bytes], k * PTS_STEP & (1 << 33) - 1
        pes = b"\0\0\1\xbd" + struct.pack(">H", (len(chunk) + 8) if len(chunk) + 8 < 1 << 16 else 0) + b"\x84\x80\x05" + _pts(pts) + chunk
        field = b"\x50" + _pcr(pts) if k % gop == 0 else b""
        done, start = 0, 1
        while done < len(pes):
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[done : done + room]
            if pad := room - len(part):
                if field:
                    field += b"\xff" * pad
                else:
                    field = b"" if pad == 1 else b"\0" + b"\xff" * (pad - 2)
            out.append(_HEADS[start, 3 if field or pad else 1, counter])
            if field or pad:
                out.append(bytes([len(field)]) + field)
            out.append(part)
            done, start, counter, field = done + len(part), 0, counter + 1 & 15, b""
    return b"".join(out)


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray, table: int) -> Iterator[tuple[int, bytes]]:
    """(number, body) of each valid section of one table; a section may go on over packets."""
    held: bytes | None = None

    def cut(held: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
        found = []
        while len(held) >= 3 and held[0] != 0xFF:
            end = 3 + ((held[1] << 8 | held[2]) & 0x0FFF)
            if end > len(held):
                break
            section, held = held[:end], held[end:]
            if end >= 12 and section[0] == table and _mpeg_crc(section) == 0:
                found.append((section[3] << 8 | section[4], section[8:-4]))
        return found, held

    for i in np.flatnonzero(pids == pid):
        raw = packets[i].tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if not raw[3] & 0x10 or at >= PACKET:
            continue
        part = raw[at:]
        if raw[1] & 0x40:
            if held is not None:
                yield from cut(held + part[1 : 1 + part[0]])[0]
            held = part[1 + part[0] :]
        elif held is not None:
            held += part
        if held is not None:
            found, held = cut(held)
            yield from found


def _streams(body: bytes) -> list[tuple[int, int]]:
    """(pid, type) of the elementary streams that a program map declares; what goes beyond the section is left out."""
    found = []
    at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF) if len(body) >= 4 else len(body)
    while at + 5 <= len(body):
        kind, pid, more = struct.unpack_from(">BHH", body, at)
        found.append((pid & 0x1FFF, kind))
        at += 5 + (more & 0x0FFF)
    return found


def programs_of(packets: np.ndarray, pids: np.ndarray) -> list[tuple[int, int, int]]:
    """(program, pid, type) of every elementary stream that the tables declare, in their order."""
    found: list[tuple[int, int, int]] = []
    seen: set[int] = set()
    for _, body in _sections(packets, 0, pids, 0):
        for i in range(0, len(body) - 3, 4):
            number, pid = struct.unpack_from(">HH", body, i)
            if number and number not in seen:
                seen.add(number)
                maps = next((m for n, m in _sections(packets, pid & 0x1FFF, pids, 2) if n == number), b"")
                found += [(number, *s) for s in _streams(maps)]
    return found


def demux(stream: bytes) -> tuple:
    """(valid, stream_pid, stream_type, packets, continuity_errors, pts, random_access, unit_offset, payload, streams)

    ``streams`` are all that the tables declare; the packets read are those of the first one of them that has any.
    """
    empty = (False, None, None, 0, 0, [], [], [], b"", [])
    if len(stream) < PACKET or len(stream) % PACKET:
        return empty
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if not (packets[:, 0] == SYNC).all():
        return empty
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    declared = programs_of(packets, pids)
    if not declared:
        return empty
    _, pid, kind = next((s for s in declared if (pids == s[1]).any()), declared[0])
    streams = [dict(zip(("program", "pid", "stream_type"), s, strict=True)) for s in declared]
    own = packets[pids == pid]
    control = own[:, 3] >> 4 & 3
    own, control = own[(control & 1) == 1], control[(control & 1) == 1]
    if not len(own):
        return (True, pid, kind, len(packets), 0, [], [], [], b"", streams)
    counters = (own[:, 3] & 15).astype(np.int16)
    has_field = control == 3
    flags = np.where(has_field & (own[:, 4] > 0), own[:, 5], 0)
    steps = np.diff(counters) & 15
    repeats = np.concatenate(([False], (steps == 0) & (own[1:, 4:] == own[:-1, 4:]).all(axis=1)))
    errors = int(((steps != 1) & ~repeats[1:] & (flags[1:] & 0x80 == 0)).sum())
    skip = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4).tolist()
    starts = (own[:, 1] & 0x40 != 0).tolist()
    access = (flags & 0x40 != 0).tolist()
    raw, again = own.tobytes(), repeats.tolist()
    units: list[list[bytes]] = []
    marks: list[bool] = []
    for i, (s, first) in enumerate(zip(skip, starts, strict=True)):
        if again[i]:
            continue
        if first:
            units.append([])
            marks.append(access[i])
        if units:
            units[-1].append(raw[i * PACKET + s : (i + 1) * PACKET])
    times, offsets, parts, at = [], [], [], 0
    for pieces in units:
        pes = b"".join(pieces)
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            errors += 1
            times.append(None)
            offsets.append(at)
            continue
        size, head = pes[4] << 8 | pes[5], 9 + pes[8]
        times.append((pes[9] >> 1 & 7) << 30 | (pes[10] << 8 | pes[11]) >> 1 << 15 | (pes[12] << 8 | pes[13]) >> 1 if pes[7] & 0x80 and len(pes) >= 14 else None)
        body = pes[head : 6 + size] if size else pes[head:]
        offsets.append(at)
        parts.append(body)
        at += len(body)
    return (True, pid, kind, len(packets), errors, times, marks, offsets, b"".join(parts), streams)


DEMUXED = pa.struct([
    ("valid", pa.bool_()), ("stream_pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()),
    ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_())), ("unit_offset", pa.list_(pa.int64())), ("payload", pa.binary()),
    ("streams", pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32())]))),
])
_DEMUXED_SQL = "valid boolean, stream_pid int, stream_type int, packets bigint, continuity_errors bigint, pts array<bigint>, random_access array<boolean>, unit_offset array<bigint>, payload binary, streams array<struct<program:int,pid:int,stream_type:int>>"


def mux_column(payload: Column) -> Column:
    """The transport stream of each value of a binary column (null: null)."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else mux(v) for v in values.to_pylist()], pa.binary())

    return arrow_udf(run, "binary", ArrowUDFType.SCALAR)(payload)


def demux_column(stream: Column) -> Column:
    """What each transport stream of a binary column holds (null: null)."""

    def run(values: pa.Array) -> pa.Array:
        rows = [demux(v if v is not None else b"") for v in values.to_pylist()]
        made = struct_of(rows, DEMUXED)
        return pa.StructArray.from_arrays(made.flatten(), fields=list(DEMUXED), mask=pa.array([v is None for v in values.to_pylist()], pa.bool_()))

    return arrow_udf(run, _DEMUXED_SQL, ArrowUDFType.SCALAR)(stream)


def padded(text: Column, unit: int = 64) -> Column:
    """UTF-8 bytes with zeros up to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(unit), F.ceil(F.octet_length(raw) / unit) * unit).cast("int")
    return F.rpad(raw, size, F.lit(b"\0"))


def add_media_columns(docs: DataFrame, text: str = "text", unit: int = 64) -> DataFrame:
    """``docs`` with ``ts`` (the stored stream) and ``media`` (what reading it back gives).

    ``media`` holds the payload, timestamps, unit offsets and random-access flags.  Columns of
    these names are replaced.  A null text is stored as an empty one.
    """
    return docs.withColumn("ts", mux_column(padded(F.col(text), unit))).withColumn("media", demux_column(F.col("ts")))


def media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: sizes, hashes and the feature string of its stored stream."""
    m = F.col("media")
    stored = add_media_columns(docs.select("doc_id", F.col(text).alias(OWN + "t")), OWN + "t")
    raps = F.size(F.filter(m["random_access"], lambda x: x))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), m["packets"]), F.concat(F.lit("units="), F.size(m["pts"])), F.concat(F.lit("random_access="), raps),
        F.concat(F.lit("pts="), F.element_at(m["pts"], 1), F.lit(".."), F.element_at(m["pts"], -1)),
        F.concat(F.lit("continuity_errors="), m["continuity_errors"]),
    )
    return stored.select(
        "doc_id",
        F.octet_length(F.coalesce(F.col(OWN + "t"), F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length(m["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(m["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(m["payload"], -64, 64)).alias("tail_crc32"),
        F.octet_length("ts").cast("long").alias("media_bytes"),
        F.sha2(F.col("ts"), 256).alias("media_sha256"),
        feature.alias("feature"),
        F.size(m["pts"]).cast("long").alias("n_units"),
        raps.cast("long").alias("n_random_access"),
        m["continuity_errors"].alias("continuity_errors"),
    )
