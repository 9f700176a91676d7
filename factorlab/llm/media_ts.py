"""MPEG transport streams as a column: bytes are stored as one private elementary stream and read back through the tables.

A stream holds PAT and PMT packets before each random-access point, and the payload in PES packets of UNIT bytes with a
presentation time stamp each. The reader takes nothing for granted: it finds the elementary stream by way of PAT and PMT, checks
their CRCs and the continuity counters, reassembles the PES packets and keeps time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PRIVATE_STREAM, PRIVATE_DATA_TYPE = 0x0000, 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7

#: Our own layout: where tables and data lie, bytes in a PES packet, ticks of 90 kHz between them, PES packets between random-access points.
PMT_PID, DATA_PID, UNIT, TICKS, GROUP = 0x1000, 0x0100, 4096, 3003, 8


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), dtype=np.uint8)


PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def _pes(data: np.ndarray, pts: int) -> np.ndarray:
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts)
    return np.concatenate([np.frombuffer(head, dtype=np.uint8), data])


def _packets(pes: np.ndarray, counter: int, pcr: int | None) -> np.ndarray:
    """The transport packets of one PES packet; with pcr the first is a random-access point."""
    field = b"" if pcr is None else b"\x07\x50" + (pcr << 15 | 0x7E00).to_bytes(6, "big")
    n = max(1, -(-(len(pes) + len(field)) // BODY))
    out = np.empty((n, PACKET), dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    body = out[:, 4:].reshape(-1) if n == 1 else None
    spare = n * BODY - len(pes) - len(field)
    if n == 1:
        if field or spare:
            grown = bytearray(field)
            if not grown:
                grown = bytearray(b"\x00") if spare == 1 else bytearray(b"\x00\x00")
                spare -= len(grown)
            grown += b"\xff" * spare
            grown[0] = len(grown) - 1
            out[0, 3] |= 0x20
            out[0, 4 : 4 + len(grown)] = np.frombuffer(bytes(grown), dtype=np.uint8)
            out[0, 4 + len(grown) :] = pes
        else:
            body[:] = pes
            out[0, 4:] = body
        return out
    first = BODY - len(field)
    if field:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(field)] = np.frombuffer(field, dtype=np.uint8)
    out[0, 4 + len(field) :] = pes[:first]
    whole = n - 2 if spare else n - 1
    if whole:
        out[1 : 1 + whole, 4:] = pes[first : first + whole * BODY].reshape(whole, BODY)
    if spare:  # the last packet is filled up by its adaptation field
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        if spare > 1:
            out[-1, 5] = 0
            out[-1, 6 : 4 + spare] = 0xFF
        out[-1, 4 + spare :] = pes[first + whole * BODY :]
    return out


def mux(payload: bytes) -> bytes:
    data, parts, counter, tables = np.frombuffer(payload, dtype=np.uint8), [], 0, 0
    for k, at in enumerate(range(0, max(len(data), 1), UNIT)):
        start = k % GROUP == 0
        pts = (90000 + k * TICKS) % (1 << 33)
        if start:
            for table in (PAT, PMT):
                table = table.copy()
                table[3] |= tables & 15
                parts.append(table)
            tables += 1
        packets = _packets(_pes(data[at : at + UNIT], pts), counter, (pts - 9000) % (1 << 33) if start else None)
        counter += len(packets)
        parts.append(packets.reshape(-1))
    return np.concatenate(parts).tobytes()


class Read(NamedTuple):
    payload: bytes
    packets: int
    pid: int
    continuity_errors: int
    pts: list[int]
    random_access: list[int]  # numbers of the PES packets that can be entered


def _tables(rows: np.ndarray, table: int, known: dict[bytes, bytes]) -> bytes:
    """The body of the section that every given packet carries."""
    for raw in {x.tobytes() for x in rows[:, 4:]}:
        if raw not in known:
            at = 1 + raw[0]
            size = (raw[at + 1] & 15) << 8 | raw[at + 2]
            section = raw[at : at + 3 + size]
            if section[0] != table or crc32_mpeg(section):
                raise ValueError("a program table is damaged")
            known[raw] = section[8:-4]
    return known[rows[0, 4:].tobytes()]


def demux(media: bytes, known: dict[bytes, bytes] | None = None) -> Read:
    known = {} if known is None else known
    if not media or len(media) % PACKET:
        raise ValueError("a transport stream is a whole number of packets")
    rows = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("a packet without its sync byte")
    pids = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    try:
        programs = _tables(rows[pids == PAT_PID], 0, known)
        pmt_pid = next((programs[i + 2] & 31) << 8 | programs[i + 3] for i in range(0, len(programs), 4) if programs[i] | programs[i + 1])
        streams = _tables(rows[pids == pmt_pid], 2, known)
        at = 4 + ((streams[2] & 15) << 8 | streams[3])
        while streams[at] != PRIVATE_DATA_TYPE:
            at += 5 + ((streams[at + 3] & 15) << 8 | streams[at + 4])
        pid = (streams[at + 1] & 31) << 8 | streams[at + 2]
    except (IndexError, StopIteration):
        raise ValueError("no private stream in the program tables") from None
    own = rows[pids == pid]
    if not len(own) or not own[0, 1] & 0x40:
        raise ValueError("the stream does not begin with a PES packet")
    counters = own[:, 3] & 15
    errors = int(((counters[1:] - counters[:-1]) % 16 != 1).sum())
    has_field, starts = (own[:, 3] & 0x20) > 0, (own[:, 1] & 0x40) > 0
    skip = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    entry = has_field & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    keep = np.arange(PACKET) >= skip[:, None]
    stream, sizes = own[keep], PACKET - skip
    begins = (np.cumsum(sizes) - sizes)[starts]
    ends = np.append(begins[1:], len(stream))
    wanted, pts = np.ones(len(stream), dtype=bool), []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        head = stream[a : a + 14].tolist()
        if head[:3] != [0, 0, 1] or (head[4] << 8 | head[5]) != b - a - 6:
            raise ValueError("a PES packet is damaged")
        pts.append((head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1)
        wanted[a : a + 9 + head[8]] = False
    return Read(stream[wanted].tobytes(), len(rows), pid, errors, pts, np.flatnonzero(entry[starts]).tolist())


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("continuity_errors", T.LongType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.LongType())),
    ]
)
_FOUND_ARROW = pa.schema(
    [(f, pa.int64()) for f in ("doc_id", "n_bytes", "payload_bytes")]
    + [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("continuity_errors", pa.int64()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))]
)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column `media`: the text in UTF-8, padded with zeros to a positive multiple of 64, as a transport stream.

    Null and empty texts give 64 zeros; other columns are not read; an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            texts = [padded(x) for x in batch.column("text").to_pylist()]
            media = pa.array([mux(x) for _, x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(each, MEDIA)


def load(stored: DataFrame) -> DataFrame:
    """Reads the column `media` back: digests of payload and stream, time stamps, random-access points and features.

    A null or damaged stream is an error; an empty table gives no rows. `feature` has the counts of packets, PES packets, random-access points and continuity errors, the duration in ticks, and the
    mean and the spread of the samples. Equal payloads have equal features.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in sliced(batches, "media", 4 << 20):
            out: list[tuple] = []
            for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                x = demux(media, known)
                samples = np.frombuffer(x.payload, dtype=np.uint8)
                feature = f"packets={x.packets} pes={len(x.pts)} entries={len(x.random_access)} errors={x.continuity_errors} ticks={x.pts[-1] - x.pts[0]} mean={samples.mean():.6f} std={samples.std():.6f}"
                out.append((doc_id, n, len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, x.continuity_errors, x.pts, x.random_access))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND_ARROW.types, strict=True)], schema=_FOUND_ARROW)

    return stored.mapInArrow(each, FOUND)
