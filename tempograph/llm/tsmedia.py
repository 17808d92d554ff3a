"""Operator 10: texts as MPEG transport streams.

``mux`` stores each text, padded with zero bytes to a positive multiple of 64,
as a transport stream (ISO/IEC 13818-1): a program association table and a
program map table, then one private-data elementary stream. An access unit is
up to ``UNIT`` bytes in a PES packet with a time stamp; each ``EVERY``-th one
is a random-access point and carries a clock reference. ``demux`` parses the
tables wherever they lie, checks continuity counters, reassembles the PES
packets and returns the payload with the time stamps and random-access points
as columns. ``op10`` writes the streams as a table in the shared folder and
reads that.

Null and empty texts are 64 zero bytes. Equal texts give equal bytes; repeated
rows and null ids give a row each; an empty table gives no rows; other columns
are not looked at. A text of any length that a row can hold works, and must fit
into memory three times. Streams are a binary column; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempograph.llm.common import doc_columns, slices, stored, utf8

#: Padding, bytes of an access unit, access units from one random-access point to the next, and 90 kHz ticks of a unit.
BLOCK, UNIT, EVERY, TICKS = 64, 32_768, 8, 3_600
#: Bytes of an adaptation field with a clock reference, its length byte included.
CLOCK = 8
#: Packets, sync byte, packet ids and stream types of ISO/IEC 13818-1 (fixed values; the two PIDs are free to choose).
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE_TYPE, PRIVATE_ID = 188, 0x47, 0, 0x100, 0x101, 1, 0x06, 0xBD


def crc32_mpeg(data: bytes) -> int:
    """The checksum of tables: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(t: int) -> bytes:
    """A presentation time stamp with its marker bits."""
    return bytes([0x21 | (t >> 29 & 0x0E), t >> 22 & 0xFF, 0x01 | (t >> 14 & 0xFE), t >> 7 & 0xFF, 0x01 | (t << 1 & 0xFE)])


def mux_bytes(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS & (1 << 33) - 1) + data
        random_access = k % EVERY == 0
        first = 184 - CLOCK * random_access
        n = 1 + max(0, -(-(len(pes) - first) // 184))
        stuffing = first + 184 * (n - 1) - len(pes)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        field = np.zeros(n, np.int64)  # bytes of the adaptation field, its length byte included
        field[0] = CLOCK * random_access
        field[-1] += stuffing
        for j in {0, n - 1}:
            if field[j]:
                packets[j, 3] |= 0x20
                packets[j, 4] = field[j] - 1
                if field[j] > 1:
                    packets[j, 5] = 0
                if random_access and j == 0:  # random access, and the clock as it is at the time stamp
                    packets[j, 5] = 0x50
                    packets[j, 6:12] = np.frombuffer(((k * TICKS & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        body = np.frombuffer(pes, np.uint8)
        if n == 1:
            packets[0, 4 + field[0] :] = body
        else:
            packets[0, 4 + field[0] :] = body[: 184 - field[0]]
            full = body[184 - field[0] : len(body) - (184 - field[-1])]
            packets[1:-1, 4:] = full.reshape(n - 2, 184)
            packets[-1, 4 + field[-1] :] = body[len(body) - (184 - field[-1]) :]
        out.append(packets.tobytes())
    return b"".join(out)


class Stream(NamedTuple):
    """What a transport stream holds."""

    payload: bytes
    program: int
    pid: int
    stream_type: int
    packets: int
    stamps: list[int]
    random_access: list[int]  # numbers of the access units
    gaps: int  # breaks of a continuity counter
    whole: bool  # nothing shows that a part is lost


def _section_of(packets: np.ndarray, pids: np.ndarray, pid: int) -> bytes:
    """The first section that begins in a packet with this id, over as many packets as it takes."""
    own = packets[pids == pid]
    begins = np.flatnonzero(own[:, 1] & 0x40)
    raw, wanted = b"", None
    for p in own[begins[0] :] if len(begins) else ():
        if not p[3] & 0x10:
            continue
        raw += p[4 + (1 + p[4] if p[3] & 0x20 else 0) :].tobytes()
        if wanted is None:
            raw = raw[1 + raw[0] :]
            wanted = 3 + (int.from_bytes(raw[1:3], "big") & 0x0FFF)
        if len(raw) >= wanted:
            return raw[:wanted]
    raise ValueError(f"no whole table in packets with the id {pid:#x}")


_checked: dict[bytes, bytes] = {}


def _body(section: bytes, table: int) -> bytes:
    """What a section of a table says, its checksum verified; sections mostly repeat."""
    if section not in _checked:
        if section[0] != table or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
            raise ValueError("a table is damaged")
        if len(_checked) > 1000:
            _checked.clear()
        _checked[section] = section[8:-4]
    return _checked[section]


def _program(packets: np.ndarray, pids: np.ndarray) -> tuple[int, int, int]:
    """The first program that has a stream of private data: its number, the stream's packet id and type."""
    pat = _body(_section_of(packets, pids, PAT_PID), 0)
    for at in range(0, len(pat), 4):
        program, pmt_pid = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
        if program == 0:  # the network's table
            continue
        pmt = _body(_section_of(packets, pids, pmt_pid), 2)
        k = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
        while k < len(pmt):
            if pmt[k] == PRIVATE_TYPE:
                return program, int.from_bytes(pmt[k + 1 : k + 3], "big") & 0x1FFF, pmt[k]
            k += 5 + (int.from_bytes(pmt[k + 3 : k + 5], "big") & 0x0FFF)
    raise ValueError("no program has a stream of private data")


def demux_bytes(data: bytes) -> Stream:
    """Parses a transport stream; raises ValueError if packets or tables are damaged, or no access unit begins.

    A packet that repeats the one before it, as the standard allows, is read
    once. A stream is whole if counters have no gap, it begins with an access
    unit, and each unit is as long as it says.
    """
    if len(data) % PACKET or not data:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't begin with the sync byte")
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    program, pid, kind = _program(packets, pids)
    own = packets[(pids == pid) & (packets[:, 3] & 0x10 > 0)]  # packets without payload don't count
    repeats = np.zeros(len(own), np.bool_)
    repeats[1:] = (own[1:] == own[:-1]).all(1)
    own = own[~repeats]
    counters = own[:, 3] & 15
    gaps = int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
    adapted = (own[:, 3] & 0x20) > 0
    field = np.where(adapted, own[:, 4].astype(np.int64) + 1, 0)
    flagged = adapted & (field > 1) & ((own[:, 5] & 0x40) > 0)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    if not len(begins):
        raise ValueError("no access unit begins")
    whole = gaps == 0 and begins[0] == 0
    parts, stamps, points = [], [], []
    for unit, (a, b) in enumerate(zip(begins.tolist(), [*begins.tolist()[1:], len(own)])):
        rows = own[a:b]
        skip = field[a:b]
        if (skip[1:-1] == 0).all() and b - a > 2:
            pes = rows[0, 4 + skip[0] :].tobytes() + rows[1:-1, 4:].tobytes() + rows[-1, 4 + skip[-1] :].tobytes()
        else:
            pes = b"".join(r[4 + s :].tobytes() for r, s in zip(rows, skip))
        if pes[:4] != b"\x00\x00\x01" + bytes([PRIVATE_ID]):
            raise ValueError("a PES packet doesn't begin with its start code")
        size = int.from_bytes(pes[4:6], "big")
        if pes[7] & 0x80:
            p = pes[9:14]
            stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        if flagged[a]:
            points.append(unit)
        whole = whole and (size == 0 or len(pes) == 6 + size)
        parts.append(pes[9 + pes[8] : 6 + size if size else len(pes)])  # 0: up to the next one
    return Stream(b"".join(parts), program, pid, kind, len(packets), stamps, points, gaps, bool(whole))


def padded_size(n: int) -> int:
    return max(1, -(-n // BLOCK)) * BLOCK


def padded(text: bytes) -> bytes:
    return text.ljust(padded_size(len(text)), b"\0")


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the transport stream, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array([mux_bytes(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def demux(media: DataFrame, emit_payload: bool = True) -> DataFrame:
    """What the column media holds: payload (with emit_payload), digests, stamps and random_access (numbers of access units), feature, and whole; doc_id and n_bytes are passed on.

    Where a part of the payload is lost, or it isn't as long as n_bytes asks for,
    whole is false, and payload, its size and digests are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            streams = b["media"].to_pylist()
            found = [demux_bytes(s) for s in streams]
            whole = [x.whole and (n is None or len(x.payload) == padded_size(n)) for x, n in zip(found, b["n_bytes"].to_pylist())]
            payloads = [x.payload if w else None for x, w in zip(found, whole)]
            told = lambda f: [None if p is None else f(p) for p in payloads]
            cols = {
                "doc_id": b["doc_id"],
                "n_bytes": b["n_bytes"],
                "payload_bytes": pa.array(told(len), pa.int64()),
                "payload_sha256": pa.array(told(lambda p: hashlib.sha256(p).hexdigest()), pa.string()),
                "tail_crc32": pa.array(told(lambda p: zlib.crc32(p[-BLOCK:])), pa.int64()),
                "media_bytes": pa.array(map(len, streams), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                "feature": pa.array([f"program={x.program} pid={x.pid:#x} type={x.stream_type:#x} packets={x.packets} units={len(x.stamps)} pts={min(x.stamps, default=None)}-{max(x.stamps, default=None)} random_access={len(x.random_access)} gaps={x.gaps}" for x in found]),
                "stamps": pa.array([x.stamps for x in found], pa.list_(pa.int64())),
                "random_access": pa.array([x.random_access for x in found], pa.list_(pa.int32())),
                "whole": pa.array(whole),
            }
            if emit_payload:
                cols["payload"] = pa.array(payloads, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, random_access array<int>, whole boolean" + ", payload binary" * emit_payload)


def op10(docs: DataFrame) -> DataFrame:
    """Stores every text as a transport stream in a table, and reads that back; time stamps and random-access points come along."""
    return demux(stored(mux(docs), "media"), emit_payload=False)
