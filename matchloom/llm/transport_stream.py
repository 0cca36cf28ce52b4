"""MPEG transport streams as a media column: multiplex a payload, and parse tables, continuity, packets and timestamps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, modest_batches, per_batch, tidy

PACKET, SYNC, PROGRAM, TABLE_PID, MEDIA_PID, PRIVATE_DATA = 188, 0x47, 1, 0x1000, 0x100, 0x06


@dataclass(frozen=True)
class Timing:
    """Bytes of one access unit, 90 kHz ticks from one to the next, and units from one random-access point to the next."""

    unit: int = 30_720
    ticks: int = 3_003
    every: int = 8


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        crc &= 0xFFFFFFFF
    return crc


def section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, content: bytes) -> bytes:
    own = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + content
    return own.ljust(PACKET, b"\xff")


PAT = table_packet(0, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | TABLE_PID).to_bytes(2, "big")))
PMT = table_packet(TABLE_PID, section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def stamp(ticks: int, mark: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 0x0E) | 1, ticks >> 22 & 0xFF, (ticks >> 14 & 0xFE) | 1, ticks >> 7 & 0xFF, (ticks << 1 & 0xFE) | 1])


def mux(payload: bytes, timing: Timing | None = None) -> bytes:
    """One program with one private-data stream: the tables before every random-access point, then packetised units with
    presentation times, clock references and continuity counters. The payload is stored as it is."""
    timing, out, counter, repeats = timing or Timing(), [], 0, 0
    for k, at in enumerate(range(0, len(payload), timing.unit)):
        part, random_access = payload[at : at + timing.unit], k % timing.every == 0
        if random_access:
            for table in (PAT, PMT):
                out.append(table[:3] + bytes([0x10 | repeats & 15]) + table[4:])
            repeats += 1
        ticks = k * timing.ticks
        header = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(ticks, 2)
        pes = np.frombuffer(header + part, np.uint8)
        first = min(PACKET - 12, len(pes))
        rest = len(pes) - first
        full, last = divmod(rest, PACKET - 4)
        packets = np.full((1 + full + (last > 0), PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(len(packets))) & 15
        counter += len(packets)
        # the first packet has an adaptation field with the clock reference, and stuffing where the unit is short
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4] = PACKET - 5 - first
        packets[0, 5] = 0x10 | (0x40 if random_access else 0)
        packets[0, 6:12] = np.frombuffer(((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        packets[0, PACKET - first :] = pes[:first]
        packets[1 : 1 + full, 4:] = pes[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if last:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = PACKET - 5 - last
            if last < PACKET - 5:
                packets[-1, 5] = 0
            packets[-1, PACKET - last :] = pes[-last:]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream: its bytes, its units (presentation time, start in the payload, random access) and faults;
    ``streams`` counts all that the program tables name."""

    payload: bytes
    packets: int
    program: int
    pid: int
    kind: int
    times: list[int]
    starts: list[int]
    random_access: list[bool]
    gaps: int
    faults: list[str]
    streams: int = 0


def sections_of(packets: np.ndarray, offsets: np.ndarray, faults: list[str]) -> Iterator[bytes]:
    """The sections of a table's packets whose checksum is right, one after another: a section may go on over packets, and
    one packet may hold several. A damaged or broken one is a fault, and reading goes on at the next start."""
    held, last = b"", None
    for packet, offset in zip(packets, offsets, strict=True):
        whole = packet.tobytes()
        if last == whole:
            continue  # a packet may be sent twice
        last, own = whole, whole[int(offset) :]
        if packet[1] & 0x40:
            if not own:
                continue
            ended, held = held + own[1 : 1 + own[0]] if held else b"", own[1 + own[0] :]
            rest = yield from cut(ended, faults)
            if rest:
                faults.append("table")
        elif held:
            held += own
        held = yield from cut(held, faults)
    if held:
        faults.append("table")


def cut(data: bytes, faults: list[str]) -> Generator[bytes, None, bytes]:
    """Yields the sound sections at the start of the data; returns what is left: a section's beginning, or nothing."""
    at = 0
    while at < len(data) and data[at] != 0xFF:
        size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0x0FFF)
        if at + 3 > len(data) or at + size > len(data):
            return data[at:]
        body = data[at : at + size]
        if size < 12 or crc32_mpeg_cached(body):
            faults.append("table")
        else:
            yield body
        at += size
    return b""


_CHECKED: dict[bytes, int] = {}


def crc32_mpeg_cached(body: bytes) -> int:
    """Tables repeat from stream to stream; at most 1,024 of them are remembered."""
    if body not in _CHECKED:
        if len(_CHECKED) >= 1_024:
            _CHECKED.clear()
        _CHECKED[body] = crc32_mpeg(body)
    return _CHECKED[body]


class Packets:
    """The sound packets of a stream: their bytes, packet ids, starts of their payloads, and whether they carry one."""

    def __init__(self, media: bytes) -> None:
        self.faults: list[str] = ["length"] if len(media) % PACKET else []
        grid = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
        good = grid[:, 0] == SYNC
        if not good.all():
            self.faults.append("sync")
            grid = grid[good]
        self.grid = grid
        self.pids = (grid[:, 1].astype(int) & 0x1F) << 8 | grid[:, 2]
        self.offsets = np.minimum(4 + np.where(grid[:, 3] & 0x20, 1 + grid[:, 4].astype(int), 0), PACKET)
        self.carries = (grid[:, 3] & 0x10) > 0

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        own = (self.pids == pid) & self.carries
        return self.grid[own], self.offsets[own]

    def table(self, pid: int, ident: int, number: int | None = None) -> list[bytes]:
        """The sections of one table in their order, from the first packets that hold them all."""
        found: dict[int, bytes] = {}
        for s in sections_of(*self.of(pid), self.faults):
            if s[0] != ident or not s[5] & 1 or number not in (None, int.from_bytes(s[3:5], "big")):
                continue
            found.setdefault(s[6], s)
            if len(found) > s[7]:
                break
        return [found[k] for k in sorted(found)]

    def streams(self) -> list[tuple[int, int, int]]:
        """(program, packet id, type) of every elementary stream of every program."""
        out = []
        programs = [(int.from_bytes(s[k : k + 2], "big"), int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF) for s in self.table(0, 0) for k in range(8, len(s) - 7, 4)]
        programs = [p for p in programs if p[0]]
        if not programs:
            self.faults.append("no program")
        for program, pid in programs:
            maps = self.table(pid, 2, program)
            if not maps:
                self.faults.append("no program map")
            for s in maps:
                at = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
                while at + 5 <= len(s) - 4:
                    out.append((program, int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF, s[at]))
                    at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
        if programs and not out:
            self.faults.append("no stream")
        return out

    def elementary(self, program: int, pid: int, kind: int) -> Stream:
        """Checks the continuity counters of one stream and puts its packetised units together."""
        faults, (rows, offset) = list(self.faults), self.of(pid)
        counters = rows[:, 3] & 15
        steps = (counters[1:].astype(int) - counters[:-1]) & 15
        repeated = np.r_[False, (steps == 0) & (rows[1:, 1:] == rows[:-1, 1:]).all(1)] if len(rows) else np.zeros(0, bool)
        rows, offset, counters = rows[~repeated], offset[~repeated], counters[~repeated]  # a packet may be sent twice
        jumps = ((counters[1:].astype(int) - counters[:-1]) & 15) != 1
        allowed = (rows[1:, 3] & 0x20 > 0) & (rows[1:, 4] > 0) & (rows[1:, 5] & 0x80 > 0)  # marked discontinuities
        gaps = int((jumps & ~allowed).sum())
        data = rows[np.arange(PACKET) >= offset[:, None]]
        ends = np.cumsum(PACKET - offset)
        begins = np.flatnonzero(rows[:, 1] & 0x40)
        marks = (rows[begins, 3] & 0x20 > 0) & (rows[begins, 4] > 0) & (rows[begins, 5] & 0x40 > 0)
        edges = [int(ends[b] - (PACKET - offset[b])) for b in begins] + [len(data)]
        parts, times, starts, random_access, done = [], [], [], [], 0
        for k, mark in enumerate(marks.tolist()):
            unit = data[edges[k] : edges[k + 1]].tobytes()
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                faults.append("packet start")
                continue
            size = int.from_bytes(unit[4:6], "big")
            body = unit[9 + unit[8] : 6 + size if size else len(unit)]
            if size and len(unit) < 6 + size:
                faults.append("short unit")
            if unit[7] & 0x80 and len(unit) >= 14:
                t = unit[9:14]
                times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            else:
                times.append(times[-1] if times else 0)
            starts.append(done)
            random_access.append(mark)
            parts.append(body)
            done += len(body)
        return Stream(b"".join(parts), len(self.grid), program, pid, kind, times, starts, random_access, gaps, faults)


def demux_all(media: bytes) -> list[Stream]:
    """Every elementary stream of every program, in the order of the tables; one empty stream with faults where the tables
    name none. Damage gives faults, no exception."""
    packets = Packets(media)
    named = packets.streams()
    out = [packets.elementary(*x) for x in named] or [Stream(b"", len(packets.grid), 0, 0, 0, [], [], [], 0, packets.faults)]
    for s in out:
        s.streams = len(named)
    return out


def demux(media: bytes) -> Stream:
    """The first program's first stream; ``streams`` tells how many more there are (``demux_all`` reads them)."""
    packets = Packets(media)
    named = packets.streams()
    s = packets.elementary(*named[0]) if named else Stream(b"", len(packets.grid), 0, 0, 0, [], [], [], 0, packets.faults)
    s.streams = len(named)
    return s


def padded(text: bytes, multiple: int = 192) -> bytes:
    """The bytes and spaces up to a positive multiple."""
    return text.ljust(max(1, -(-len(text) // multiple)) * multiple, b" ")


def encode_media(docs: DataFrame, timing: Timing | None = None) -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) as a transport stream of its padded UTF-8 bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 64):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch_of(schema, (batch.column("doc_id"), list(map(len, texts)), [mux(padded(t), timing) for t in texts]))

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pts: bigint, start: bigint, random_access: boolean>>"


def read_media(media: DataFrame) -> DataFrame:
    """Demultiplexes a media column: payload digests, the stored form's digest, tables, continuity and the index of units.

    A null or damaged stream gives an empty or partial payload and says so in ``faults``; it raises nothing."""
    fields = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, program int, pid int, stream_type int, n_streams int, continuity_gaps int, units {UNITS}, faults array<string>, feature string"
    unit = pa.struct([("pts", pa.int64()), ("start", pa.int64()), ("random_access", pa.bool_())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(unit), pa.list_(pa.string()), pa.string()]
    schema = pa.schema(list(zip([f.split()[0] for f in fields.replace(UNITS, "x").split(", ")], types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 64):
            rows = []
            for doc_id, n, stored in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                stored = stored or b""
                s = demux(stored)
                units = [{"pts": t, "start": b, "random_access": r} for t, b, r in zip(s.times, s.starts, s.random_access, strict=True)]
                said = f"program={s.program};pid={s.pid};type={s.kind};packets={s.packets};streams={s.streams};units={len(units)};random_access={sum(s.random_access)};first_pts={s.times[0] if units else -1};last_pts={s.times[-1] if units else -1};gaps={s.gaps};faults={','.join(s.faults)}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), s.packets, s.program, s.pid, s.kind, s.streams, s.gaps, units, s.faults, said))
            yield batch_of(schema, zip(*rows, strict=True))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), fields)


def elementary_streams(media: DataFrame) -> DataFrame:
    """``doc_id, number, program, pid, stream_type, payload, continuity_gaps, units, faults``: a row for every elementary
    stream of every program of a media column (a stream without any that can be read: one row, number 0, empty payload)."""
    unit = pa.struct([("pts", pa.int64()), ("start", pa.int64()), ("random_access", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("number", "program", "pid", "stream_type")), ("payload", pa.binary()), ("continuity_gaps", pa.int32()), ("units", pa.list_(unit)), ("faults", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(batches, 16):
            rows = []
            for doc_id, stored in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                for k, s in enumerate(demux_all(stored or b"")):
                    units = [{"pts": t, "start": b, "random_access": r} for t, b, r in zip(s.times, s.starts, s.random_access, strict=True)]
                    rows.append((doc_id, k, s.program, s.pid, s.kind, s.payload, s.gaps, units, s.faults))
            yield batch_of(schema, zip(*rows, strict=True))

    return media.select("doc_id", "media").mapInArrow(tidy(run), f"doc_id long, number int, program int, pid int, stream_type int, payload binary, continuity_gaps int, units {UNITS}, faults array<string>")


def media_report(docs: DataFrame, timing: Timing | None = None) -> DataFrame:
    """Each document's text stored as a stream and read back: ``doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature`` and what the tables, counters and units say.

    Null and empty texts are stored as one padded block of spaces. Equal texts give equal streams, so equal values; a null
    doc_id and repeated rows are kept; an empty table gives no rows; other columns are ignored."""
    return read_media(encode_media(modest_batches(docs), timing))
