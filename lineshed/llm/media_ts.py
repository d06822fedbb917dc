"""Binary payloads as MPEG transport streams, and what a demultiplexer reads from them.

`store` writes each payload as one programme: a programme association table, a programme map table
and one private elementary stream of access units of `UNIT` bytes. Each unit is a PES packet with a
presentation time stamp; every `KEY_EVERY`-th unit starts at a random-access point with a clock
reference. `probe` reads such bytes back: it takes the programme tables (sections with a wrong CRC
don't count), checks every PID's continuity counter, reassembles the elementary packets and lists
time stamps, clock references and random-access points.

Edge cases: a null payload counts as empty; a payload is filled with bytes 0 to a positive multiple
of `ALIGN`; a duplicate packet (equal counter) is dropped as the standard says; after a gap in the
counter the unit at hand is marked as broken and left out of the payload; bytes that don't start with
a sync byte are skipped up to the next one; equal payloads give equal streams, repeated or not, so there are
no ties; a very long text is one stream like any other; an empty table gives no rows; columns in `keep` and
those beside the media column pass untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lineshed.llm.textops import map_texts

PACKET = 188
SYNC = 0x47
ALIGN = 64
UNIT = 4096
KEY_EVERY = 8
TICKS = 3600  # of 90 kHz a unit
PMT_PID, STREAM_PID, STREAM_TYPE, PROGRAM, STREAM_ID = 0x1000, 0x0100, 0x06, 1, 0xBD


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of table sections; 0 over a section with its own CRC."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    """A section in force, version 0, number 0 of 0, with pointer field and CRC."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00"
    return b"\x00" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10])
    return head + section + b"\xff" * (PACKET - 4 - len(section))


_TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    """A presentation time stamp of 33 bits in its 5 bytes."""
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 0xFF, 1 | (t >> 15 & 0x7F) << 1, t >> 7 & 0xFF, 1 | (t & 0x7F) << 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a positive multiple of ALIGN."""
    out = [_TABLES]
    counter = 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        ticks = number * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + unit
        extra = b""
        if number % KEY_EVERY == 0:
            base = ticks & 0x1FFFFFFFF
            extra = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
        start, done = 0x40, 0
        while done < len(pes):
            take = min(len(pes) - done, PACKET - 4 - (len(extra) + 1 if extra else 0))
            room = PACKET - 4 - take
            if room:
                field_ = extra or (b"\x00" if room > 1 else b"")
                adaptation = bytes([room - 1]) + field_ + b"\xff" * (room - 1 - len(field_))
                out.append(bytes([SYNC, start | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter]) + adaptation + pes[done : done + take])
            else:
                out.append(bytes([SYNC, start | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | counter]) + pes[done : done + take])
            counter = (counter + 1) & 15
            start, extra = 0, b""
            done += take
    return b"".join(out)


@dataclass
class Unit:
    """One access unit: where it starts, its stamp, and its bytes."""

    packet: int
    pid: int
    pts: int | None
    key: bool
    data: bytes
    broken: bool = False


@dataclass
class Probe:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    gaps: int = 0
    duplicates: int = 0
    clock: list[int] = field(default_factory=list)  # references, in ticks of 27 MHz
    units: list[Unit] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units if not u.broken)

    @property
    def feature(self) -> str:
        streams = ",".join(f"{n}:{pid:#06x}/{kind:#04x}" for n, s in sorted(self.programs.items()) for pid, kind in sorted(s.items()))
        stamps = [u.pts for u in self.units if u.pts is not None]
        return (
            f"ts packets={self.packets} programs={len(self.programs)} streams={streams} gaps={self.gaps} duplicates={self.duplicates} units={len(self.units)} "
            f"access_points={sum(u.key for u in self.units)} first_pts={min(stamps, default=-1)} last_pts={max(stamps, default=-1)} "
            f"clock_references={len(self.clock)} last_clock={max(self.clock, default=-1)}"
        )


class _Sections:
    """The sections of one PID, put together from packets."""

    def __init__(self) -> None:
        self.pending: bytes | None = None  # None: waiting for a packet in which a section starts

    def feed(self, data: bytes, starts: bool) -> list[bytes]:
        """The sections that end in this packet and whose CRC is right."""
        out: list[bytes] = []
        if starts:
            if not data:
                return out
            if self.pending is not None:
                self.pending += data[1 : 1 + data[0]]
                self._take(out)
            self.pending = data[1 + data[0] :]
        elif self.pending is not None:
            self.pending += data
        self._take(out)
        return out

    def _take(self, out: list[bytes]) -> None:
        while self.pending is not None and len(self.pending) >= 3 and self.pending[0] != 0xFF:
            size = 3 + ((self.pending[1] & 0x0F) << 8 | self.pending[2])
            if len(self.pending) < size:
                return
            section, self.pending = self.pending[:size], self.pending[size:]
            if size >= 12 and crc32_mpeg(section) == 0:
                out.append(section)
        if self.pending and self.pending[0] == 0xFF:  # filling up to the packet's end
            self.pending = None


def _finish(unit: list, into: Probe) -> None:
    """Takes the PES header off the bytes gathered for a unit."""
    packet, pid, key, parts, broken = unit
    data = b"".join(parts)
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        into.units.append(Unit(packet, pid, None, key, b"", True))
        return
    size = int.from_bytes(data[4:6], "big")
    head = 9 + data[8]
    pts = None
    if data[7] & 0x80 and len(data) >= 14:
        pts = (data[9] >> 1 & 7) << 30 | data[10] << 22 | data[11] >> 1 << 15 | data[12] << 7 | data[13] >> 1
    end = 6 + size if size else len(data)
    into.units.append(Unit(packet, pid, pts, key, data[head:end], broken or len(data) < end))


def _tables(section: bytes, pid: int, maps: dict[int, int], kinds: dict[int, int], found: Probe) -> None:
    """Takes over what a programme association or map section says."""
    if pid == 0 and section[0] == 0:
        for k in range(8, len(section) - 4, 4):
            if number := section[k] << 8 | section[k + 1]:
                maps[(section[k + 2] & 0x1F) << 8 | section[k + 3]] = number
    elif pid in maps and section[0] == 2:
        k = 12 + ((section[10] & 0x0F) << 8 | section[11])
        streams = found.programs.setdefault(maps[pid], {})
        while k + 5 <= len(section) - 4:
            own = (section[k + 1] & 0x1F) << 8 | section[k + 2]
            streams[own] = kinds[own] = section[k]
            k += 5 + ((section[k + 3] & 0x0F) << 8 | section[k + 4])


def demux(stream: bytes) -> Probe:
    """Reads a transport stream."""
    found = Probe()
    maps: dict[int, int] = {}
    kinds: dict[int, int] = {}
    counters: dict[int, int] = {}
    open_units: dict[int, list] = {}
    sections: dict[int, _Sections] = {}
    at = 0
    while at + PACKET <= len(stream):
        if stream[at] != SYNC:
            nxt = stream.find(b"\x47", at + 1)
            at = nxt if nxt >= 0 else len(stream)
            continue
        b1, b3 = stream[at + 1], stream[at + 3]
        pid = (b1 & 0x1F) << 8 | stream[at + 2]
        body, end = at + 4, at + PACKET
        at = end
        found.packets += 1
        if pid == 0x1FFF:
            continue
        flags = 0
        if b3 & 0x20:
            if stream[body]:
                flags = stream[body + 1]
            if flags & 0x10 and stream[body] >= 7:
                clock = int.from_bytes(stream[body + 2 : body + 8], "big")
                found.clock.append((clock >> 15) * 300 + (clock & 0x1FF))
            body += 1 + stream[body]
        if not b3 & 0x10:
            continue
        last = counters.get(pid)
        counters[pid] = now = b3 & 15
        if last is not None and not flags & 0x80:
            if now == last:
                found.duplicates += 1
                continue
            if now != (last + 1) & 15:
                found.gaps += 1
                sections.pop(pid, None)
                if pid in open_units:
                    open_units[pid][4] = True
        if pid == 0 or pid in maps:
            for section in sections.setdefault(pid, _Sections()).feed(stream[body:end], bool(b1 & 0x40)):
                _tables(section, pid, maps, kinds, found)
        elif pid in kinds:
            if b1 & 0x40:
                if pid in open_units:
                    _finish(open_units.pop(pid), found)
                open_units[pid] = [found.packets - 1, pid, bool(flags & 0x40), [stream[body:end]], False]
            elif pid in open_units:
                open_units[pid][3].append(stream[body:end])
    for unit in sorted(open_units.values(), key=lambda u: u[0]):
        _finish(unit, found)
    return found


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of ALIGN."""
    return payload + b"\x00" * (max(ALIGN, -(-len(payload) // ALIGN) * ALIGN) - len(payload))


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, n_bytes (of the UTF-8 text, before filling) and media, the transport stream."""

    def write(texts: list) -> list:
        payloads = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return [[len(p) for p in payloads], [mux(padded(p)) for p in payloads]]

    return map_texts(docs, text, keep, "n_bytes long, media binary", write)


def probe(stored: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the media column by what is read from it, digests included."""

    def read(streams: list) -> list:
        rows = []
        for stream in streams:
            stream = stream or b""
            got = demux(stream)
            payload = got.payload
            points = [{"pts": u.pts, "packet": u.packet} for u in got.units if u.key]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(stream), hashlib.sha256(stream).hexdigest(), got.feature, points))
        return list(zip(*rows))

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points array<struct<pts: long, packet: long>>"
    return map_texts(stored, media, [c for c in stored.columns if c != media], fields, read)
