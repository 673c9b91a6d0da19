"""MPEG transport streams: multiplex payloads into 188-byte packets, and read such streams: program tables, continuity
counters, elementary packets with their timestamps, and random-access points."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import read

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0, 0x100, 0x101, 1, 0x06, 0xBD
#: Bytes of payload in one access unit, 90-kHz ticks between units, units between random-access points.
UNIT, TICKS, ACCESS_EVERY = 8192, 3600, 8


def _crc_table() -> np.ndarray:
    """Table of the CRC with polynomial 0x04C11DB7, most significant bit first."""
    t = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        t = np.where(t & np.uint64(1 << 31), (t << np.uint64(1)) ^ np.uint64(0x04C11DB7), t << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return t


CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0"))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 255, (t >> 14 & 0xFE) | 1, t >> 7 & 255, (t << 1 & 0xFE) | 1])


def mux(payload: bytes) -> bytes:
    """A stream of one program with one private stream: access units of UNIT bytes with presentation times, a clock
    reference and the random-access flag at every ACCESS_EVERY-th. Equal payloads give equal streams."""
    out, counter = [TABLES], 0
    for k, s in enumerate(range(0, max(len(payload), 1), UNIT)):
        data, t = payload[s : s + UNIT], (k * TICKS) & ((1 << 33) - 1)
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + data
        adapt = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big") if k % ACCESS_EVERY == 0 else b""
        first = min(PACKET - 4 - (len(adapt) + 1 if adapt else 0), len(pes))
        n = 1 + -(-(len(pes) - first) // 184)
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        block[0, 1] |= 0x40
        if n > 2:
            block[1:-1, 4:] = np.frombuffer(pes, np.uint8, (n - 2) * 184, first).reshape(-1, 184)
        for i, part, a in [(0, pes[:first], adapt), (n - 1, pes[first + (n - 2) * 184 :], b"")][:n]:
            room = 184 - len(part)
            if room:  # an adaptation field holds the flags and stuffs the packet
                block[i, 3] |= 0x20
                block[i, 4] = room - 1
                if room > 1:
                    block[i, 5 : 5 + max(len(a), 1)] = np.frombuffer(a or b"\0", np.uint8)
            block[i, PACKET - len(part) :] = np.frombuffer(part, np.uint8)
        out.append(block.tobytes())
    return b"".join(out)


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _psi(chunks: list[bytes]) -> bytes | None:
    """The first whole section of a table's payloads whose CRC is right."""
    data = b"".join(chunks)
    if not data:
        return None
    start = 1 + data[0]
    if len(data) < start + 3:
        return None
    n = 3 + ((data[start + 1] & 0x0F) << 8 | data[start + 2])
    section = data[start : start + n]
    return section if len(section) == n and n >= 12 and section_crc(section) == 0 else None


def demux(media: bytes | None) -> dict:
    """What a stream holds: programs (number, table's PID), streams (program, PID, type), units (PID, presentation and
    decoding time, random access, clock reference, payload, and whether it is whole: no packet is missing in it or between
    it and the next unit, nor bytes of its stated length) in order, and counts of lost_sync (packets without the sync
    byte), continuity_errors, duplicates (a packet sent twice is dropped), bad_tables and a tail shorter than a packet.
    Null or empty: nothing."""
    raw = np.frombuffer(media or b"", np.uint8)
    p = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    seen = {"packets": len(p), "tail": len(raw) % PACKET, "lost_sync": 0, "continuity_errors": 0, "duplicates": 0, "bad_tables": 0, "programs": [], "streams": [], "units": []}
    ok = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)
    seen["lost_sync"] = int((~ok).sum())
    p = p[ok]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_adapt, has_data = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    size = np.where(has_adapt, p[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(has_adapt & (size > 1), p[:, 5], 0)
    begin = np.minimum(4 + size, PACKET)
    lists: dict[int, np.ndarray] = {}
    gaps: dict[int, np.ndarray] = {}

    def payloads(which: int) -> np.ndarray:
        """Indices of a PID's packets with payload, in order; continuity is checked once for each PID."""
        if which in lists:
            return lists[which]
        i = np.flatnonzero((pid == which) & has_data)
        gaps[which] = np.zeros(len(i) + 1, bool)
        if len(i) > 1:
            step = (p[i[1:], 3].astype(np.int32) - p[i[:-1], 3]) & 15
            same = (step == 0) & (p[i[1:]] == p[i[:-1]]).all(1)
            seen["duplicates"] += int(same.sum())
            lost = (step != 1) & ~same & (flags[i[1:]] & 0x80 == 0)
            seen["continuity_errors"] += int(lost.sum())
            i = i[np.r_[True, ~same]]
            gaps[which] = np.r_[False, lost[~same], False]  # before a packet, and at the end
        lists[which] = i
        return i

    def table(which: int) -> bytes | None:
        i = payloads(which)
        starts = np.flatnonzero(p[i, 1] & 0x40)
        for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
            if section := _psi([p[k, begin[k] :].tobytes() for k in i[a:b]]):
                return section
        seen["bad_tables"] += 1
        return None

    if len(p) and (pat := table(PAT_PID)):
        for at in range(8, len(pat) - 4, 4):
            number, where = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
            if not number:
                continue
            seen["programs"].append((number, where))
            if pmt := table(where):
                at2 = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
                while at2 + 5 <= len(pmt) - 4:
                    seen["streams"].append((number, int.from_bytes(pmt[at2 + 1 : at2 + 3], "big") & 0x1FFF, pmt[at2]))
                    at2 += 5 + (int.from_bytes(pmt[at2 + 3 : at2 + 5], "big") & 0x0FFF)
    for which in dict.fromkeys(s[1] for s in seen["streams"]):
        i = payloads(which)
        starts = np.flatnonzero(p[i, 1] & 0x40)
        for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
            own = i[a:b]
            inside = np.arange(PACKET) >= begin[own][:, None]
            pes = p[own][inside].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                continue
            n, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            pts = _time(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19 else pts
            f = int(flags[own[0]])
            pcr = int.from_bytes(p[own[0], 6:12].tobytes(), "big") >> 15 if f & 0x10 and size[own[0]] >= 8 else None
            whole = not gaps[which][a + 1 : b + 1].any() and (not n or len(pes) >= 6 + n)
            seen["units"].append((which, pts, dts, bool(f & 0x40), pcr, pes[head : 6 + n] if n else pes[head:], whole))
    return seen


def padded(text: str | None) -> bytes:
    """A text's UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_bytes and media, the transport stream that holds the whole text. Null: as empty.
    Columns named n_bytes or media are replaced; repeated rows are stored alike."""

    @F.pandas_udf("n_bytes long, media binary")
    def put(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame({"n_bytes": [len((x or "").encode("utf-8", "surrogatepass")) for x in t], "media": [mux(padded(x)) for x in t]})

    rest = docs.drop("n_bytes", "media")
    return rest.withColumn("__s", put(F.col(text))).drop(text).select("*", "__s.*").drop("__s")


UNITS = "pid int, pts long, dts long, random_access boolean, pcr long, size long, sha256 string, whole boolean"
REPORT = f"packets long, tail long, lost_sync long, continuity_errors long, duplicates long, bad_tables long, programs array<struct<number:int,pid:int>>, streams array<struct<program:int,pid:int,type:int>>, units array<struct<{', '.join(f.replace(' ', ':') for f in UNITS.split(', '))}>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string"


def inspect(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with `ts`, a struct of what demux() reads in the stored bytes; each unit carries its size and digest,
    and the payload digests are of all units' payloads in order. Null: an empty report. A column ts is replaced."""

    def report(x: bytes | None) -> tuple:
        d = demux(x)
        payload = b"".join(u[5] for u in d["units"])
        units = [(*u[:5], len(u[5]), hashlib.sha256(u[5]).hexdigest(), u[6]) for u in d["units"]]
        return (*[d[k] for k in ("packets", "tail", "lost_sync", "continuity_errors", "duplicates", "bad_tables", "programs", "streams")], units, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(x or b"").hexdigest())

    names = [f.split()[0] for f in ("packets long, tail long, lost_sync long, continuity_errors long, duplicates long, bad_tables long, programs x, streams x, units x, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string").split(", ")]
    fields = {"programs": ("number", "pid"), "streams": ("program", "pid", "type"), "units": tuple(f.split()[0] for f in UNITS.split(", "))}

    @F.pandas_udf(REPORT)
    def get(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for m in parts:
            rows = [report(x) for x in m]
            out = pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)})
            for c, keys in fields.items():
                out[c] = [[dict(zip(keys, v, strict=True)) for v in x] for x in out[c]]
            yield out

    return media.drop("ts").withColumn("ts", get(F.col(column)))


def op2(spark, sf_dir):
    kept = inspect(store(read(spark, sf_dir, "documents").select("doc_id", "text")))
    ts = F.col("ts")
    stamps = F.transform(F.filter(ts["units"], lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["pts"].cast("string"), u["size"].cast("string")))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), ts["packets"]), F.concat(F.lit("programs="), F.size(ts["programs"])), F.concat(F.lit("streams="), F.concat_ws(",", F.transform(ts["streams"], lambda s: F.concat_ws(":", s["pid"].cast("string"), s["type"].cast("string"))))), F.concat(F.lit("errors="), ts["continuity_errors"] + ts["lost_sync"] + ts["bad_tables"] + ts["tail"]), F.concat(F.lit("units="), F.size(ts["units"])), F.concat(F.lit("last_pts="), F.array_max(F.transform(ts["units"], lambda u: u["pts"]))), F.concat(F.lit("access="), F.concat_ws(",", stamps)))
    return kept.select("doc_id", "n_bytes", ts["payload_bytes"].alias("payload_bytes"), ts["payload_sha256"].alias("payload_sha256"), ts["tail_crc32"].alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), ts["media_sha256"].alias("media_sha256"), feature.alias("feature"))


QUERIES = {"op2_transport_streams": op2}
