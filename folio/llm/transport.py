"""Media columns: MPEG transport streams as a lossless carrier of payload bytes.

mux() stores a binary column as one transport stream for each row: a program association and a program map table, then
packetised elementary stream (PES) units of UNIT payload bytes. Each unit begins with a presentation timestamp, every
RAP_EVERY-th one is flagged as a random-access point, and stuffing goes into adaptation fields, so the payload is cut, never
changed. demux() reads streams back: it puts the sections of PAT and PMTs together, over packets if need be, lists the
elementary streams of all programs, checks their continuity counters (a packet sent twice and a jump that is announced are no
loss), reassembles the units of one stream, with or without a length of their own, and reports timestamps, random-access
points and faults.

Rows are independent, so the plan is one scan with no exchange; repeated rows give equal results, an empty table none. A null
payload reads as empty; an empty one gives the two tables and no unit. A damaged stream gives the bytes of its intact units
and says so in `errors`; it raises nothing. Batches are cut by bytes, and a long payload goes alone and whole. Other columns
pass through; a clash with an output name is won by the output.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folio.llm.words import batches

PACKET, UNIT, RAP_EVERY = 188, 1152, 8
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
CLOCK_STEP = 3600  # ticks of 90 kHz between units
BATCH_BYTES = 8 << 20


def _crc32_mpeg_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << 1) ^ 0x04C11DB7, table << 1).astype(np.uint32)
    return table


_CRC = _crc32_mpeg_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(_CRC[(crc >> 24) ^ b])
    return crc


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF, ext >> 8, ext & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([0x47, 0x40 | (pid >> 8), pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(raw + b"\xff" * (PACKET - len(raw)), np.uint8)


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | (PMT_PID >> 8), PMT_PID & 0xFF])))
_PMT = _table_packet(
    PMT_PID,
    _section(2, 1, bytes([0xE0 | (ES_PID >> 8), ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | (ES_PID >> 8), ES_PID & 0xFF, 0xF0, 0])),
)


def _pts_bytes(pts: np.ndarray) -> np.ndarray:
    p = pts.astype(np.int64)
    return np.stack([0x21 | ((p >> 29) & 0x0E), (p >> 22) & 0xFF, 0x01 | ((p >> 14) & 0xFE), (p >> 7) & 0xFF, 0x01 | ((p << 1) & 0xFE)], -1).astype(np.uint8)


def _units(body: np.ndarray, first: int) -> np.ndarray:
    """Packets [units, packets, 188] of payload rows of one length; first: the number of the first unit."""
    n, size = body.shape
    number = first + np.arange(n)
    pes = np.zeros((n, 14 + size), np.uint8)
    pes[:, :4] = [0, 0, 1, STREAM_ID]
    pes[:, 4:6] = [(size + 8) >> 8, (size + 8) & 0xFF]
    pes[:, 6:9] = [0x80, 0x80, 5]
    pes[:, 9:14] = _pts_bytes(number * CLOCK_STEP % (1 << 33))
    pes[:, 14:] = body
    lead = PACKET - 4 - 2  # the first packet has a two-byte adaptation field for its flags
    count = 1 + -(-max(0, pes.shape[1] - lead) // (PACKET - 4))
    out = np.full((n, count, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = 0x47
    out[:, :, 1] = ES_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = ES_PID & 0xFF
    out[:, :, 3] = 0x10
    at = 0
    for k in range(count):
        room, left = lead if k == 0 else PACKET - 4, pes.shape[1] - at
        take = min(room, left)
        if k == 0 or take < room:
            field = PACKET - 4 - take
            out[:, k, 3] = 0x30
            out[:, k, 4] = field - 1
            if field > 1:
                out[:, k, 5] = 0
                if k == 0:
                    out[:, k, 5] = np.where(number % RAP_EVERY == 0, 0x40, 0)
        out[:, k, PACKET - take :] = pes[:, at : at + take]
        at += take
    return out


def encode(payload: bytes) -> bytes:
    """One transport stream that holds payload."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts = [np.stack([_PAT, _PMT])]
    if whole:
        parts.append(_units(data[: whole * UNIT].reshape(whole, UNIT), 0).reshape(-1, PACKET))
    if len(data) > whole * UNIT:
        parts.append(_units(data[whole * UNIT :][None], whole).reshape(-1, PACKET))
    out = np.concatenate(parts)
    out[2:, 3] |= (np.arange(len(out) - 2) % 16).astype(np.uint8)
    return out.tobytes()


def _body(packet: bytes) -> bytes:
    """What a packet carries behind its header and adaptation field."""
    if not packet[3] & 0x10:
        return b""
    return packet[4 + (1 + packet[4] if packet[3] & 0x20 else 0) :]


def _sections(packets: np.ndarray, table_id: int) -> Iterator[bytes]:
    """Bodies of all sound sections of a table in the packets of its PID."""
    held, last = None, None
    for row in packets:
        raw = row.tobytes()
        body, before, last = _body(raw), last, raw
        if not body or raw == before:  # sent twice
            continue
        parts = [body]
        if raw[1] & 0x40:
            parts = [body[1 : 1 + body[0]], body[1 + body[0] :]]
        for k, part in enumerate(parts):
            if raw[1] & 0x40 and k:
                held = b""
            if held is None:
                continue
            held += part
            while len(held) >= 3 and held[0] != 0xFF:
                size = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < size:
                    break
                section, held = held[:size], held[size:]
                if size >= 12 and section[0] == table_id and crc32_mpeg(section) == 0:
                    yield section[8:-4]


def programs(packets: np.ndarray, pid: np.ndarray) -> list[tuple[int, int, int]]:
    """(program, PID, stream type) of every elementary stream, in the order of the tables."""
    found, tables = [], {}
    for pat in _sections(packets[pid == 0], 0):
        for i in range(0, len(pat) - 3, 4):
            if number := pat[i] << 8 | pat[i + 1]:  # 0 is the network table
                tables.setdefault(number, (pat[i + 2] & 0x1F) << 8 | pat[i + 3])
    for number, table in tables.items():
        for pmt in _sections(packets[pid == table], 2):
            at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3]) if len(pmt) >= 4 else len(pmt)
            while at + 5 <= len(pmt):
                stream = (number, (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2], pmt[at])
                if stream not in found:
                    found.append(stream)
                at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    return found


def _continuous(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packets of one PID that carry something, without repeats, and where one or more are missing ahead of a packet."""
    own = own[own[:, 3] & 0x10 != 0]
    if not len(own):
        return own, np.zeros(0, bool)
    counter = own[:, 3] & 15
    again = 1 + np.flatnonzero(counter[1:] == counter[:-1])
    own = np.delete(own, again[(own[again] == own[again - 1]).all(1)], 0)
    step = np.r_[0, (np.diff(own[:, 3].astype(np.int16) & 15) - 1) % 16]
    announced = (own[:, 3] & 0x20 != 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 != 0)
    return own, (step != 0) & ~announced


def decode(media: bytes, stream: int = 0) -> dict:
    """Payload and index of a stream: payload, packets, units, rap (unit numbers), pts (null where a unit has none), lost,
    errors; streams lists all (program, pid, kind), of which number `stream` is read."""
    out = {"payload": b"", "packets": len(media) // PACKET, "units": 0, "rap": [], "pts": [], "lost": 0, "errors": [], "streams": []}
    if len(media) % PACKET:
        out["errors"].append("partial packet")
    packets = np.frombuffer(media, np.uint8, out["packets"] * PACKET).reshape(-1, PACKET)
    if len(packets):
        fits = (packets[:, 3] & 0x20 == 0) | (packets[:, 4] <= PACKET - 5)
        sound = (packets[:, 0] == 0x47) & (packets[:, 1] & 0x80 == 0) & (packets[:, 3] & 0xC0 == 0) & fits
        if not sound.all():
            out["errors"].append("bad packet")
            packets = packets[sound]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    found = programs(packets, pid)
    out["streams"] = [{"program": a, "pid": b, "kind": c} for a, b, c in found]
    if not found:
        out["errors"].append("no program")
        return out
    if stream >= len(found):
        out["errors"].append("no stream")
        return out
    own, gap = _continuous(packets[pid == found[stream][1]])
    out["lost"] = int(gap.sum())
    if out["lost"]:
        out["errors"].append("continuity")
    start = own[:, 1] & 0x40 != 0
    heads = np.flatnonzero(start)
    if not len(heads):
        return out
    adapted = own[:, 3] & 0x20 != 0
    skip = 4 + np.where(adapted, own[:, 4].astype(np.int64) + 1, 0)
    held = np.arange(PACKET)[None] >= skip[:, None]
    raw, n = own[held], held.sum(1)
    begin = (np.cumsum(n) - n)[heads]
    limit = np.r_[begin[1:], len(raw)]
    head = np.r_[raw, np.zeros(14, np.uint8)][begin[:, None] + np.arange(14)].astype(np.int64)
    size = head[:, 4] << 8 | head[:, 5]
    body, stop = begin + 9 + head[:, 8], np.where(size == 0, limit, begin + size + 6)
    good = (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1) & (limit - begin >= 9) & (stop == limit) & (body <= stop)
    unit, hurt = np.cumsum(start) - 1, np.zeros(len(heads) + 1, bool)
    hurt[unit[gap & ~start]] = True  # -1, ahead of the first unit, is the entry that no unit reads
    before = unit[gap & start] - 1  # may have lost its end, which only its length tells
    hurt[before[before >= 0]] |= size[before[before >= 0]] == 0
    good &= ~hurt[:-1]
    if not good.all():
        out["errors"].append("broken unit")
    mark = np.zeros(len(raw) + 1, np.int8)
    np.add.at(mark, body[good], 1)
    np.add.at(mark, stop[good], -1)
    out["payload"] = raw[np.cumsum(mark[:-1]) > 0].tobytes()
    stamped = (head[:, 7] & 0x80 != 0) & (head[:, 8] >= 5)
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    flagged = adapted[heads] & (own[heads, 4] > 0) & (own[heads, 5] & 0x40 != 0)
    times = [t if ok else None for t, ok in zip(pts[good].tolist(), stamped[good].tolist(), strict=True)]
    out |= {"units": int(good.sum()), "rap": np.flatnonzero(flagged & good).tolist(), "pts": times}
    return out


def _with(df: DataFrame, names: set[str]) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def mux(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """Adds binary column `out`: the payload as a transport stream."""
    kept = df.select(*[F.col(f"`{c}`") for c in _with(df, {out.lower()})])
    schema = StructType([*kept.schema, StructField(out, BinaryType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, payload, BATCH_BYTES):
            media = pa.array((encode(x.as_py() or b"") for x in part.column(part.schema.get_field_index(payload))), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, media], [*part.schema.names, out])

    return kept.mapInArrow(run, schema)


INDEX = "payload binary, packets long, units long, rap array<long>, pts array<long>, lost long, errors array<string>, streams array<struct<program: long, pid: long, kind: long>>"
_STREAM = pa.struct([(k, pa.int64()) for k in ("program", "pid", "kind")])


def demux(df: DataFrame, media: str = "media", stream: int = 0) -> DataFrame:
    """Adds the columns of INDEX, read from the stored streams: of the elementary stream number `stream`."""
    kinds = {"payload": pa.binary(), "packets": pa.int64(), "units": pa.int64(), "rap": pa.list_(pa.int64()), "pts": pa.list_(pa.int64()), "lost": pa.int64(), "errors": pa.list_(pa.string()), "streams": pa.list_(_STREAM)}
    kept = df.select(*[F.col(f"`{c}`") for c in _with(df, set(kinds))])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), INDEX])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, media, BATCH_BYTES):
            found = [decode(x.as_py() or b"", stream) for x in part.column(part.schema.get_field_index(media))]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in found], t) for k, t in kinds.items())], [*part.schema.names, *kinds])

    return kept.mapInArrow(run, schema)


BLOCK = 576


def digest(documents: DataFrame) -> DataFrame:
    """Texts through mux() and demux(): what was stored, what came back, and a feature line of the index."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(text)
    fill = F.when(n == 0, BLOCK).otherwise(F.pmod(-n, F.lit(BLOCK)))
    raw = documents.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(text, F.unhex(F.repeat(F.lit("FF"), fill))).alias("payload"))
    back = demux(mux(raw).drop("payload"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("packets="), "packets"),
            F.concat(F.lit("units="), "units"),
            F.concat(F.lit("rap="), F.size("rap")),
            F.concat(F.lit("last_pts="), F.coalesce(F.expr("try_element_at(pts, -1)"), F.lit(-1))),
            F.concat(F.lit("lost="), "lost"),
            F.concat(F.lit("errors="), F.concat_ws(",", "errors")),
        ).alias("feature"),
    )
