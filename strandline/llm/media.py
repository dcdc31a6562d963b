"""Media columns: ISO media containers, written and read box by box.

``mux_column`` stores a payload losslessly as the samples of one track; ``probe``
walks the nested boxes of a container, decodes its sample tables and reports codec,
duration and the byte ranges of keyframes, touching no payload byte; ``samples``
reads the stored bytes back by those tables. Containers whose index comes before or
after the media data, 32- and 64-bit boxes and chunk offsets, constant or listed
sample sizes, several tracks, movie fragments with their runs of samples, and both
sync-sample conventions are read. What a probe reports at its top is the first video
track, or the first track if there is none; ``tracks`` has them all.

Defined cases: a null text is an empty payload; an empty payload becomes one sample
of 64 zero bytes; a null, cut or non-ISO container probes to null fields with
``error`` set, and never raises; equal texts give equal containers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store

UNIT = 64  # bytes of a sample: 64 unsigned 8-bit audio frames
TIMESCALE = 8000
KEY_EVERY = 16
CHUNK = 32  # samples of a chunk
DEEPEST = 32
#: Boxes that hold boxes, with the bytes of their own fields before those.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def pad(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of ``UNIT``."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")


def mux(payload: bytes) -> bytes:
    """A container whose one audio track ('raw ', 8-bit) has ``payload`` as samples."""
    n = len(payload) // UNIT
    duration = n * UNIT  # in frames of one byte
    chunks = -(-n // CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    tail = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, tail)] * (tail != CHUNK or chunks == 1)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    head = 8 if len(payload) + 8 < 2**32 else 16

    def index(first: int) -> bytes:
        wide = first + len(payload) >= 2**32
        at = first + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at_chunk, size, 1) for at_chunk, size in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        # version 1 of the header boxes has 64-bit durations
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        movie = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", movie, _box(b"trak", track, media))

    size = len(index(0)) if len(payload) < 2**31 else len(index(2**33))
    moov = index(len(_FTYP) + size + head)
    data = struct.pack(">I4s", len(payload) + 8, b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return b"".join((_FTYP, moov, data, payload))


def boxes(data: bytes | memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Each box of ``data``: its path of kinds, where it starts, and where its body starts and ends."""
    todo = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError("cut 64-bit size")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} has size {size} of {end - start}")
        todo.append((start + size, end, path))
        if kind in NESTED:
            if len(path) >= DEEPEST:
                raise ValueError("boxes nested too deep")
            todo.append((body + NESTED[kind], start + size, (*path, kind)))
        yield (*path, kind), start, body, start + size


def _table(data, at: int, end: int, width: str, columns: int, skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + skip)
    size = n * columns * int(width[-1])
    if at + skip + 4 + size > end:
        raise ValueError("cut sample table")
    return np.frombuffer(data, width, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def _fields(data, at: int, end: int, flags: int, layout: tuple[tuple[int, str], ...]) -> tuple[dict[int, int], int]:
    """The optional fields, in order, whose bits ``flags`` has, and where they end."""
    out = {}
    for bit, kind in layout:
        if flags & bit:
            size = struct.calcsize(kind)
            if at + size > end:
                raise ValueError("cut fragment")
            (out[bit],) = struct.unpack_from(kind, data, at)
            at += size
    return out, at


class _Fragment:
    """The track fragment that is read: its track, defaults, and where its next run lies."""

    def __init__(self, data, at: int, end: int, by_id: dict, moof: int, after: int | None):
        (head, self.track_id) = struct.unpack_from(">II", data, at)
        flags = head & 0xFFFFFF
        own, _ = _fields(data, at + 8, end, flags, ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")))
        self.track = by_id.get(self.track_id)
        if self.track is None:
            raise ValueError("fragment of an unknown track")
        default = self.track["trex"]
        self.duration, self.size, self.flags = (own.get(bit, default[k]) for k, bit in enumerate((0x8, 0x10, 0x20)))
        self.base = own[0x1] if 0x1 in own else moof if flags & 0x20000 or after is None else after
        self.next = self.base

    def run(self, data, at: int, end: int) -> None:
        """The samples of a run, put after those that the track has."""
        head, n = struct.unpack_from(">II", data, at)
        flags = head & 0xFFFFFF
        top, at = _fields(data, at + 8, end, flags, ((0x1, ">i"), (0x4, ">I")))
        kinds = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if at + 4 * n * len(kinds) > end or not kinds and n * max(1, self.size) > len(data):
            raise ValueError("cut fragment run")
        table = np.frombuffer(data, ">u4", n * len(kinds), at).astype(np.int64).reshape(n, len(kinds))

        def column(bit: int, default: int) -> np.ndarray:
            return table[:, kinds.index(bit)] if bit in kinds else np.full(n, default, np.int64)

        steps, size, own = column(0x100, self.duration), column(0x200, self.size), column(0x400, self.flags).copy()
        if n and 0x4 in top and 0x400 not in kinds:
            own[0] = top[0x4]
        start = self.base + top[0x1] if 0x1 in top else self.next
        t = self.track
        t["parts"].append((start + np.cumsum(size) - size, size, t["clock"] + np.cumsum(steps) - steps, own & 0x10000 == 0))
        t["clock"] += int(steps.sum())
        self.next = start + int(size.sum())


def tracks(data: bytes) -> list[dict]:
    """The tracks of a container: codec, kind, timescale, duration, and one offset,
    size, time and keyframe flag per sample, those of fragments included."""
    found: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[bytes, int, int, int]] = []
    for path, start, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"size": None, "sync": None, "parts": [], "clock": 0, "id": None})
        elif path == (b"moov", b"mvex", b"trex"):
            track_id, _, *own = struct.unpack_from(">5I", data, at + 4)
            defaults[track_id] = tuple(own)
        elif kind == b"moof" or path[:2] == (b"moof", b"traf"):
            fragments.append((kind, start, at, end))
        if len(path) < 3 or path[:2] != (b"moov", b"trak"):
            continue
        t = found[-1]
        if kind == b"tkhd":
            (t["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"mdhd":
            wide = data[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr":
            t["kind"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, at + 4)
            if fixed * n > len(data):
                raise ValueError("samples beyond the end")
            t["size"] = np.full(n, fixed, np.int64) if fixed else _table(data, at, end, ">u4", 1, 8)[:, 0]
        elif kind == b"stts":
            t["stts"] = _table(data, at, end, ">u4", 2)
        elif kind == b"stss":
            t["sync"] = _table(data, at, end, ">u4", 1)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = _table(data, at, end, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
    for t in found:
        size, runs, chunks = t["size"], t["stsc"], t["chunks"]
        # all is checked before anything is unrolled
        last = np.append(runs[1:, 0], len(chunks) + 1)[: len(runs)]
        own = last - runs[:, 0]
        if (own <= 0).any() or (len(runs) and runs[0, 0] != 1) or bool(len(runs)) != bool(len(chunks)) or int(t["stts"][:, 0].sum()) != len(size) or sum(a * b for a, b in zip(runs[:, 1].tolist(), own.tolist(), strict=True)) != len(size):
            raise ValueError("sample tables disagree")
        in_chunk = np.repeat(runs[:, 1], own)
        chunk = np.repeat(np.arange(len(chunks)), in_chunk)
        before = np.cumsum(size) - size
        first = np.cumsum(in_chunk) - in_chunk
        t["offset"] = chunks[chunk] + before - before[first[chunk]] if len(size) else before
        steps = np.repeat(t["stts"][:, 1], t["stts"][:, 0])
        t["time"] = np.cumsum(steps) - steps
        t["key"] = np.ones(len(size), bool) if t["sync"] is None else np.isin(np.arange(1, len(size) + 1), t["sync"])
        t["clock"], t["trex"] = int(steps.sum()), defaults.get(t["id"], (0, 0, 0))
    by_id = {t["id"]: t for t in found}
    moof, after, open_ = 0, None, None
    for kind, start, at, end in fragments:
        if kind == b"moof":
            moof, after, open_ = start, None, None
        elif kind == b"tfhd":
            open_ = _Fragment(data, at, end, by_id, moof, after if open_ is None else open_.next)
        elif kind in (b"tfdt", b"trun") and open_ is None:
            raise ValueError("fragment without header")
        elif kind == b"tfdt":
            (open_.track["clock"],) = struct.unpack_from(">Q" if data[at] == 1 else ">I", data, at + 4)
        elif kind == b"trun":
            open_.run(data, at, end)
    for t in found:
        for k, name in enumerate(("offset", "size", "time", "key")):
            t[name] = np.concatenate([t[name], *(p[k] for p in t["parts"])])
        if len(t["size"]) and (int(t["offset"].min()) < 0 or int((t["offset"] + t["size"]).max()) > len(data)):
            raise ValueError("samples beyond the end")
        if t["parts"]:
            t["duration"] = max(t["duration"], t["clock"])
    return found


_TRACK = ("codec", "kind", "timescale", "duration", "samples", "key_start", "key_bytes", "key_time")


def probe(data: bytes | None) -> dict:
    """What a table stores of a container. Only index boxes are read."""
    try:
        if not data:
            raise ValueError("no bytes")
        every = []
        for t in tracks(data):
            key = np.flatnonzero(t["key"])
            every.append(dict(zip(_TRACK, (t["codec"], t["kind"], t["timescale"], t["duration"], len(t["size"]), t["offset"][key], t["size"][key], t["time"][key]), strict=True)))
        if not every:
            raise ValueError("no track")
        return {**next((t for t in every if t["kind"] == "vide"), every[0]), "tracks": every, "error": None}
    except (ValueError, KeyError, IndexError, TypeError, struct.error, OverflowError, MemoryError) as e:
        return {**dict.fromkeys(_TRACK[:5]), **{k: [] for k in _TRACK[5:]}, "tracks": [], "error": str(e) or type(e).__name__}


def samples(data: bytes, track: int = 0) -> bytes:
    """The stored bytes of a track, in sample order, by its sample tables."""
    t = tracks(data)[track]
    start, size = t["offset"], t["size"]
    if not len(start):
        return b""
    # samples that lie end to end are read at once
    cut = np.flatnonzero(start[1:] != start[:-1] + size[:-1]) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(start)) - 1
    view = memoryview(data)
    return b"".join(view[start[a] : start[b] + size[b]] for a, b in zip(lo, hi, strict=True))


_PROBE = "codec string, kind string, timescale long, duration long, samples long, key_start array<long>, key_bytes array<long>, key_time array<long>"
_PROBE_ALL = f"{_PROBE}, tracks array<struct<{_PROBE.replace(' ', ': ').replace(',:', ',')}>>, error string"


def mux_column(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with a binary column ``out``: the text's bytes, UTF-8 or not, in a container."""
    out = store.free_name(docs, out)

    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mux(pad(x or b"")))

    return docs.withColumn(out, udf(store.col(text).cast("string").cast("binary")))


def probe_column(df: DataFrame, media: str = "media", out: str = "probe") -> DataFrame:
    """``df`` with a struct column ``out``: codec, duration, keyframe byte ranges."""
    out = store.free_name(df, out)

    @F.pandas_udf(_PROBE_ALL)
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in map(probe, s):
            p["tracks"] = [{k: list(v) if isinstance(v, np.ndarray) else v for k, v in t.items()} for t in p["tracks"]]
            rows.append(p)
        return pd.DataFrame(rows, columns=[*_TRACK, "tracks", "error"]).astype({k: "Int64" for k in ("timescale", "duration", "samples")})

    return df.withColumn(out, udf(store.col(media)))


OP1_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, key_start array<long>, key_bytes array<long>"


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores each text, reads it back and returns digests and what the probe found."""
    store.small_batches(spark)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("key_start", pa.list_(pa.int64())), ("key_bytes", pa.list_(pa.int64()))])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = mux(pad(raw))
                back, p = samples(media), probe(media)
                spans = np.concatenate([p["key_start"], p["key_bytes"]]).astype("<i8").tobytes()
                feature = f"{p['codec'].strip()}:{p['kind']}:{p['timescale']}:{p['duration']}:{p['samples']}:{len(p['key_start'])}:{zlib.crc32(spans):08x}"
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, p["codec"], p["duration"] / p["timescale"], p["key_start"], p["key_bytes"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, OP1_SCHEMA)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, store.read(spark, sf_dir, "documents"))
