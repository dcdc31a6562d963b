"""Binary alignments: a Spark data source that splits, reads and writes blocked-gzip files.

A file is cut at byte offsets. A task finds the first compressed block at or after its
offset and, in what follows, the first place where a chain of records is plausible; a record
belongs to the task in whose part the block with its first byte starts, and is read beyond
the part's end if it has to be. Records are decoded to Arrow batches column by column.

Paths are local ones or URIs of file systems that pyarrow opens (file, hdfs, s3, gs). A
written path is a folder of one file per task, each whole with header and end mark; files
appear when the job commits.
"""

from __future__ import annotations

import re
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "name string, flag int, chr string, pos int, mapq int, cigar string, mate_chr string, mate_pos int, tlen int, seq string, qual string, read_group string"
# fixed values of the format
_CIGAR, _BASES = "MIDNSHP=X", b"=ACMGRSVTWYHKDBN"
_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
_TAG_BYTES = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}
_BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))  # (shift, first bin) of the levels of an index
CHAIN = 8  # plausible records in a row that make a start
LONGEST = 1 << 28  # bytes of a record
ROWS = 10_000  # records of an Arrow batch, and BYTES at most unless one record has more
BYTES = 16 << 20


class Truncated(Exception):
    pass


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of the .bam files of a folder."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(".bam") and f.base_name[0] not in "._")


# --- blocks ----------------------------------------------------------------------------


def _block_size(head: bytes) -> int:
    """Bytes of the block that starts with ``head``; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def block(data: bytes, level: int = 6) -> bytes:
    """One compressed block; without data, the mark that ends a file."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
    return head + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """Blocks from a file offset on, as (offset, data)."""

    def __init__(self, file, at: int):
        self.file, self.at, self.end = file, at, file.size()

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.end:
            self.file.seek(self.at)
            raw = self.file.read(1 << 16)
            n = _block_size(raw)
            if not n or self.at + n > self.end:
                raise Truncated(f"no whole block at {self.at}")
            raw += self.file.read(n - len(raw)) if n > len(raw) else b""
            extra = 12 + struct.unpack_from("<H", raw, 10)[0]
            try:
                data = zlib.decompress(raw[extra : n - 8], -15)
            except zlib.error as e:
                raise Truncated(f"a block that can't be read at {self.at}") from e
            if zlib.crc32(data) != struct.unpack_from("<I", raw, n - 8)[0]:
                raise Truncated(f"a damaged block at {self.at}")
            at, self.at = self.at, self.at + n
            yield at, data


def first_block(file, start: int, end: int) -> int | None:
    """The offset of the first block in [start, end): one that another, or the end, follows."""
    size, step = file.size(), 1 << 18
    for lo in range(start, end, step):
        file.seek(lo)
        raw = file.read(step + (1 << 17))
        for m in re.finditer(rb"\x1f\x8b\x08\x04", raw[: min(step, end - lo) + 3]):
            at, n = m.start(), _block_size(raw[m.start() : m.start() + 1024])
            if n and (lo + at + n == size or (lo + at + n < size and _block_size(raw[at + n : at + n + 1024]))):
                return lo + at
    return None


def header(file) -> tuple[str, list[tuple[str, int]], int, int]:
    """(text, references, block offset of the first record, place in that block)."""
    buf, starts = bytearray(), []
    source = iter(Blocks(file, 0))

    def need(n: int) -> None:
        while len(buf) < n:
            got = next(source, None)
            if got is None:
                raise Truncated("the header ends early")
            starts.append((len(buf), got[0]))
            buf.extend(got[1])

    need(12)
    if buf[:4] != b"BAM\1":
        raise ValueError("no binary alignments")
    n = struct.unpack_from("<i", buf, 4)[0]
    need(12 + n)
    text, at, refs = bytes(buf[8 : 8 + n]).rstrip(b"\0").decode("utf-8", "replace"), 12 + n, []
    for _ in range(struct.unpack_from("<i", buf, 8 + n)[0]):
        need(at + 4)
        k = struct.unpack_from("<i", buf, at)[0]
        need(at + 8 + k)
        refs.append((bytes(buf[at + 4 : at + 3 + k]).decode("utf-8", "replace"), struct.unpack_from("<i", buf, at + 4 + k)[0]))
        at += 8 + k
    place, offset = [s for s in starts if s[0] <= at][-1]
    return text, refs, offset, at - place


# --- records ---------------------------------------------------------------------------


def _next_record(buf: bytes, at: int, n_ref: int) -> int | None:
    """Where the record at ``at`` ends, -1 if there can't be one; None: too few bytes to say."""
    if at + 36 > len(buf):
        return None
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", buf, at)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < n_ref and -1 <= next_ref < n_ref and pos >= -1 and next_pos >= -1 and l_name > 1 and l_seq >= 0 and flag < 4096 and least <= size < LONGEST):
        return -1
    if at + 36 + l_name > len(buf):
        return None
    name = buf[at + 36 : at + 36 + l_name]
    return at + 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else -1


def _candidates(buf: bytes, n_ref: int) -> np.ndarray:
    """Places whose first numbers fit a record."""
    b = np.frombuffer(buf, np.uint8).astype(np.int64)
    n = len(b) - 36
    if n <= 0:
        return np.zeros(0, np.int64)

    def number(k):
        v = b[k : k + n] | b[k + 1 : k + 1 + n] << 8 | b[k + 2 : k + 2 + n] << 16 | b[k + 3 : k + 3 + n] << 24
        return np.where(v >= 1 << 31, v - (1 << 32), v)

    size, ref, next_ref = number(0), number(4), number(24)
    return np.flatnonzero((size >= 34) & (size < LONGEST) & (ref >= -1) & (ref < n_ref) & (next_ref >= -1) & (next_ref < n_ref) & (b[12 : 12 + n] > 1) & (number(8) >= -1))


def first_record(buf: bytes, n_ref: int, last: bool) -> int | None:
    """The first place in ``buf`` where CHAIN records follow each other, or as many as there
    are up to the end if this is the ``last`` of the file; None: more bytes are needed."""
    for at in _candidates(buf, n_ref).tolist():
        end: int | None = at
        for _ in range(CHAIN):
            end = _next_record(buf, end, n_ref)
            if end is None or end == -1 or end == len(buf):
                break
        if end == -1:
            continue
        if end is not None and end <= len(buf) and (end < len(buf) or last):
            return at
        if not last:
            return None
    return None


def _records(file, start: int, end: int, strict: bool) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, starts of records in them) of the part [start, end) of a file."""
    _, refs, offset, place = header(file)
    if start > offset:
        first = first_block(file, start, end)
        if first is None:
            return
        offset, place = first, -1
    if offset >= end:
        return
    source = iter(Blocks(file, offset))
    buf, marks, over, at = bytearray(), [], False, place
    found: list[int] = []

    def more() -> bool:
        nonlocal over
        got = None
        try:
            got = next(source, None)
        except Truncated as e:
            if strict:
                raise
            warnings.warn(f"alignments end early: {e}", stacklevel=2)
        if got is None:
            over = True
            return False
        marks.append((len(buf), got[0]))
        buf.extend(got[1])
        return True

    tried = 0
    while at < 0:  # look for the first record, in twice as many bytes each time
        while more() and len(buf) < 2 * tried:
            pass
        tried = len(buf)
        hit = first_record(bytes(buf), len(refs), over)
        if hit is not None:
            at = hit
        elif over:
            return
    within = 0  # the block that holds the next record's first byte
    while True:
        while at + 4 > len(buf) and more():
            pass
        if at + 4 > len(buf):
            if at < len(buf):
                _early("a record's size is cut", strict)
            break
        while within + 1 < len(marks) and marks[within + 1][0] <= at:
            within += 1
        if marks[within][1] >= end:
            break
        size = struct.unpack_from("<i", buf, at)[0]
        if not 32 <= size < LONGEST:
            _early(f"no record at byte {at} after block {marks[within][1]}", strict)
            break
        while at + 4 + size > len(buf) and more():
            pass
        if at + 4 + size > len(buf):
            _early("the last record is cut", strict)
            break
        found.append(at)
        at += 4 + size
        if len(found) >= ROWS or at >= BYTES:
            yield bytes(buf[:at]), np.array(found, np.int64)
            del buf[:at]
            marks = [(m[0] - at, m[1]) for m in marks[within:]]
            found, at, within = [], 0, 0
    if found:
        yield bytes(buf[:at]), np.array(found, np.int64)


def _early(what: str, strict: bool) -> None:
    if strict:
        raise Truncated(what)
    warnings.warn(f"alignments end early: {what}", stacklevel=3)


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _strings(values: np.ndarray, lengths: np.ndarray, star: np.ndarray | None = None) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.uint8)))
    return text if star is None else pa.compute.if_else(pa.array(star), "*", text)


def _read_group(buf: bytes, at: int, end: int) -> str | None:
    while at + 3 <= end:
        tag, kind = buf[at : at + 2], buf[at + 2]
        at += 3
        if kind in (72, 90):
            stop = buf.find(b"\0", at, end)
            if stop < 0:
                return None
            if tag == b"RG" and kind == 90:
                return buf[at:stop].decode("utf-8", "replace")
            at = stop + 1
        elif kind == 66:
            at += 5 + _TAG_BYTES.get(buf[at], 1) * struct.unpack_from("<I", buf, at + 1)[0]
        elif kind in _TAG_BYTES:
            at += _TAG_BYTES[kind]
        else:
            return None
    return None


def decode(buf: bytes, at: np.ndarray, refs: list[str]) -> pa.RecordBatch:
    """The records at these places as rows of SCHEMA, with the text that a SAM line has."""
    import pyarrow.compute as pc

    raw = np.frombuffer(buf, np.uint8)
    fixed = raw[at[:, None] + np.arange(36)].view(_FIXED).ravel()
    f = {k: fixed[k].astype(np.int64) for k in _FIXED.names}
    names = pa.array([*refs, "*"])

    def named(ref: np.ndarray) -> pa.Array:
        return names.take(pa.array(np.where(ref < 0, len(refs), ref)))

    cigar_at = at + 36 + f["l_name"]
    seq_at = cigar_at + 4 * f["n_cigar"]
    qual_at = seq_at + (f["l_seq"] + 1) // 2
    known: dict[bytes, str] = {b"": "*"}
    cigars = []
    for lo, n in zip(cigar_at.tolist(), (4 * f["n_cigar"]).tolist(), strict=True):
        ops = buf[lo : lo + n]
        if ops not in known:
            known[ops] = "".join(f"{v >> 4}{_CIGAR[v & 15]}" for v in struct.unpack(f"<{n // 4}I", ops))
        cigars.append(known[ops])
    packed = _ragged(raw, seq_at, (f["l_seq"] + 1) // 2)
    halves = np.stack([packed >> 4, packed & 15], 1).ravel()
    first = 2 * (np.cumsum((f["l_seq"] + 1) // 2) - (f["l_seq"] + 1) // 2)
    bases = np.frombuffer(_BASES, np.uint8)[_ragged(halves, first, f["l_seq"])]
    quals = _ragged(raw, qual_at, f["l_seq"])
    none = np.array([raw[p] == 255 if n else True for p, n in zip(qual_at.tolist(), f["l_seq"].tolist(), strict=True)], bool)
    ends = (at + 4 + f["size"]).tolist()
    groups = [_read_group(buf, lo, hi) for lo, hi in zip((qual_at + f["l_seq"]).tolist(), ends, strict=True)]
    mate = pc.if_else(pa.array((f["next_ref"] == f["ref"]) & (f["ref"] >= 0)), "=", named(f["next_ref"]))
    i32 = lambda v: pa.array(v.astype(np.int32))
    columns = [
        _strings(_ragged(raw, at + 36, f["l_name"] - 1), f["l_name"] - 1), i32(f["flag"]), named(f["ref"]), i32(f["pos"] + 1), i32(f["mapq"]), pa.array(cigars, pa.string()),
        mate, i32(f["next_pos"] + 1), i32(f["tlen"]), _strings(bases, f["l_seq"], f["l_seq"] == 0), _strings((quals + 33).astype(np.uint8), f["l_seq"], none), pa.array(groups, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def _bin(begin: int, end: int) -> int:
    for shift, first in _BINS:
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def encode(r: dict, refs: dict[str, int]) -> bytes:
    """One row of SCHEMA as a record."""
    ops = [] if r["cigar"] in (None, "*") else [(int(n), _CIGAR.index(c)) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
    span = sum(n for n, c in ops if _CIGAR[c] in "MDN=X") or 1
    ref = refs.get(r["chr"], -1)
    mate = ref if r["mate_chr"] == "=" else refs.get(r["mate_chr"], -1)
    seq = b"" if r["seq"] in (None, "*") else r["seq"].upper().encode()
    codes = bytes(max(0, _BASES.find(c)) if c in _BASES else 15 for c in seq) + b"\0" * (len(seq) % 2)
    qual = b"\xff" * len(seq) if r["qual"] in (None, "*") else bytes(c - 33 for c in r["qual"].encode())
    if len(qual) != len(seq):
        raise ValueError(f"{r['name']}: {len(seq)} bases and {len(qual)} qualities")
    name = (r["name"] or "*").encode() + b"\0"
    tags = b"" if r["read_group"] is None else b"RGZ" + r["read_group"].encode() + b"\0"
    pos = (r["pos"] or 0) - 1
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), r["mapq"] or 0, _bin(max(0, pos), max(0, pos) + span), len(ops), r["flag"] or 0, len(seq), mate, (r["mate_pos"] or 0) - 1, r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | c) for n, c in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual + tags
    return struct.pack("<i", len(body)) + body


# --- the data source -------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = max(1, int(options.get("splitsize", 64 << 20)))
        self.strict = options.get("stringency", "silent") == "strict"

    def partitions(self) -> list[Part]:
        return [Part(p, lo, min(size, lo + self.split)) for p, size in files(self.path) for lo in range(0, size, self.split)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as file:
            refs = [n for n, _ in header(file)[1]]
            for buf, starts in _records(file, partition.start, partition.end, self.strict):
                yield decode(buf, starts, refs)


@dataclass
class Written(WriterCommitMessage):
    name: str


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.text = options["path"], options.get("header", "")
        self.refs = [(m[1], int(m[2])) for m in re.finditer(r"^@SQ\t(?:[^\n]*\t)?SN:([^\t\n]+)\t(?:[^\n]*\t)?LN:(\d+)", self.text, re.M)]
        self.job = uuid.uuid4().hex

    def _temporary(self, at: str) -> str:
        return f"{at}/_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        fs.create_dir(self._temporary(at), recursive=True)
        ids = {n: k for k, (n, _) in enumerate(self.refs)}
        text = self.text.encode()
        held = bytearray(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs)))
        for n, length in self.refs:
            held += struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
        name = f"part-{uuid.uuid4().hex}.bam"
        with fs.open_output_stream(f"{self._temporary(at)}/{name}") as out:
            for b in iterator:
                for row in b.to_pylist():
                    held += encode(row, ids)
                    while len(held) >= 65_280:
                        out.write(block(bytes(held[:65_280])))
                        del held[:65_280]
            if held:
                out.write(block(bytes(held)))
            out.write(block(b""))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{self._temporary(at)}/{m.name}", f"{at}/{m.name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(self._temporary(at)).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self._temporary(at))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


def read_header(path: str) -> str:
    """The header text of a file, or of a folder's first."""
    fs, at = opened(files(path)[0][0])
    with fs.open_input_file(at) as file:
        text, refs, _, _ = header(file)
    said = set(re.findall(r"^@SQ\t(?:[^\n]*\t)?SN:([^\t\n]+)", text, re.M))
    return text + "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in refs if n not in said)


def ends_whole(path: str) -> bool:
    """Whether a file ends with the mark that only whole files have."""
    fs, at = opened(path)
    mark = block(b"")
    with fs.open_input_file(at) as file:
        file.seek(max(0, file.size() - len(mark)))
        return file.read(len(mark)) == mark


def load(spark: SparkSession, path: str, stringency: str, split_size: int) -> DataFrame:
    """Rows of SCHEMA. Files that were cut give what they hold and a warning; an error if strict."""
    spark.dataSource.register(BamSource)
    cut = [p for p, _ in files(path) if not ends_whole(p)]
    if cut and stringency == "strict":
        raise ValueError(f"alignments end early: {cut}")
    if cut:
        warnings.warn(f"alignments end early, perhaps cut files: {cut}", stacklevel=3)
    return spark.read.format("bam").option("stringency", stringency).option("splitsize", split_size).load(path)


def save(reads: DataFrame, path: str, text: str) -> None:
    reads.sparkSession.dataSource.register(BamSource)
    reads.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.format("bam").mode("append").option("header", text).save(path)
