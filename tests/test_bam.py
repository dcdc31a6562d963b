"""The binary alignment source: parts of any size, cut files, odd records."""

import random
import struct
import warnings

import pytest
from pyspark.sql import functions as F

from strandline.sources import bam, text

REFS = [(f"chr{k}", 100_000_000) for k in range(1, 6)]
NAMES = [c.split()[0] for c in bam.SCHEMA.split(", ")]


def rows(n, seed=1, longest=300):
    r = random.Random(seed)
    out = []
    for k in range(n):
        size = r.choice([0, 1, 50, 75, r.randrange(longest)])
        seq = "".join(r.choice("ACGTN") for _ in range(size)) or "*"
        chr_ = r.choice([*dict(REFS), "*"])
        out.append({
            "name": f"read:{k}", "flag": r.choice([0, 99, 147, 83, 1024 + 99, 4]), "chr": chr_, "pos": 0 if chr_ == "*" else r.randrange(1, 90_000_000), "mapq": r.randrange(61),
            "cigar": f"{size}M" if size and chr_ != "*" else "*", "mate_chr": r.choice(["*"] if chr_ == "*" else ["=", "*"]), "mate_pos": r.randrange(1000), "tlen": r.randrange(-900, 900),
            "seq": seq, "qual": "*" if size == 0 or k % 5 == 0 else "".join(chr(33 + r.randrange(60)) for _ in range(size)), "read_group": r.choice([None, "g1", "g2"]),
        })
    return out


def write(path, records, refs=REFS, block=3000, mark=True, header="@HD\tVN:1.6\n"):
    ids = {n: k for k, (n, _) in enumerate(refs)}
    data = b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", len(refs))
    data += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)
    data += b"".join(bam.encode(r, ids) for r in records)
    raw = b"".join(bam.block(data[k : k + block]) for k in range(0, len(data), block)) + (bam.block(b"") if mark else b"")
    path.write_bytes(raw)
    return raw


def parts(path, step, strict=True):
    reader = bam.BamReader({"path": str(path), "splitsize": str(step), "stringency": "strict" if strict else "silent"})
    return [[r for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]


@pytest.mark.parametrize("block", [300, 3000, 60_000])
def test_every_record_is_in_one_part(tmp_path, block):
    want = rows(900)
    size = len(write(tmp_path / "a.bam", want, block=block))
    for step in (size + 1, size // 2, size // 7, 997, 4001):
        got = parts(tmp_path / "a.bam", step)
        assert [r for p in got for r in p] == want
        assert len(got) == -(-size // step)


def test_records_longer_than_parts_and_headers_of_many_blocks(tmp_path):
    refs = [(f"contig_{k:05}", 1000 + k) for k in range(4000)] + REFS
    want = rows(40, 3, 60_000)
    write(tmp_path / "a.bam", want, refs, block=700)
    assert [r for p in parts(tmp_path / "a.bam", 9000) for r in p] == want
    write(tmp_path / "b.bam", [], refs, block=700)
    assert [r for p in parts(tmp_path / "b.bam", 9000) for r in p] == []


def test_cut_files_give_what_they_hold(tmp_path):
    want = rows(500, 5)
    raw = write(tmp_path / "a.bam", want, mark=False)
    for cut in (len(raw) - 1, len(raw) - 2000, len(raw) // 2, len(raw)):
        (tmp_path / "a.bam").write_bytes(raw[:cut])
        assert not bam.ends_whole(str(tmp_path / "a.bam"))
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            got = [r for p in parts(tmp_path / "a.bam", 5000, strict=False) for r in p]
        assert got == want[: len(got)] and (cut == len(raw)) == (len(got) == len(want))
        assert cut == len(raw) or any("end early" in str(w.message) for w in said)
        if cut < len(raw):
            with pytest.raises(bam.Truncated):
                parts(tmp_path / "a.bam", 1 << 20)


def test_places_that_look_like_records_are_passed_over(tmp_path):
    """Bases and qualities that hold whole records of their own."""
    inner = bam.encode(rows(1, 8)[0], dict(zip(dict(REFS), range(5), strict=True)))
    want = rows(300, 9)
    for r in want[::3]:
        n = len(inner)
        r["seq"], r["qual"], r["cigar"] = "A" * n, "".join(chr(33 + min(93, c)) for c in inner), "*"
    write(tmp_path / "a.bam", want, block=500)
    assert [r for p in parts(tmp_path / "a.bam", 800) for r in p] == want


def test_text_and_binary_files_give_equal_tables(spark, tmp_path):
    want = rows(3000, 2)
    write(tmp_path / "one.bam", want, header="@HD\tVN:1.6\n@RG\tID:g1\tLB:l1\tPL:ILLUMINA\n")
    lines = ["@HD\tVN:1.6", "@RG\tID:g1\tLB:l1\tPL:ILLUMINA", *[f"@SQ\tSN:{n}\tLN:{v}" for n, v in REFS]]
    lines += ["\t".join(str(r[k]) for k in NAMES[:-1]) + (f"\tNM:i:3\tRG:Z:{r['read_group']}" if r["read_group"] else "") for r in want]
    (tmp_path / "one.sam").write_text("\n".join(lines) + "\n")
    binary = text.read_bam(spark, str(tmp_path / "one.bam"), split_size=20_000)
    plain = text.read_sam(spark, str(tmp_path / "one.sam"))
    assert binary[0].rdd.getNumPartitions() >= 4
    for a, b in zip(binary, plain, strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    with pytest.warns(UserWarning, match="end early"):
        (tmp_path / "cut.bam").write_bytes((tmp_path / "one.bam").read_bytes()[:-40])
        assert 0 < text.read_bam(spark, str(tmp_path / "cut.bam"))[0].count() < 3000
    with pytest.raises(ValueError):
        text.read_bam(spark, str(tmp_path / "cut.bam"), "strict")


def test_written_folders_hold_whole_files(spark, tmp_path):
    want = rows(400, 4)
    df = spark.createDataFrame([tuple(r[k] for k in NAMES) for r in want], bam.SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    text.write_bam(df, path, REFS, [("g1", "l1")])
    assert len(bam.files(path)) == 3 and all(bam.ends_whole(p) for p, _ in bam.files(path))
    reads, groups, refs = text.read_bam(spark, path)
    assert sorted(map(tuple, reads.select(*NAMES).collect()), key=str) == sorted((tuple(r[k] for k in NAMES) for r in want), key=str)
    assert [tuple(r) for r in refs.collect()] == REFS and groups.count() == 1
    empty = str(tmp_path / "none")
    text.write_bam(df.limit(0), empty, REFS)
    assert text.read_bam(spark, empty)[0].count() == 0
    with pytest.raises(Exception, match="qualities"):
        text.write_bam(df.withColumn("qual", F.lit("II")).withColumn("seq", F.lit("ACG")), str(tmp_path / "bad"), REFS)


def test_bins_of_positions():
    assert [bam._bin(*k) for k in ((0, 1), (16383, 16385), (0, 1 << 26), (1 << 26, (1 << 26) + 5))] == [4681, 585, 1, 4681 + (1 << 12)]
