"""Operators on whole texts: edge cases, brute force, round trips."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import html, licenses, media, mixing, near, packing, pii, quality, rollups, store, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, tid string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def table(spark, texts):
    """Documents with clashing extra columns; texts are (id, text) or texts."""
    rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], DOCS)


EDGE = [None, "", " \t\n", "a", "naïve — ✓ 日本語 \U0001f600", "word " * 30_000, "x" * 70_000, "same text here", "same text here", (None, "no id"), (7, "repeated"), (7, "repeated")]


# --- media -----------------------------------------------------------------------------


def test_media_round_trip_and_digests(spark):
    rows = media.digests(spark, table(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    by_id = {r["doc_id"]: r for r in rows}
    for k, t in enumerate(EDGE[:7]):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by_id[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:])) or k == 7
        m = media.mux(want)
        assert r["media_sha256"] == hashlib.sha256(m).hexdigest() and media.samples(m) == want
        assert r["duration_s"] == len(want) / 8000 and sum(r["key_bytes"]) == 64 * -(-len(want) // 1024)
        for a, n in zip(r["key_start"], r["key_bytes"]):
            assert m[a : a + n] in want
    assert media.digests(spark, table(spark, [])).count() == 0


def test_media_columns_and_damage(spark):
    df = media.probe_column(media.mux_column(table(spark, ["hello", None])), "media")
    got = df.select("doc_id", "probe.codec", "probe.samples", "probe.error").collect()
    assert [tuple(r) for r in got] == [(0, "raw ", 1, None), (1, "raw ", 1, None)]
    m = media.mux(media.pad(b"q" * 5000))
    for bad in (None, b"", b"abc", m[:40], m[:300], m[:-10], b"\0" * 64, m.replace(b"stsz", b"free")):
        p = media.probe(bad)
        assert p["error"] and p["codec"] is None
    r = random.Random(1)
    for _ in range(300):
        b = bytearray(m)
        b[r.randrange(700)] = r.randrange(256)
        media.probe(bytes(b))  # never raises


def test_media_column_of_bytes_that_are_no_text(spark):
    df = media.mux_column(invalid(spark, b"\xff\xfe", b"").withColumn("a.b", F.lit(1)))
    assert [media.samples(bytes(r["media"]))[:2] for r in df.orderBy("doc_id").collect()] == [b"\xff\xfe", b"\0\0"]


def test_media_reads_other_layouts():
    """Index after the data, listed sizes, 64-bit offsets, 64-bit box size, two chunks."""
    box = media._box
    data = bytes(range(1, 31))
    ftyp = box(b"ftyp", b"isom" + bytes(4))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    first = len(ftyp) + 16
    full = media._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 20)), full(b"stss", struct.pack(">II", 1, 2)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 10, 15)), full(b"co64", struct.pack(">IQQ", 2, first, first + 15)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 40, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", stbl))
    m = ftyp + mdat + box(b"moov", box(b"trak", mdia))
    p = media.probe(m)
    assert (p["codec"], p["kind"], p["timescale"], p["duration"], p["samples"], p["error"]) == ("avc1", "vide", 1000, 40, 3, None)
    assert (list(p["key_start"]), list(p["key_bytes"]), list(p["key_time"])) == ([first + 5], [10], [10])
    assert media.samples(m) == data


def fragmented():
    """An audio track and a video track whose samples lie in two movie fragments."""
    box, full = media._box, media._full
    empty = [full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")] + [full(b"stsz", bytes(8))]

    def trak(n, codec, kind):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(78))), *empty)
        return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, n, 0, 0), bytes(60)), box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", stbl)))

    trex = [full(b"trex", struct.pack(">5I", n, 1, 10 * n, 0, 0x10000 if n == 2 else 0)) for n in (1, 2)]
    head = box(b"ftyp", b"iso5" + bytes(4)) + box(b"moov", trak(1, b"mp4a", b"soun"), trak(2, b"avc1", b"vide"), box(b"mvex", *trex))
    out, want = head, []
    for part in range(2):
        def moof(offset):
            audio = box(b"traf", full(b"tfhd", struct.pack(">II", 1, 5), flags=0x20010), full(b"tfdt", struct.pack(">I", 20 * part)), full(b"trun", struct.pack(">Ii", 2, offset), flags=0x1))
            video = box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">IiI", 3, offset + 10, 0), struct.pack(">3I", 7, 8, 9), flags=0x205))
            return box(b"moof", full(b"mfhd", struct.pack(">I", part + 1)), audio, video)

        size = len(moof(0))
        data = bytes(range(40 * part, 40 * part + 34))
        want.append((len(out) + size + 8, data))
        out += moof(size + 8) + box(b"mdat", data)
    return out, want


def test_media_fragments_and_all_tracks(spark):
    m, want = fragmented()
    p = media.probe(m)
    first = [at + 10 for at, _ in want]
    assert (p["error"], p["codec"], p["samples"], p["duration"], list(p["key_start"]), list(p["key_bytes"]), list(p["key_time"])) == (None, "avc1", 6, 120, first, [7, 7], [0, 60])
    assert [(t["codec"], t["samples"], t["duration"], len(t["key_start"])) for t in p["tracks"]] == [("mp4a", 4, 40, 4), ("avc1", 6, 120, 2)]
    assert media.samples(m, 0) == b"".join(d[:10] for _, d in want) and media.samples(m, 1) == b"".join(d[10:] for _, d in want)
    df = spark.createDataFrame([(1, bytearray(m), "x"), (2, None, "x")], "id int, media binary, probe string")
    got = {r["id"]: r["_probe"] for r in media.probe_column(df).collect()}
    assert [t["codec"] for t in got[1]["tracks"]] == ["mp4a", "avc1"] and got[1]["tracks"][1]["key_start"] == first and got[2]["error"]


def test_media_damage_of_any_kind():
    import tracemalloc

    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert "deep" in media.probe(deep)["error"]
    m = media.mux(media.pad(b"q" * 70_000))
    at = m.index(b"stsc") + 12
    forged = m[:at] + struct.pack(">I", 0) + m[at + 4 : at + 12] + struct.pack(">I", 0x7FFFFFFF) + m[at + 16 :]
    tracemalloc.start()
    assert media.probe(forged)["error"]
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    r = random.Random(4)
    for whole in (m[:2000], fragmented()[0], media.mux(media.pad(b"z" * 3000))):
        for _ in range(1500):
            b = bytearray(whole)
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(b))
                b[k : k + 4] = r.choice([b"\xff\xff\xff\xff", b"\0\0\0\0", r.randbytes(4), b"\x80\0\0\0"])
            media.probe(bytes(b[: r.choice([len(b), r.randrange(len(b))])]))  # never raises


# --- tokens ----------------------------------------------------------------------------


def test_token_ids_equal_the_file():
    r = random.Random(5)
    tok = tokens.WordTokenizer(tokens.default_path(), cache=500)
    texts = [prose(r, 80) for _ in range(30)] + [t for t in EDGE if isinstance(t, str)] + ["It's O'Neill's; don't!! ''s 12a3 ÀÉß ĲŁ İstanbul Σας ΑΣ  x\u0085y\x1cz Å <|endoftext|>", "!!!...---///''''", "á é"]
    alphabet = "abcXYZéßñÖ0123'!?.,- \n\tŁž²½ªİΣ日́"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert tok.encode(t) == np.array(tok.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_added_tokens_are_the_file_s():
    from tokenizers import Tokenizer

    tok, plain = tokens.WordTokenizer(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for t in ("a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a<|ENDOFTEXT|>", "<|endoftext", "é <|endoftext|> 日"):
        assert tok.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert np.frombuffer(tok.encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


# --- licenses --------------------------------------------------------------------------


def test_license_matches(spark):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("merge, publish", "merge and then publish").replace("free of charge", "free")
    texts = [f"intro {mit} outro", f"A. {changed} B.", "Released under the MIT License. Later: RELEASED under the MIT license!", "the license of this work", None, "", mit[: len(mit) // 2]]
    got = licenses.find(spark, table(spark, texts)).collect()
    found = sorted((r["doc_id"], r["license"]) for r in got)
    assert found == [(0, "mit"), (1, "mit"), (2, "mit-notice"), (2, "mit-notice")]
    whole = next(r for r in got if r["doc_id"] == 0)
    assert whole["coverage"] == 1.0 and texts[0][whole["start"] : whole["end"]].startswith("Permission is") and whole["end"] == len(texts[0]) - len(". outro")
    part = next(r for r in got if r["doc_id"] == 1)
    assert 0.95 < part["coverage"] < 1
    assert licenses.find(spark, table(spark, [])).count() == 0


def test_license_places_templates_and_bytes(spark):
    notice = "Released under the MIT License."
    t = "İstanbul " * 5 + notice
    every = {f"{n} text": n for n in licenses.TEMPLATES}
    texts = [t, *(f"x y {licenses.TEMPLATES[n]} z" for n in every.values())]
    got: dict = {}
    for r in licenses.find(spark, table(spark, texts + texts[:1])).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [t[r["start"] : r["end"]] for r in got[0]] == [notice[:-1]] and len(got[len(texts)]) == 1
    for k, n in enumerate(every.values()):
        whole = [r["license"] for r in got[k + 1] if r["coverage"] == 1.0]
        assert n in whole, n
    b = licenses.find(spark, invalid(spark, b"\xff Released under the MIT License \xfe")).collect()
    assert [(r["start"], r["end"]) for r in b] == [(2, 32)]


def brute_matches(text, coverage=licenses.COVERAGE):
    """Templates that some stretch of a text matches: full alignment tables, no index or band."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    out = set()
    for name, template in licenses.TEMPLATES.items():
        w = [x.lower() for x in re.findall(r"[^\W_]+", template)]
        prev, best = [(0, 0)] * (len(words) + 1), (0, 0)
        for a in w:
            row = [(0, 0)]
            for j, x in enumerate(words):
                d = prev[j]
                cell = max((d[0] + 2, d[1] + 1) if a == x else (d[0] - 2, d[1]), (prev[j + 1][0] - 2, prev[j + 1][1]), (row[j][0] - 2, row[j][1]), (0, 0))
                row.append(cell)
                best = max(best, cell)
            prev = row
        if best[1] >= coverage * len(w):
            out.add(name)
    return out


def test_license_scan_against_brute_force(spark):
    """Texts with whole, changed, cut and no license texts: the same licenses, but for those
    that lie inside a longer match, which are reported as that."""
    r = random.Random(17)
    texts = []
    for n, t in licenses.TEMPLATES.items():
        w = t.split()
        if len(w) > 120:
            continue
        for share in (0.0, 0.05, 0.5):
            texts.append(" ".join([prose(r, 10), *(r.choice(WORDS) if r.random() < share else x for x in w), prose(r, 10)]))
    texts += [prose(r, 80) for _ in range(5)]
    got: dict = {}
    for x in licenses.find(spark, table(spark, texts)).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for k, t in enumerate(texts):
        want, have = brute_matches(t), {x["license"] for x in got.get(k, [])}
        assert have <= want and bool(have) == bool(want)


def test_license_alignment_against_full_table():
    """The band finds the best local score wherever the best alignment stays inside it."""
    r = random.Random(7)
    for _ in range(60):
        t = np.array([r.randint(0, 400) for _ in range(40)], np.uint64)
        text = list(t)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice([[], [np.uint64(999)], [text[k], np.uint64(998)]])
        pad = [np.uint64(1000 + k) for k in range(r.randint(0, 20))]
        x = np.array(pad + text + pad, np.uint64)
        h = np.zeros((len(t) + 1, len(x) + 1), int)
        for i in range(len(t)):
            for j in range(len(x)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if t[i] == x[j] else -2), h[i, j + 1] - 2, h[i + 1, j] - 2)
        assert licenses.align(t, x, len(pad))[0] == h.max()


def cell_by_cell(template, text, diagonal, band):
    """The banded local alignment, one cell at a time."""
    cells, best = {}, (0, 0, 0, 0)
    for i in range(len(template)):
        for k in range(2 * band + 1):
            j = i + diagonal + k - band
            if not 0 <= j < len(text):
                continue
            d = cells.get((i - 1, j - 1), (0, 0, -1))
            now = (d[0] + 2, d[1] + 1, d[2] if d[0] else j) if template[i] == text[j] else (d[0] - 2, *d[1:])
            for other in [cells.get((i - 1, j), (0, 0, -1)) if k < 2 * band else (0, 0, -1), cells.get((i, j - 1), (0, 0, -1)) if k else (0, 0, -1)]:
                if other[0] - 2 > now[0]:
                    now = (other[0] - 2, *other[1:])
            cells[i, j] = now if now[0] > 0 else (0, 0, -1)
            if now[0] > best[0]:
                best = (*now, j + 1)
    return best


def test_license_alignments_in_step_equal_those_cell_by_cell():
    r = random.Random(8)
    for letters in (2, 3, 40):
        for _ in range(25):
            t = np.array([r.randint(0, letters) for _ in range(r.randint(3, 30))], np.uint64)
            x = np.array([r.randint(0, letters) for _ in range(r.randint(1, 60))], np.uint64)
            band = r.randint(1, 8)
            at = np.arange(-len(t) - 2, len(x) + 3)
            assert [tuple(b) for b in licenses.align_all(t, x, at, band).tolist()] == [cell_by_cell(t, x, d, band) for d in at.tolist()]


def test_many_license_headers_in_one_text():
    names, text = [], ""
    for k in range(300):
        name = ("gpl-3.0-header", "gpl-2.0-header", "mpl-2.0-header")[k % 3]
        names.append(name)
        text += f" file {k} " + licenses.TEMPLATES[name]
    start = time.monotonic()
    found = licenses.scan(text, licenses.Index(licenses.TEMPLATES), licenses.Words())
    assert time.monotonic() - start < 10
    assert [f[0] for f in found] == names and all(f[5] == 1.0 for f in found)


def test_matches_that_overlap_no_better_one_stay():
    r = random.Random(9)
    for _ in range(50):
        rows = [(0, a, a + r.randint(1, 9), k) for k, a in enumerate(r.choices(range(60), k=30))]
        kept = []
        for row in rows:
            if all(row[2] <= k[1] or row[1] >= k[2] for k in kept):
                kept.append(row)
        assert licenses._apart(rows) == sorted(kept, key=lambda k: k[1])


def test_license_columns_with_clashing_names(spark):
    docs = table(spark, ["x " + licenses.TEMPLATES["isc"]]).withColumn("license", F.lit("l")).withColumn("start", F.lit("s")).withColumn("a.b", F.lit(1))
    assert [(r["doc_id"], r["license"]) for r in licenses.find(spark, docs).collect()] == [(0, "isc")]


def test_winnowing_guarantee():
    r = random.Random(8)
    for _ in range(100):
        x = np.array([r.randint(0, 5) for _ in range(r.randint(1, 30))], np.uint64)
        kept = set(licenses.winnow(x).tolist())
        for k in range(len(x) - licenses.WINDOW + 1):
            own = range(k, k + licenses.WINDOW)
            assert any(p in kept and x[p] == min(x[q] for q in own) for p in own)
    with pytest.raises(ValueError):
        licenses.Index({"short": "two words"})


# --- quality ---------------------------------------------------------------------------


def test_quality_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = store.read(spark, sf, "documents"), store.read(spark, sf, "labels")
    model = quality.train(spark, docs, labels)
    got = quality.score(spark, docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    out = [(r["quality"], r["score"], r["predicted"]) for r in got if quality.held_out(r["doc_id"])]
    good, bad = [s for q, s, _ in out if q == 1], [s for q, s, _ in out if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([p == q for q, _, p in out]) > 0.9
    edge = quality.score(spark, table(spark, EDGE), model, out=("score_", "predicted")).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score_"] <= 1 and r["predicted"] == (r["score_"] >= 0.3) for r in edge)
    assert all(r["score"] == "x" for r in edge)  # a clashing column stays
    empty = quality.train(spark, docs.limit(0), labels)
    assert {r["score"] for r in quality.score(spark, table(spark, ["a", None]), empty, ["doc_id"]).collect()} == {0.5}


def test_quality_learns_nothing_from_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = store.read(spark, sf, "documents"), store.read(spark, sf, "labels")
    flipped = labels.withColumn("quality", F.when(quality.id_crc(F.col("doc_id")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(spark, docs, labels), quality.train(spark, docs, flipped)
    assert a == b
    assert quality.keep_good(spark, docs, labels).columns == docs.columns


def test_quality_one_long_text_leaves_the_others(spark, monkeypatch):
    """A labelled text beyond the byte budget takes no other text's place, and is seen to its end."""
    r = random.Random(4)
    texts = [(k, prose(r, 60)) for k in range(1, 60)]
    long = min((k for k, _ in texts if zlib.crc32(str(k).encode()) % 5), key=lambda k: zlib.crc32(str(k).encode()))
    texts = [(k, "start " * 20_000 + "middle " * 20_000 + "final " * 20_000 if k == long else t) for k, t in texts]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows))
    quality.train(spark, table(spark, texts), labels, max_bytes=60_000)
    rows = {crc: data for crc, data, _ in seen[0]}
    for k, t in texts:
        crc = zlib.crc32(str(k).encode())
        if crc % 5:
            data = rows.pop(crc)
            assert data == t.encode() if k != long else all(w in data for w in (b"start", b"middle", b"final"))
    assert not rows and sum(len(d) for _, d, _ in seen[0]) <= 60_000


def test_quality_scores_are_calibrated(spark):
    """On held-out rows, a score is about the share of good texts among those that have it."""
    sf = "/root/testdata/sf0.1"
    docs, labels = store.read(spark, sf, "documents"), store.read(spark, sf, "labels")
    model = quality.train(spark, docs, labels)
    held = docs.join(labels.select("doc_id", "quality"), "doc_id").where(quality.id_crc(F.col("doc_id")) % 5 == 0)
    got = np.array([(quality_, model.score(t.encode())) for t, quality_ in held.select("text", "quality").collect()])
    assert abs(got[:, 0].mean() - got[:, 1].mean()) < 0.03
    order = np.argsort(got[:, 1])
    for part in np.array_split(order, 5):
        assert abs(got[part, 0].mean() - got[part, 1].mean()) < 0.08
    good, bad = got[got[:, 0] == 1, 1], got[got[:, 0] == 0, 1]
    assert np.mean(good[:, None] > bad[None]) > 0.97 and np.mean((got[:, 1] >= 0.3) == got[:, 0]) > 0.95


def test_quality_of_repeated_ids_and_labels(spark):
    """Two texts and two labels of one id, rows twice: one text for each label is learned from."""
    r = random.Random(9)
    texts = [(k, prose(r, 50)) for k in range(1, 40)]
    docs = table(spark, texts + texts + [(k, prose(r, 50)) for k, _ in texts])
    labels = spark.createDataFrame([(k, q) for k, _ in texts for q in (0, 1)] * 2, "doc_id long, quality int")
    seen = []
    quality.fit, fit = lambda rows: seen.append(rows), quality.fit
    try:
        quality.train(spark, docs, labels)
    finally:
        quality.fit = fit
    want = [(zlib.crc32(str(k).encode()), q) for k, _ in texts for q in (0, 1) if zlib.crc32(str(k).encode()) % 5]
    assert sorted((crc, q) for crc, _, q in seen[0]) == sorted(want)


# --- rollups ---------------------------------------------------------------------------


def test_rollup_commits(spark, tmp_path):
    kind = "kind string, source string, lang string, version string, tokens long, prev_tokens long"

    def batch(*rows):
        return spark.createDataFrame(rows, kind)

    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    first = batch(("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", None, None))
    assert roll.commit("b1", first) and not roll.commit("b1", first)
    assert roll.commit("b2", batch(("revise", "a", "en", "v1", 9, 5), ("delete", "a", "en", "v1", None, 7), ("insert", "b", "de", "v2", 3, None)))
    assert roll.commit("b3", batch())

    def totals():
        return sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in roll.totals().collect())

    want = [("None", "None", "v1", 1, 0), ("a", "en", "v1", 1, 9), ("b", "de", "v2", 1, 3)]
    assert totals() == want
    with pytest.raises(Exception, match="unknown kind"):
        roll.commit("b4", batch(("upsert", "a", "en", "v1", 1, 1)))
    assert totals() == want and roll.committed() == ["b1", "b2", "b3"]
    assert roll.compact() and not roll.compact()
    assert totals() == want and roll.committed() == ["b1", "b2", "b3"] and not roll.commit("b2", first)
    assert roll.commit("no/slash", first) and roll.commit("c1", batch())
    assert roll.vacuum(0) > 0 and len(roll.committed()) == 5
    with pytest.raises(ValueError):
        roll.commit("", first)


def test_rollup_committers_at_once(spark, tmp_path, monkeypatch):
    """Of committers of one id one counts, of different ids all, and of two compactions one;
    whole states in the log are read as well as single entries."""
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(rollups, "FULL", 4)
    one = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], "kind string, source string, lang string, version string, tokens long, prev_tokens long")
    roll = rollups.Rollup(spark, f"file://{tmp_path}/r")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda k: rollups.Rollup(spark, roll.path).commit(k, one), ["x", "x", "y", "x", "z", "y", *"abcdef"]))
    assert sum(done) == 9 and roll.committed() == sorted([*"xyz", *"abcdef"])
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 9, 45)]
    with ThreadPoolExecutor(2) as pool:
        folded = list(pool.map(lambda _: rollups.Rollup(spark, roll.path).compact(), range(2)))
    assert any(folded) and [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v1", 9, 45)]
    # an entry that another made in between is seen, whatever this one believed
    last, folders, ids = roll._state()
    assert roll._append(last + 1, (folders, ids), [], [], ["late"]) and not roll._append(last + 1, (folders, ids), [], [], ["later"])
    assert "late" in roll.committed() and "later" not in roll.committed()
    # a commit lost before its entry leaves nothing that counts
    monkeypatch.setattr(roll, "_append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        roll.commit("lost", one)
    monkeypatch.undo()
    assert "lost" not in roll.committed() and roll.totals().first()["tokens"] == 45 and roll.commit("lost", one)


def test_tokens_of_bytes_that_are_no_text(spark):
    tok = tokens.WordTokenizer(tokens.default_path())
    n = len(tok.encode("a \ufffd b")) // 4
    docs = invalid(spark, b"a \xff b")
    assert rollups.counted(docs, tokens.default_path()).first()["n_tokens"] == n
    assert packing.pack(spark, docs).first()["length"] == n + 1


def test_rollup_query_against_counts(spark):
    sf = "/root/testdata/sf0.001"
    tok = tokens.WordTokenizer(tokens.default_path())
    want: dict = {}
    for r in store.read(spark, sf, "documents").collect():
        n = len(tok.whole.encode(r["text"], add_special_tokens=False).ids)
        for v, k in (("migrated", n), ("word_bpe_49k-1", n), ("words-1", 0)):
            d, t = want.get((r["source"], r["lang"], v), (0, 0))
            want[r["source"], r["lang"], v] = (d + (v != "words-1"), t + k)
    got = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollups.op5_token_counts(spark, sf).collect()}
    assert got == want


# --- html ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) x("</p>")</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One  <b>bold</b>text<br>next<p>Two &lt;3 &eacute;&nbsp;x<!-- c --><div class="ad">Buy</div><form><input>Name</form>
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><div id="comments"><p>First!</p></div><aside>Side</aside><footer>&copy;</footer></body></html>"""


def test_html_extraction(spark):
    want = "Head & line One boldtext next Two <3 é x a b c d"
    assert html.main_text(html.parse(PAGE)) == want
    assert html.main_text(html.parse("<body><p>no article</p><nav>x</nav>tail")) == "no article tail"
    assert html.main_text(html.parse("a < b & c &unknown; <notatag")) == "a < b & c &unknown; <notatag"
    for p in ("", "<", "</p>", "<article>", "<p" * 500, "<div>" * 3000 + "deep" + "</div>" * 3000, "<script>x", "<!-- open", "<a href='x>y"):
        html.main_text(html.parse(p))
    pages = spark.createDataFrame([(1, "http://h/a", PAGE, "t"), (2, None, None, "t"), (3, "bad url", "", "t"), (1, "http://h/a", PAGE, "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(spark, pages).collect())
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert html.extract(spark, pages.limit(0)).count() == 0


def test_html_rules_by_whole_class_names():
    def text(page):
        return html.main_text(html.parse(page))

    assert text('<div class="layout has-sidebar"><article><p>Text</p></article></div>') == "Text"
    assert text('<div class="page with-sidebar"><div class="sidebar-left">Links</div><p>Text</p></div>') == "Text"
    assert text('<div class="sidebar-grid"><main><p>Text</p></main></div>') == "Text"
    assert text('<article><div class="article-header"><h1>Head</h1></div><p>Text</p></article>') == "Head Text"
    assert text('<article><header><h1>Head</h1></header><p>Text</p><footer>By me</footer></article>') == "Head Text"
    assert text('<header><h1>Site</h1></header><article><p>Text</p></article>') == "Text"
    assert text('<article><p>Text</p></article><article class="comment"><p>First!</p></article>') == "Text"
    assert text('<article><p>Text</p><section id="comments"><article><p>First!</p></article></section></article>') == "Text"
    assert text('<article><p>Text</p></article><div class="related-posts"><article>Other</article></div>') == "Text"
    assert text('<p>Text</p><div class="site-header">S</div><div class="newsletter-signup">N</div><div id="cookie_banner">C</div>') == "Text"


def test_html_words_and_forms_around_the_text():
    """A word of a class that also means something else deletes nothing, and neither a
    classed wrapper nor a form takes the text of the page with it."""
    body = "<p>The whole text of the page, of several words.</p>"
    want = "The whole text of the page, of several words."
    for wrap in ('<form runat="server"><article>%s</article></form>', '<form runat="server"><div>%s</div></form>', '<div class="cookie-recipe">%s</div>', '<div class="recommended-reading">%s</div>', '<div id="widget-1">%s</div>', '<div class="related">%s</div>', '<div class="banner"><form>%s</form></div>'):
        page = "<html><body><nav><p>Long lists of places to go to, all over this site and others</p></nav>" + wrap % body + '<div class="cookie-notice">Cookies!</div></body></html>'
        assert html.main_text(html.parse(page)) == want, wrap
    inside = '<article><p class="share-price">One</p><section class="header-study">Two</section><div class="share-buttons">x</div><div class="article-comments">y</div><div class="site-header">z</div></article>'
    assert html.main_text(html.parse(inside)) == "One Two"
    # beside other text, and with comments however long, they go
    assert html.main_text(html.parse(f'{body}<form>Your name and street</form><div class="widget">w</div><div class="comments">{body * 9}</div>')) == want
    assert html.main_text(html.parse(f'<article>{body}</article><div class="related">{body * 9}</div><form>{body * 9}</form>')) == want
    assert html.main_text(html.parse("<form></form>")) == ""


def test_html_parsing_takes_linear_time():
    import time

    for piece in ("<a ", '<a "', "<a '", "<!-- ", "<div>", "<div></span>", "<td>", "<b><div></b>", "<script>", "</p>", "&amp", "<li><div>", "<![CDATA[", "<p <"):
        start = time.perf_counter()
        html.main_text(html.parse(piece * (1_000_000 // len(piece))), frozenset([1]), {})
        assert time.perf_counter() - start < 20, piece
    start = time.perf_counter()
    html.parse("<a " * 333_333)
    assert time.perf_counter() - start < 2
    assert html.main_text(html.parse("x <a href='y>z</a> w")) == "x z w"


@pytest.mark.parametrize("rows", [100_000, 0])
def test_html_templates_by_shape(spark, rows):
    """Menus that name other things on every page, without any telling name, are one shape of
    a host; link lists of the article stay, as do other hosts' few pages and article passages."""
    r = random.Random(12)

    def page(k, passage=""):
        own = prose(r, 9)
        menu = "".join(f'<span class="x{k % 3}"><a href="/{w}">{w}</a></span>' for w in prose(r, r.randint(3, 7)).split())
        refs = "".join(f"<li><a href='#'>{w}</a></li>" for w in ("one", "two", "three"))
        return f"<body><div class='q1'>{menu}</div><article><p>{passage}{own}</p><ul>{refs}</ul></article></body>", f"{passage}{own} one two three"

    same = prose(r, 60) + " "
    pages = [(k, "http://big.example/", *page(k, same if k % 10 == 0 else "")) for k in range(300)] + [(1000, "http://b.example/", *page(1000))]
    # without an article element, all else is the text
    pages = [(i, u, h.replace("article>", "section>"), t) if i % 2 else (i, u, h, t) for i, u, h, t in pages]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html.extract(spark, df, broadcast_rows=rows).collect()}
    for i, u, h, t in pages:
        if i == 1000:
            assert got[i] == t
        elif i % 2:  # a third of the pages share a shape of classes; the list is in no article
            assert got[i] == t.removesuffix(" one two three")
        else:
            assert got[i] == t


def test_html_of_bytes_that_are_no_text(spark):
    pages = spark.sql("select 1L as page_id, 'http://h/' as url, cast(unhex('3C703E61FF623C2F703E') as string) as html")
    assert [r["text"] for r in html.extract(spark, pages).collect()] == ["a\ufffdb"]


@pytest.mark.parametrize("rows", [100_000, 0])
def test_html_templates(spark, rows):
    """Boxes that recur over a host's different pages go, by either join; copies stay."""
    r = random.Random(3)
    pages = [(k, f"http://Big.example/{k}", f"<body><div><p>Promo of the site</p></div><div><p>{prose(r, 12)}</p></div></body>") for k in range(20)]
    pages += [(100 + k, "http://copies.example/", "<body><div><p>The very same article</p></div></body>") for k in range(30)]
    pages += [(200, "http://other.example/", "<body><div><p>Promo of the site</p></div></body>")]
    got = {x["page_id"]: x["text"] for x in html.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_rows=rows).collect()}
    for k, _, page in pages[:20]:
        assert got[k] == re.findall("<p>(.*?)</p>", page)[1]
    assert got[100] == got[129] == "The very same article" and got[200] == "Promo of the site"


@pytest.mark.parametrize("rows", [100_000, 0])
def test_html_templates_of_small_hosts_and_small_shares(spark, rows):
    """A host of six pages has a template, and so has a notice on 20 % of many pages; what
    is short and recurs in articles stays, as does what one other page has."""
    r = random.Random(6)
    notice = "This site is kept up by its readers, who pay for it"
    own = {k: prose(r, 12) for k in range(1100)}

    def page(k, boxes):
        return "<body>" + "".join(f"<div><p>{b}</p></div>" for b in (*boxes, own[k])) + "</body>"

    pages = [(k, "http://small.example/", page(k, [notice])) for k in range(6)]
    pages += [(k, "http://two.example/", page(k, [notice])) for k in (6, 7)]
    pages += [(k, "http://big.example/", page(k, [notice] if k % 5 == 0 else ["Read on"] if k % 5 == 1 else [])) for k in range(10, 1100)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_rows=rows).collect()}
    for k, *_ in pages:
        assert got[k] == (f"{notice} {own[k]}" if k in (6, 7) else f"Read on {own[k]}" if k >= 10 and k % 5 == 1 else own[k])


# --- personal data ---------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_the_patterns():
    r = random.Random(4)
    for _ in range(8000):
        t = "".join(r.choice("0123456789..@@aZ-_%+ ()é") for _ in range(r.randint(1, 50)))
        assert pii.base_spans(t) == base(t), t


def test_pii_spans(spark):
    clear = "Mail bob77@host.example.com or +1 (017) 555-7713; card 4111111111111111, host 10.0.0.255 not 10.0.0.256."
    texts = EDGE + [(50, clear), (51, clear + " Again (017) 555-7713 and 4111.1111.1111.1111"), (52, "In 1999 we sold 2048 units, 12 % more, v2.10 at 10:30 on 2020-01-02")]
    got = pii.spans(spark, table(spark, texts)).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    assert (by[50]["n_email"], by[50]["n_ip"], by[50]["n_card"], by[50]["n_phone"]) == (1, 1, 1, 1)
    assert by[50]["base_sha256"] == hashlib.sha256(pii.joined(base(clear)).encode()).hexdigest() and by[50]["spans"] == pii.joined(base(clear))
    more = {tuple(s.split(":")) for s in by[51]["spans"].split(",")} - {tuple(map(str, s)) for s in base(texts[-2][1])}
    t = texts[-2][1]
    assert {(k, t[int(a) : int(b)]) for k, a, b in more} == {("phone", "(017) 555-7713"), ("card", "4111.1111.1111.1111")}
    assert by[52]["spans"] == "" and by[0]["spans"] == ""
    red = {r["doc_id"]: r for r in pii.redact(spark, table(spark, texts)).collect()}
    assert "[EMAIL]" in red[50]["text"] and "@" not in red[50]["text"] and red[50]["n_chars"] == len(red[50]["text"])
    assert red[0]["text"] is None and red[52]["text"] == texts[-1][1]


def test_message_passing_against_enumeration():
    """On chains and one skip edge without loops, beliefs equal the exact marginals."""
    import itertools

    f = pii.model()
    words = ["4111111111111111", "foo1", "555-7713", "x2"]
    x = pii.design(words, [False, True, True, False])
    e = (np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([0, 0, 1]))
    fixed = np.array([3, -1, -1, -1])
    score = x @ f.unary
    want = np.zeros((4, 5))
    for c in itertools.product(range(5), repeat=4):
        if c[0] == 3:
            v = sum(score[k, c[k]] for k in range(1, 4)) + sum(f.pair[k][c[i], c[j]] for i, j, k in zip(*e))
            for k in range(4):
                want[k, c[k]] += np.exp(v)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(f.beliefs(x, e, fixed), want, atol=1e-3)


def test_evidence_reaches_every_linked_mention():
    """One clear mention at either end of a long chain: beliefs are those of exact forward-backward sums."""
    n, skip = 60, np.where(np.eye(5, dtype=bool), np.log(8000.0), 0.0)
    f = pii.Field(np.zeros((1, 5)), np.zeros((5, 5)), skip)
    e = (np.arange(n - 1), np.arange(1, n), np.ones(n - 1, int))
    for clear in (0, n - 1):
        fixed = np.full(n, -1)
        fixed[clear] = 4
        step = np.exp(skip) / np.exp(skip).sum(1)
        want = [np.linalg.matrix_power(step, abs(k - clear))[4, 4] for k in range(n)]
        got = f.beliefs(np.zeros((n, 1)), e, fixed)[:, 4]
        assert np.allclose(got, want, atol=1e-3) and got.min() > 0.9


def test_one_clear_mention_labels_all_unclear_ones():
    f = pii.model()
    for text in ("+1 (017) 555-7713 " + "x (017) 555-7713 " * 80, "x (017) 555-7713 " * 80 + "+1 (017) 555-7713"):
        base_, every = pii.find(text, f)
        assert len(base_) == 1 and [k for k, _, _ in every] == ["phone"] * 81
    assert pii.find("x (017) 555-7713 " * 80, f) == ([], [])


def test_loops_come_to_rest():
    """Repeated neighbours, hence loops: more trips change nothing."""
    f = pii.model()
    tokens_ = ["+1", "(017)", "555-7713", "x2"] * 40
    near_ = [k % 4 != 0 for k in range(160)]
    fixed = np.full(160, -1)
    fixed[:3] = 4
    p = f.beliefs(pii.design(tokens_, near_), pii.graph(tokens_, near_), fixed)
    trips, pii.STILL = pii.STILL, 1e-9
    try:
        assert np.allclose(p, f.beliefs(pii.design(tokens_, near_), pii.graph(tokens_, near_), fixed), atol=1e-2)
    finally:
        pii.STILL = trips


def measured(field, skip, n=250):
    """Precision and recall of labels beside the base spans, over documents of other forms
    and words than those that the field learned from."""
    right = found_ = wanted = 0
    for text, gold in pii.documents(n, 99, "test"):
        base_, every = pii.find(text, field, skip)
        for tokens_, _, _ in pii.segments(text):
            g, e, b = (pii.labels_of(tokens_, s) for s in (gold, every, base_))
            right += int(((e == g) & (g > 0) & (b == 0)).sum())
            found_ += int(((e > 0) & (b == 0)).sum())
            wanted += int(((g > 0) & (b == 0)).sum())
    return right / found_, right / wanted


def test_skip_edges_find_what_a_chain_does_not():
    f = pii.model()
    precision, recall = measured(f, True)
    plain_precision, plain_recall = measured(f, False)
    assert precision >= 0.8 and recall >= 0.65
    assert recall > plain_recall + 0.1 and precision > plain_precision - 0.02


def test_a_number_that_runs_on_goes_whole():
    """Base matches that run on into the next number fail; the field has them whole."""
    f = pii.model()
    text = "oument éreé. +1 (826) 555-4081 190.137.223.204 du"
    base_, every = pii.find(text, f)
    assert [k for k, _, _ in base_] == ["ip"]
    assert [text[a:b] for k, a, b in every if k == "phone"] == ["+1 (826) 555-4081"]
    assert pii.redacted(text, every) == "oument éreé. [PHONE] [IP] du"


def test_long_documents_have_several_graphs():
    """Evidence reaches all segments of a document, and ordinary numbers stay, however many."""
    f = pii.model()
    text = "x (017) 555-7713 " * 300 + "+1 (017) 555-7713 " + "y 12 z 2048 w (017) 555-7713 " * 300
    base_ = pii.base_spans(text)
    got = pii.added_spans(text, base_, f, size=50)
    assert [k for k, _, _ in got] == ["phone"] * 600 and {text[a:b] for _, a, b in got} == {"(017) 555-7713"}
    r = random.Random(5)
    for numbers in ("12 2048 7 " * 20_000, " ".join(str(r.randint(0, 10 ** r.randint(1, 8))) for _ in range(60_000)), "1.5 2.25 10.125 " * 2_000):
        assert pii.added_spans(numbers, [], f, size=20_000) == []


def test_evidence_of_a_segment_counts_once(monkeypatch):
    """A document of one segment has one graph whatever its length: white space does not change it."""
    f, sizes = pii.model(), []
    graph = pii.graph
    monkeypatch.setattr(pii, "graph", lambda tokens, *more: (sizes.append(len(tokens)), graph(tokens, *more))[1])
    text = "call +1 (017) 555-7713 or (017) 555-7713 x"
    base_ = pii.base_spans(text)
    assert base_
    short = pii.added_spans(text, base_, f, size=1000)
    assert pii.added_spans(text + " " * 2000, base_, f, size=1000) == short and sizes[0] == sizes[1]


def test_personal_data_in_bytes_that_are_no_text(spark):
    docs = invalid(spark, b"\xff mail bob77@host.example.com", b"\xfe nothing")
    by = {r["doc_id"]: r for r in pii.spans(spark, docs).collect()}
    assert by[0]["spans"] == "email:7:29" and by[1]["spans"] == ""
    red = pii.redact(spark, docs).select("doc_id", F.hex(F.col("text").cast("binary")).alias("h")).collect()
    assert {r["doc_id"]: bytes.fromhex(r["h"]) for r in red} == {0: "\ufffd mail [EMAIL]".encode(), 1: b"\xfe nothing"}


# --- near duplicates -------------------------------------------------------------------


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    return links, root


def near_texts(r):
    out = list(EDGE[:4]) + ["one two three", "One  two\nthree", "x y", "x y"]
    for _ in range(12):
        words = prose(r, r.randint(30, 120)).split()
        out.append(" ".join(words))
        for _ in range(r.randint(0, 6)):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
    shared = prose(r, 40)
    return out + [shared + " " + prose(r, 40) for _ in range(15)]


def test_near_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)  # buckets are cut into several blocks
    texts = near_texts(random.Random(6))
    links, root = brute_classes(texts)
    got = {r["doc_id"]: r for r in near.join(spark, table(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i]["class_id"], got[i]["n_links"], got[i]["class_size"]) == (root[i], len(links[i]), root.count(root[i])), texts[i]
    assert near.join(spark, table(spark, [])).count() == 0


def test_one_of_each(spark):
    texts = near_texts(random.Random(9))
    rows = [*enumerate(texts), (3, "a"), (3, "a"), (None, "lonely words here"), (None, "lonely words here")]
    _, root = brute_classes(texts)
    got = near.one_of_each(spark, table(spark, rows))
    assert got.columns == table(spark, []).columns
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in got.collect())
    want = sorted([(i, texts[i] or "") for i in range(len(texts)) if root[i] == i] + [(-1, "lonely words here")])
    assert kept == want


def invalid(spark, *texts):
    """Documents of these bytes, valid UTF-8 or not."""
    rows = " union all ".join(f"select {k}L as doc_id, cast(unhex('{t.hex()}') as string) as text" for k, t in enumerate(texts))
    return spark.sql(f"select *, 'en' as lang, 's' as source, 1L as n_chars from ({rows})")


def test_stages_keep_columns_with_dots_in_their_names(spark):
    docs = table(spark, ["good words here 12", "mail me at a@b.org", None, ""]).withColumnRenamed("lang", "a.b").withColumn("c`d.e", F.lit(3)).withColumn("f.g", F.struct(F.lit(1).alias("h.i")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    kept = quality.keep_good(spark, docs, labels)
    assert kept.schema == docs.schema and kept.count() in range(5)
    clean = pii.redact(spark, docs)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["a.b"], r["c`d.e"], r["f.g"]["h.i"]) for r in clean.where("text like '%mail%'").collect()) == [(1, "mail me at [EMAIL]", "en", 3, 1)]
    for stage in (near.one_of_each, mixing.mixed_documents):
        out = stage(spark, docs)
        assert out.columns == docs.columns and out.count() > 0
    assert packing.pack(spark, docs).count() == 4


def test_near_of_bytes_that_are_no_text(spark):
    words = prose(random.Random(1), 40).encode()
    got = {r["doc_id"]: r["class_id"] for r in near.join(spark, invalid(spark, words + b" \xff", words + b" \xfe", words, b"\xff\xff")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    assert near.one_of_each(spark, invalid(spark, words + b" \xff", words)).count() == 1


def test_rows_to_verification_grow_in_proportion(spark):
    """Different near copies of one text: four times the copies make about four times the rows."""
    words = prose(random.Random(2), 200).split()
    n = {}
    for copies in (128, 512):
        texts = [" ".join([*words[: k % 150], f"x{k}", *words[k % 150 :]]) for k in range(copies)]
        sk = near.sketches(table(spark, texts)).withColumn("copies", F.lit(1)).withColumn("vid", F.col("doc_id"))
        n[copies] = near._buckets(sk).count()
    assert n[512] < 6 * n[128]


def test_the_row_that_stays_is_the_same_however_rows_lie(spark):
    rows = [(1, "some words that are the same here", s) for s in ("c", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {near.one_of_each(spark, df.repartition(n)).first()["source"] for n in (1, 3)} == {"a"}


def test_posterior_bound():
    """The kept pairs' rule is the Beta posterior: checked by numeric integration."""
    fewest = near.least_matches()
    for n in (40, 80, 160):
        for m in (fewest[n] - 1, fewest[n]):
            s = np.linspace(0, 1, 400_001)[1:-1]
            d = m * np.log(s) + (n - m) * np.log1p(-s)
            d = np.exp(d - d.max())
            assert (d[s >= 0.8].sum() / d.sum() >= near.TOLERANCE) == (m >= fewest[n])
