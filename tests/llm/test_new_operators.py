"""SimHash links, periodic runs and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash

from strandline.llm import importance, runs, simhash, store, words
from strandline.operators.components import connected_components

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, fp long, score long, cell string, `a.b` string, rank long"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (None, "a b c"), (7, "A b\x0bc"), (7, "A b\x0bc"), (8, "word " * 3000), (9, "ünï " * 40 + "x" * 50_000)]


def edge_docs(spark, n=None):
    rows = [(i, t, 1, 2, "c", "d", 3) for i, t in (EDGES if n is None else EDGES[:n])]
    return spark.createDataFrame(rows, CLASH)


def test_pieces_hold_each_stretch_once():
    r = random.Random(3)
    for _ in range(300):
        raw = b"".join(r.choice([b" ", b"a", b"bb", b"\n  ", b"c" * 9]) for _ in range(r.randrange(40)))
        for overlap in (1, 2):
            got = [tuple(part[k : k + overlap + 1]) for part, _ in words.pieces(raw, overlap, 3) for k in range(max(0, len(part) - overlap))]
            whole = raw.split()
            assert got == [tuple(whole[k : k + overlap + 1]) for k in range(max(0, len(whole) - overlap))]
            assert [w for part, seen in words.pieces(raw, overlap, 3) for w in part[seen:]] == whole


# --- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked_groups(prints):
    """The connected groups of two or more different fingerprints at two bits or less."""
    a = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(a)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2):
            root[find(i)] = find(i + 1 + int(j))
    groups: dict = {}
    for i, f in enumerate(a.tolist()):
        groups.setdefault(find(i), set()).add(f)
    return groups.values()


def simhash_rows(docs):
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    group = {f: k for k, g in enumerate(linked_groups([f for _, f in prints])) for f in g}
    least: dict = {}
    for d, f in prints:
        least[group[f]] = min((x for x in (d, least.get(group[f])) if x is not None), default=None)
    return sorted([(d, f"{f:016x}", least[group[f]]) for d, f in prints], key=str)


def test_simhash_whole_table(spark):
    docs = store.read(spark, SF, "documents")
    got = sorted([tuple(r) for r in simhash.op11_simhash(spark, SF).collect()], key=str)
    assert got == simhash_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == simhash_rows(EDGES)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_bytes_that_are_not_utf8(spark):
    docs = spark.sql("select 1L doc_id, cast(X'FF4120FE' as string) text union all select 2L, cast(X'FF6120FE' as string)")
    got = simhash.near_duplicates(docs).collect()
    assert {r["component_id"] for r in got} == {1} and len({r["fingerprint"] for r in got}) == 1


def test_long_texts_vote_as_a_whole(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(9000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    whole = simhash.fingerprint(text.encode())
    pieces = words.pieces
    monkeypatch.setattr(words, "pieces", lambda raw, overlap: pieces(raw, overlap, 50))
    assert simhash.fingerprint(text.encode()) == whole


def planted_prints(seed, groups, size):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return out


@pytest.mark.parametrize("limit", [2, 7, 4096])
def test_grids_lose_no_link_whatever_the_limit(spark, limit):
    prints = planted_prints(11, 12, 30) | planted_prints(12, 1, 300)
    fps = spark.createDataFrame([(f - (f >> 63 << 64),) for f in prints], "fp long")
    groups: dict = {}
    for r in connected_components(simhash.near_links(fps, len(prints), limit), loops=False).collect():
        groups.setdefault(r["root"], set()).add(r["id"] % 2**64)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in linked_groups(prints) if len(g) > 1)


def test_distance_of_points_is_a_lower_bound_and_pairs_meet_once():
    r = random.Random(5)
    for segments in simhash.LEVELS:
        for _ in range(60):
            a = r.getrandbits(64)
            b = a
            for k in r.sample(range(64), r.randrange(1, 4)):
                b ^= 1 << k
            fp = np.array([a, b], np.uint64)
            counts = simhash.points(fp, segments)[1].astype(int)
            bits = int(a ^ b).bit_count()
            assert abs(counts[0] - counts[1]).sum() <= bits
            cell, row, role = simhash.neighbourhood(fp, segments)
            order = np.argsort(cell, kind="stable")
            u, _ = simhash.links_in_cells(cell[order], fp[row][order], role[order])
            assert len(u) == (bits <= 2)


def test_full_cells_go_on_and_hold_no_rows():
    cell = np.repeat(np.arange(5, dtype=np.uint64), [3, 1, 400, 2, 200])
    fp = np.arange(len(cell), dtype=np.uint64) << np.uint64(8)
    parts = [(cell[k : k + 9], fp[k : k + 9], np.zeros(len(cell[k : k + 9]), np.int8)) for k in range(0, len(cell), 9)]
    on = np.concatenate([u for u, v in simhash.compare_sorted(iter(parts), 10) if v is None])
    assert sorted(on.tolist()) == fp[(cell == 2) | (cell == 4)].tolist()


def test_heavy_points_are_sent_nowhere(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 4)
    prints = planted_prints(3, 1, 200) | planted_prints(4, 5, 6)
    fps = spark.createDataFrame([(f - (f >> 63 << 64),) for f in prints], "fp long")
    assert len(simhash._heavy_cells(spark.createDataFrame([(k,) for k in (3, 5, 6, 9, 10)], "fp long"), 16, 5, 2)) > 1
    groups: dict = {}
    for r in connected_components(simhash.near_links(fps, len(prints), 2), loops=False).collect():
        groups.setdefault(r["root"], set()).add(r["id"] % 2**64)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in linked_groups(prints) if len(g) > 1)


def test_joins_of_frequent_keys_are_whole(spark, monkeypatch):
    monkeypatch.setattr(store, "HEAVY", 3)
    rows = spark.createDataFrame([(1, "x")] * 50 + [(k, "y") for k in range(2, 30)], "k long, v string")
    table = spark.createDataFrame([(1, 50, "one")] + [(k, 1, f"n{k}") for k in range(2, 30)], "k long, n long, name string")
    got = store.join_spread(rows, table, "k", "n", 78)
    assert got.columns == ["k", "v", "name"] and got.count() == 78 and got.where("name = 'one'").count() == 50


# --- runs ------------------------------------------------------------------------------


def plain_runs(w, least=2):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            smaller = any(all(w[s + k] == w[s + k + p] for k in range(n - p)) for p in range(1, q))
            if n >= max(least, 2 * q) and not smaller:
                out.add((s, n, q))
    return out


def test_all_runs_of_all_short_sequences():
    for letters, longest in ((2, 11), (3, 7)):
        for n in range(longest + 1):
            for w in itertools.product(range(letters), repeat=n):
                assert runs.all_runs(list(w)) == plain_runs(w), w


def test_runs_of_longer_sequences():
    r = random.Random(2)
    for _ in range(600):
        w = [r.randrange(r.choice([2, 3, 9])) for _ in range(r.randrange(3, 70))]
        if r.random() < 0.7:
            a, p = r.randrange(len(w)), r.randrange(1, 9)
            w[a:] = [w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i in range(a, len(w))]
        assert runs.all_runs(w) == plain_runs(w), w
        text = [b"w%d" % v for v in w]
        assert runs.word_runs(text) == sorted(plain_runs(w, runs.LEAST), key=lambda x: (x[0], x[2])), w


class Counted(int):
    looks = 0

    def __eq__(self, other):
        Counted.looks += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_words_are_compared_a_linear_number_of_times():
    a, b = [0], [0, 1]
    while len(b) < 6000:
        a, b = b, b + a
    r = random.Random(1)
    shapes = [b[:6000], [0] * 6000, ([0] * 40 + [1]) * 146, list(range(6000)), ([1] * 75 + [0]) * 40 + [0] * 2960, [r.randrange(2) for _ in range(6000)], [int(k).bit_count() % 2 for k in range(6000)]]
    for w in shapes:
        counted = [Counted(v) for v in w]
        Counted.looks = 0
        nss, _ = runs.lyndon_edges(counted)
        assert Counted.looks <= 4 * len(w)
        Counted.looks = 0
        runs.left_extensions(counted, nss)
        assert Counted.looks <= 3 * len(w)


def plain_document(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w, 12), key=lambda x: (x[0], x[2])) if n < 3000 or len(set(w)) > 1 else [(0, n, 1)]
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    said = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in drop).encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, said, kept)


def test_runs_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in store.read(spark, SF, "documents").collect() if len((r.text or "").split()) < 1500]
    want = {plain_document(*d) for d in docs}
    got = {tuple(r) for r in runs.op12_runs(spark, SF).collect()}
    assert want <= got and len(got) == store.read(spark, SF, "documents").count()


def test_runs_edges(spark):
    docs = edge_docs(spark)
    got = sorted([tuple(r) for r in runs.find_runs(docs, plant=True).collect()], key=str)
    assert got == sorted([plain_document(d, t) for d, t in EDGES], key=str)
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_collapse_keeps_columns_and_other_texts(spark):
    docs = edge_docs(spark)
    got = {(r["doc_id"], r["text"]) for r in runs.collapse(docs).collect()}
    want = {(i, t) for i, t in EDGES if i not in (8, 9)} | {(8, "word"), (9, "ünï " + "x" * 50_000)}
    assert runs.collapse(docs).columns == docs.columns and got == want


# --- importance resampling -------------------------------------------------------------


def plain_features(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    return len(w), [crc32(f) % 10000 for f in w + [a + b" " + b for a, b in zip(w, w[1:])]]


def plain_draw(docs, target, percent=25):
    s, t = np.zeros(10000), np.zeros(10000)
    found = [(d, *plain_features(x)) for d, x in docs]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, plain_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + 10000) / ((s[k] + 1) * (t.sum() + 10000)))) for k in range(10000)]
    out = []
    for d, n, f in found:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("per_range", [None, 3, 40])
def test_resampling_whole_table(spark, per_range):
    docs, target = (store.read(spark, SF, k) for k in ("documents", "benchmark"))
    got = importance.op13_importance(spark, SF) if per_range is None else importance.resample(docs.repartition(6), target, per_range=per_range)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


@pytest.mark.parametrize("per_range", [2, 1000])
def test_resampling_repeated_rows_ties_and_edges(spark, per_range):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [*EDGES, *[(100, text)] * 37, *[(None, text)] * 9, *[(100, text + " more")] * 5, *[(k, text) for k in range(200, 240)]]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", "d", 3) for i, t in rows], CLASH).repartition(5)
    for target in (["w1 w2 w3", None, ""], []):
        bench = spark.createDataFrame([(t,) for t in target], "text string")
        for percent in (25, 60, 100):
            got = importance.resample(docs, bench, percent=percent, per_range=per_range)
            assert sorted([tuple(r) for r in got.collect()], key=str) == plain_draw(rows, target, percent)
    assert importance.resample(docs.limit(0), docs, per_range=per_range).count() == 0


def test_tournament_merges_runs_of_any_number():
    r = np.random.default_rng(8)
    for k in (0, 1, 2, 3, 5, 8, 13):
        blocks = []
        for run in range(k):
            n = int(r.integers(1, 60))
            rows = {c: r.integers(0, 6, n) for c in ("score", "doc_id", "n_features", "weight")} | {"none": r.integers(0, 2, n)}
            rows["weight"] = rows["score"]
            blocks += importance.sorted_blocks(rows, np.zeros(n, np.int64), str(run))
        keys = sorted((-s, o, d, f) for b in blocks for s, o, d, f, c in zip(*[b[x].tolist() for x in ("score", "none", "doc_id", "n_features", "copies")]) for _ in range(c))
        take = len(keys) // 2
        ranked, rest = [], []
        for cols in importance.merge(blocks, 1, take):
            for j in range(len(cols["n"])):
                key = (-int(cols["score"][j]), int(cols["none"][j]), int(cols["doc_id"][j]), int(cols["n_features"][j]))
                for c in range(int(cols["n"][j])):
                    (rest.append(key) if cols["first"] is None else ranked.append((int(cols["first"][j]) + c, key)))
        assert sorted(ranked) == list(enumerate(keys[:take], 1)) and sorted(rest) == keys[take:]
