"""Operators against plain Python, and queries against their SQL on the smallest tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline import work
from strandline.operators import assign, clusters, components, depth, filtering, preprocess, prune, scoring
from strandline.plans import catalog, pipelines
from strandline.sources import fixtures, text
from strandline.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(rows):
    return sorted(tuple(f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["pairs_valid", "pairs_rejected", "pair_corners", "overlap_edges", "sv_clusters", "sv_layout_standard", "filter_retained", "read_pairs", "length_bounds_pct", "interval_coverage", "point_coverage", "mean_uniqueness", "merged_intervals", "range_join_open", "cgh_single", "cgh_paired", "fragment_components", "split_read_candidates"])
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = _norm(map(tuple, df.select(*cols).collect()))
    want = _norm(duck.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(fixtures.TABLES))
def test_fixture_equals_sql(spark, duck, name):
    df = fixtures.load(spark, SF, name)
    got = _norm(map(tuple, df.collect()))
    assert got == _norm(duck.execute(f"select {', '.join(df.columns)} from ({fixtures.duck(name)})").fetchall())


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(120)] + [(k, k + 1) for k in range(200, 260)] + [(None, 3), (7, 7)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {v: find(v) for v in root}
    assert components.connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("mode", ["closed", "open", "contained"])
def test_range_join_against_loops(spark, mode, levels):
    r = random.Random(4)

    def make(n):
        return [(r.randint(1, 2), s := r.randint(-50, 900), s + r.choice((0, 3, 20, 400))) for _ in range(n)]

    a, b = make(60), make(60)
    tests = {"closed": lambda p, q: q[1] <= p[2] and q[2] >= p[1], "open": lambda p, q: q[1] < p[2] and q[2] > p[1], "contained": lambda p, q: q[1] >= p[1] and q[2] <= p[2]}
    want = sorted((*p, *q) for p in a for q in b if p[0] == q[0] and tests[mode](p, q))
    left, right = (spark.createDataFrame(x, "chr int, start long, end long") for x in (a, b))
    got = depth.range_join(left, right, mode, width=16, levels=levels)
    assert sorted(map(tuple, got.collect())) == want
    hit = {p for p in a if any(p[0] == q[0] and tests[mode](p, q) for q in b)}
    semi = depth.range_join(left, right, mode, "left_semi", width=16, levels=levels)
    assert sorted(map(tuple, semi.collect())) == sorted(p for p in a if p in hit)


def test_point_coverage_against_counts(spark):
    r = random.Random(6)
    frags = [(1, s := r.randint(0, 500), s + r.randint(0, 60)) for _ in range(200)]
    points = [(1, p) for p in range(0, 560, 7)] * 2
    got = depth.point_coverage(spark.createDataFrame(points, "chr int, pos long"), spark.createDataFrame(frags, "chr int, f_start long, f_end long"), width=32)
    assert {x["pos"]: x["n"] for x in got.collect()} == {p: sum(s <= p <= e for _, s, e in frags) for _, p in points}


def test_points_score_against_the_grid(spark):
    """The run-based search finds what trying every (a, b) finds."""
    r = random.Random(8)
    p = scoring.ScoreParams(lavg=200, read_len=50, lam=2.0, limit=10_000)
    pr = []
    for k in range(6):
        for j in range(3):
            x, y = 10_000 * (k + 1) + r.randint(0, 30), 10_000 * (k + 1) + 700 + r.randint(0, 30)
            pr.append((f"p{k}{j}", 1, x, x + 49, "+", 1, y - 49, y, "-", 150, 260))
    cl = clusters.summarize(clusters.cluster_members(clusters.valid_pairs(spark.createDataFrame(pr, "name string, chr_l int, l_start int, l_end int, l_or string, chr_r int, r_start int, r_end int, r_or string, lmin long, lmax long"))))
    frags = [(1, s := r.randint(10_000, 71_000), s + 180) for _ in range(2_000)]
    got = {x["cluster_id"]: x for x in scoring.score_clusters(cl, spark.createDataFrame(frags, "chr int, f_start long, f_end long"), None, p).collect()}
    from strandline.functions import geometry as g

    rows = cl.where("localization > 0").select("*", *[v.alias(k) for k, v in g.region_box().items()]).collect()
    assert len(got) == len(rows) >= 5

    def pois(rate, length, n):
        return n * math.log(rate * length) - rate * length - math.lgamma(n + 1)

    depth_at: dict[int, int] = {}

    def cov(pos):
        if pos not in depth_at:
            depth_at[pos] = sum(s <= pos <= e for _, s, e in frags)
        return depth_at[pos]

    for c in rows:
        k, best, beyond = c["num_prs"], None, False
        d_len = p.lavg - 2 * p.read_len
        none, hom, het = k * math.log(p.perr), pois(p.lam, d_len, k), pois(p.lam / 2, d_len, k)
        for a in range(c["a_min"], c["a_max"] + 1):
            na = cov(a)
            for b in range(c["b_min"], c["b_max"] + 1):
                if not c["s0"] <= b - a <= c["s1"]:
                    continue
                nb = cov(b)
                beyond |= 1 - sum(math.exp(i * math.log(2 * p.lam) - 2 * p.lam - math.lgamma(i + 1)) for i in range(na + nb + 1)) < p.tolerance
                err = pois(p.lam, p.lavg, na) + pois(p.lam, p.lavg, nb)
                d = max(hom + (na + nb) * math.log(p.perr), het + pois(p.lam / 2, p.lavg, na) + pois(p.lam / 2, p.lavg, nb)) - err - none
                if best is None or d > best[0] + 1e-9:
                    best = (d, a, b)
        row = got[c["cluster_id"]]
        if beyond:
            assert row["llr"] == scoring.REJECTED
        else:
            assert row["llr"] == pytest.approx(best[0], abs=1e-6) and (row["best_a"], row["best_b"]) == best[1:]


def test_sampling_against_enumeration():
    import numpy as np

    p = assign.McmcParams(perr=0.05, lam=0.02)
    s = assign.State([[0], [0, 1], [0, 1], [1], [1, 2]], [(-3.0, -1.0), (-1.0, -1.5), (0.0, -2.0)], p)
    exact = assign.exact_posterior(s)
    sampled = assign.sampled_posterior(s, np.random.default_rng(1), 5_000, 150_000)
    for e, m in zip(exact, sampled, strict=True):
        assert sum(m.values()) == pytest.approx(1)
        for v in e:
            assert m[v] == pytest.approx(e[v], abs=0.02)


def test_sums_over_counts_against_enumeration():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 3)
        options = [sorted(r.sample(range(n), r.randint(1, n))) for _ in range(r.randint(1, 6))]
        s = assign.State(options, [(r.uniform(-30, 0), r.uniform(-30, 0)) for _ in range(n)], assign.McmcParams(perr=0.05, lam=0.02))
        for e, c in zip(assign.exact_posterior(s), assign.counted_posterior(s, 2**16), strict=True):
            assert c == pytest.approx(e, abs=1e-9)
    assert assign.counted_posterior(s, 0) is None


def test_queries_do_the_whole_assignment(spark, monkeypatch):
    """The queries' parameters are the operator's own, and steps grow with the fragments."""
    from dataclasses import replace

    assert replace(catalog.MCMC, lam=assign.McmcParams.lam) == assign.McmcParams()
    # a cycle of three clusters, which no sum along a tree decides
    links = spark.createDataFrame([(f"f{k}", c) for k in range(300) for c in ("ab", "bc", "ca")[k % 3]], "fragment_id string, cluster_id string")
    comp = spark.createDataFrame([(c, "a") for c in "abc"], "cluster_id string, component_id string")
    scored = spark.createDataFrame([(c, -900.0, -3000.0, 5.0) for c in "abc"], "cluster_id string, log_p_variant double, log_p_novariant double, llr double")
    few = assign.McmcParams(burn_in=0, samples=100, exact_states=0)
    # 300 steps at 300 fragments, 100 of a kind: times in a state are multiples of 1 / 300, their means of 1 / 30000
    got = [x["probability"] for x in assign.mcmc(links, comp, scored, few)[0].collect()]
    assert all(abs(q * 30_000 - round(q * 30_000)) < 1e-6 for q in got) and any(abs(q * 10_000 - round(q * 10_000)) > 1e-6 for q in got)


@pytest.mark.parametrize("shifted", [False, True])
def test_prune_against_the_greedy_pass(spark, shifted):
    r = random.Random(12)
    rows = []
    for k in range(60):
        x = r.randint(0, 40) * 10
        y = x + r.randint(200, 400)
        rows.append((f"c{k:02d}", r.randint(4, 7), 1, 1, "D", 1.0, False, x - 5, x, y, y + 5, y - x - 3, y - x + 3))
    df = spark.createDataFrame(rows, "cluster_id string, num_prs long, chr_l int, chr_r int, type string, localization double, same boolean, a_lo long, a_hi long, b_lo long, b_hi long, s0 long, s1 long")
    from strandline.functions import geometry as g

    box = {x["cluster_id"]: x for x in df.select("cluster_id", "num_prs", *[v.alias(k) for k, v in g.region_box().items()]).collect()}

    def redundant(p, q):
        if q["b_min"] < p["a_max"] or p["b_min"] < q["a_max"]:
            return False
        inner = (p["a_max"] < q["a_max"] and p["b_min"] > q["b_min"]) or (q["a_max"] < p["a_max"] and (q["b_min"] < p["b_min"] if shifted else q["b_min"] > p["b_min"]))
        union = max(p["b_min"], q["b_min"]) - min(p["a_max"], q["a_max"]) + 1
        return inner or min(p["b_min"], q["b_min"]) - max(p["a_max"], q["a_max"]) + 1 >= 0.5 * union

    names, gone = sorted(box), set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a not in gone and b not in gone and redundant(box[a], box[b]):
                gone.add(a if box[b]["num_prs"] > box[a]["num_prs"] else b)
    got = {x["cluster_id"] for x in prune.prune(df, "ESP", shifted=shifted).collect()}
    assert got == set(names) - gone and gone


def test_text_round_trips(spark, tmp_path):
    pr = fixtures.load(spark, SF, "pr").limit(200)
    text.pr_to_text(pr).write.text(str(tmp_path / "pr"))
    (tmp_path / "more").write_text("# note\nPRA 1 10 59 + chr2 30 79 PLUS\nshort row\nPRB chrX a 5 + 1 2 3 -\n")
    back = text.read_pr(spark, str(tmp_path / "pr"), 150, 350)
    cols = ["name", "chr_l", "l_start", "l_or", "chr_r", "r_end", "r_or"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, pr.select(*cols).collect()))
    assert [r["chr_r"] for r in text.read_pr(spark, str(tmp_path / "more")).collect()] == [2]
    (tmp_path / "manifest").write_text(f"{tmp_path}/pr PR 150 350\n{tmp_path}/more ESP\n")
    both = text.read_manifest(spark, str(tmp_path / "manifest"))
    assert {(r["lmin"], r["lmax"]) for r in both.select("lmin", "lmax").distinct().collect()} == {(150, 350), (100, 400)}
    with pytest.raises(ValueError):
        text.parse_manifest(["a b c"])
    c = clusters.summarize(clusters.cluster_members(clusters.valid_pairs(fixtures.load(spark, SF, "pr"))), names=True)
    text.write_clusters(c, str(tmp_path / "regions"), "regions")
    again = text.read_clusters(spark, str(tmp_path / "regions"))
    assert again.count() == c.count()
    lines = {x["value"].split("\t")[0]: x["value"].split("\t") for x in text.convert_layout(again).collect()}
    for row in c.where("area > 0").limit(20).collect():
        assert lines[row["cluster_id"]][2] == f"{row['left_min']},{row['left_max']}"
        assert lines[row["cluster_id"]][7] == row["type"]


def test_sam(spark, tmp_path):
    sam = ["@SQ\tSN:chr1\tLN:5000", "@RG\tID:g1\tLB:lib\tPL:ILLUMINA", "r1\t99\tchr1\t100\t60\t50M\t=\t300\t250\tACGTN\tIIIII\tRG:Z:g1", "r1\t147\tchr1\t300\t60\t50M\t=\t100\t-250\tTTTTA\tJJJJJ", "bad\tx\tchr1"]
    (tmp_path / "a.sam").write_text("\n".join(sam) + "\n")
    reads, groups, refs = text.read_sam(spark, str(tmp_path / "a.sam"))
    assert [(r["name"], r["strand"], r["read_group"]) for r in reads.collect()] == [("r1", "+", "g1"), ("r1", "-", None)]
    assert text.genome_length(refs) == 5000 and text.check_platforms(groups) == "illumina"
    one, two = text.sam_to_fastq(reads)
    assert one.first()["value"] == "@r1\nACGTN\n+\nIIIII" and two.count() == 1
    assert text.sam_to_table(reads).columns == ["name", "flag", "chr", "pos", "mapq", "cigar", "mate_chr", "mate_pos", "tlen"]
    assert reads.select(text.reverse_complement(F.col("seq")).alias("s")).first()["s"] == "NACGT"
    with pytest.raises(Exception, match="bad alignment"):
        text.read_sam(spark, str(tmp_path / "a.sam"), "strict")[0].collect()


def test_interval_boxes(spark, tmp_path):
    (tmp_path / "i.txt").write_text("chr1 100 5000\n1 150 5050 x y\n2 100 5000\n1 900 5000\n")
    boxes = text.read_intervals(spark, str(tmp_path / "i.txt"), 200).withColumn("name", F.concat_ws("-", "chr", "start"))
    assert [tuple(r) for r in clusters.box_edges(boxes).collect()] == [("1-100", "1-150")]
    (tmp_path / "bad.txt").write_text("1 9 5\n")
    with pytest.raises(Exception, match="not below"):
        text.read_intervals(spark, str(tmp_path / "bad.txt")).collect()


def test_metadata_lines(spark):
    bounds = spark.createDataFrame([("lib", 100, 200, 150, 10)], "library string, lmin long, lmax long, mean long, std long")
    assert text.library_info(bounds).first()[0] == "lib\t100\t200\t150\t10"
    assert [r[0] for r in text.batch_manifest(bounds, "out", ("deletion",)).collect()] == ["out_lib.deletion\tPR\t100\t200"]
    depth_row = spark.createDataFrame([(5, 250.5, 50.0, 0.25)], "n long, lavg double, read_len double, lambda double")
    assert [r[0] for r in text.depth_manifest(depth_row, "out").collect()] == ["ConcordantFile: out_all.concordant", "Lavg: 250.5", "ReadLen: 50.0", "Lambda: 0.25"]


def test_coverage_lines(spark, tmp_path):
    row = [("c28", "D", 1, -1.72921e8, -1.48652e10, 40688, 39764630, 37524588, 0, -1.0, 0.0, 1)]
    df = spark.createDataFrame(row, "cluster_id string, type string, num_prs long, log_p_variant double, log_p_novariant double, best_a long, best_b long, cov_l long, cov_r long, map_l double, map_r double, code int")
    text.coverage_lines(df).write.text(str(tmp_path / "cov"))
    assert [tuple(r) for r in text.read_coverage(spark, str(tmp_path / "cov")).collect()] == row


def test_params():
    p = text.parse_params(["# c", "Lavg: 300", "ReadLen: 60", "Lambda: 0.02", "Tolerance: 0.001 # x", "Other: 1"], scoring.ScoreParams)
    assert (p.lavg, p.read_len, p.lam, p.tolerance) == (300, 60, 0.02, 0.001)
    with pytest.raises(ValueError):
        scoring.ScoreParams(lavg=100, read_len=50)


def test_library_bounds(spark):
    hist = spark.createDataFrame([("a", v, 1) for v in range(100, 200)] + [("b", 300, 5)], "library string, length int, n long")
    got = {r["library"]: r for r in preprocess.library_cutoffs(hist, {"a": "PCT=90", "b": "EXACT=10,20"}).collect()}
    assert (got["a"]["lmin"], got["a"]["lmax"], got["b"]["lmin"]) == (111, 191, 10)
    with pytest.raises(Exception, match="not below"):
        preprocess.check_bounds(preprocess.length_bounds(hist, "EXACT=20,20")).collect()


def test_source_limits_and_density(spark):
    m = spark.createDataFrame([("c1", 0), ("c1", 0), ("c1", 1), ("c2", 1)], "cluster_id string, source int")
    assert [r[0] for r in filtering.source_limits(m, {0: (2, None), 1: (0, 1)}).collect()] == ["c1"]


def test_stream_equals_batch(spark, tmp_path):
    pr = fixtures.load(spark, SF, "pr")
    cols = pr.columns
    for k in range(2):
        pr.where(F.col("l_start") % 2 == k).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(pr.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in" / "*"))
    ingest.cluster_stream(stream.select(*cols), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(180)
    got = ingest.read_clusters(spark, str(tmp_path / "out"))
    want = clusters.size_filter(clusters.summarize(clusters.cluster_members(clusters.valid_pairs(pr))))
    pick = ["cluster_id", "num_prs", "type", "left_min", "right_max"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_pipelines_per_sample(spark):
    pr = fixtures.load(spark, SF, "pr")
    conc = fixtures.load(spark, SF, "concordant")
    p = pipelines.PipelineParams(llr=None)
    every = pipelines.per_sample(pr.withColumn("sample", F.concat(F.lit("s"), "sample")), conc.crossJoin(spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sample string")), p)
    one = pipelines.hq(pr.where("sample = 1"), conc, None, p)
    got = sorted((r["cluster_id"].split("/")[1], r["num_prs"]) for r in every.where("sample = 's1'").collect())
    assert got == sorted((r["cluster_id"], r["num_prs"]) for r in one.collect())


def _pile(spark, rows):
    cols = "name string, chr_l long, l_start long, l_end long, l_or string, chr_r long, r_start long, r_end long, r_or string, lmin long, lmax long"
    return spark.createDataFrame(rows, cols)


def _deletion(name, left, right, chr_r=1):
    return (name, 1, left, left + 49, "+", chr_r, right, right + 49, "-", 150, 350)


def test_equal_pairs_give_a_linear_number_of_edges(spark):
    rows = [_deletion(f"a{k:04}", 1000, 9000) for k in range(300)] + [_deletion("b", 1010, 9020), _deletion("c", 50_000, 90_000)]
    prs = clusters.valid_pairs(_pile(spark, rows))
    assert clusters.spanning_edges(prs).count() == 300
    assert clusters.overlap_edges(prs).count() == 300 * 299 // 2 + 300
    found = {r.name: r.cluster_id for r in clusters.cluster_members(prs).collect()}
    assert {found[f"a{k:04}"] for k in range(300)} == {"a0000"} and found["b"] == "a0000" and found["c"] == "c"


def test_one_end_in_common_is_no_overlap(spark):
    rows = [_deletion(f"t{k}", 1000, 9000 + 5000 * k, 2) for k in range(40)]
    prs = clusters.valid_pairs(_pile(spark, rows))
    assert clusters.overlap_edges(prs).count() == 0
    assert clusters.overlapping(prs, prs).count() == 40


def test_stars_of_random_edges_match_a_search(spark):
    rng = random.Random(5)
    edges = [(f"v{rng.randrange(400)}", f"v{rng.randrange(400)}") for _ in range(320)]
    root = {a: a for e in edges for a in e}
    for _ in range(400):
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == root


def test_a_stream_may_start_without_a_valid_pair(spark, tmp_path):
    path = str(tmp_path)
    ingest.apply_batch(_pile(spark, []), 0, path)
    assert ingest.read_clusters(spark, path).count() == 0
    ingest.apply_batch(_pile(spark, [_deletion(f"a{k}", 1000 + k, 9000) for k in range(3)]), 1, path)
    assert ingest.read_clusters(spark, path).count() == 0
    ingest.apply_batch(_pile(spark, [_deletion("a3", 1004, 9000)]), 2, path)
    assert [r.num_prs for r in ingest.read_clusters(spark, path).collect()] == [4]


def test_a_name_with_many_records_pairs_its_first_two(spark):
    cols = "name string, library string, ord long, chr long, pos long, strand string, read_len int, class string, mapq int, flag int"
    rows = [("n", "l", k, 1, 500 - k, "+", 50, "HIGHQ", 30, 99) for k in range(50)]
    got = preprocess.pair_mates(spark.createDataFrame(rows, cols)).collect()
    assert [(r.a_ord, r.b_ord) for r in got] == [(1, 0)]


def test_regions_header():
    assert text.HEADERS["regions"].split("\t")[5:7] == [" LeftChr:", "RightChr:"]


def test_batches_cluster_only_what_they_touch(spark, tmp_path):
    path, r = str(tmp_path / "t"), random.Random(3)
    rows = [_deletion(f"p{k:03}", 1000 + r.randrange(12) * 400 + r.randrange(60), 9000 + r.randrange(60), chr_r=r.choice((1, 1, 2))) for k in range(160)]
    r.shuffle(rows)
    pick = ["cluster_id", "num_prs", "type", "left_min", "left_max", "right_min", "right_max"]
    for k in range(4):
        for _ in range(1 + (k == 2)):  # one batch is replayed
            ingest.apply_batch(_pile(spark, rows[40 * k : 40 * k + 40]), k, path, min_size=2)
        want = clusters.size_filter(clusters.summarize(clusters.cluster_members(clusters.valid_pairs(_pile(spark, rows[: 40 * k + 40])))), 2)
        got = ingest.read_clusters(spark, path)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))
    far = [_deletion(f"q{k}", 900_000 + k, 990_000) for k in range(3)]
    made = len(work._made)
    ingest.apply_batch(_pile(spark, far), 4, path, min_size=2)
    assert len(work._made) == made  # its work tables are gone
    log = spark.read.parquet(f"{path}/members/batch=4")
    assert log.count() == 3 and spark.read.parquet(f"{path}/calls/batch=4").where("gone").count() == 0
    bridge = [_deletion("a0", 900_001, 990_000), _deletion("a1", 900_002, 990_001, chr_r=2)]
    ingest.apply_batch(_pile(spark, bridge), 5, path, min_size=2)
    assert spark.read.parquet(f"{path}/members/batch=5").count() == 5
    named = {x.cluster_id: x.num_prs for x in ingest.read_clusters(spark, path).collect()}
    assert named["a0"] == 4 and "q0" not in named and "a1" not in named
