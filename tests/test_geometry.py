"""Golden values, and properties against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import geometry as g
from strandline.functions import likelihood as lk
from strandline.operators import clusters
from strandline.operators.prune import maximal_sets
from strandline.sources import text

PR = "name string, chr_l int, l_start int, l_end int, l_or string, chr_r int, r_start int, r_end int, r_or string, lmin long, lmax long"


def test_single_deletion_golden(spark):
    pr = spark.createDataFrame([("p", 17, 41532, 41582, "+", 17, 42573, 42623, "-", 110, 289)], PR)
    prs = clusters.valid_pairs(pr).withColumn("corners", g.corners(*[F.col(k) for k in ("x", "y", "sx", "sy", "lmin", "lmax")]))
    c = clusters.summarize(clusters.no_cluster(prs), names=True).join(prs.select(F.col("name").alias("cluster_id"), "corners"), "cluster_id")
    line = text.format_clusters(c, "regions").first()["value"].split("\t")
    assert line[1:4] == ["1", "189", "D"]
    assert line[7] == "41642, 42623, 41821, 42623, 41532, 42334, 41532, 42513"


def test_other_golden_localization(spark):
    pr = spark.createDataFrame([("p", 1, 746027, 746077, "+", 1, 748460, 748510, "-", 101, 306)], PR)
    c = clusters.summarize(clusters.no_cluster(clusters.valid_pairs(pr)))
    assert c.select(g.short_number(F.col("localization")).alias("v")).first()["v"] == "204.2"


def _clip(poly, a, b, c):
    """The part of a convex polygon with a*x + b*y <= c."""
    out = []
    for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1]):
        d0, d1 = a * x0 + b * y0 - c, a * x1 + b * y1 - c
        if d0 <= 0:
            out.append((x0, y0))
        if d0 * d1 < 0:
            t = d0 / (d0 - d1)
            out.append((x0 + t * (x1 - x0), y0 + t * (y1 - y0)))
    return out


def _area(poly):
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1]))) / 2 if len(poly) > 2 else 0.0


def _trapezoid(r, same_sign=None):
    sx, sy = r.choice((1, -1)), r.choice((1, -1))
    if same_sign is not None and (sx == sy) != same_sign:
        sy = -sy
    return r.randint(0, 120), r.randint(300, 420), sx, sy, 50, 150


def _half_planes(x, y, sx, sy, lo, hi):
    s = (sx, sy)
    return [(-sx, 0, -sx * x), (0, -sy, -sy * y), (*s, hi + sx * x + sy * y), (-sx, -sy, -lo - sx * x - sy * y)]


def test_area_and_polygon_against_clipping(spark):
    r = random.Random(5)
    rows, want = [], {}
    for k in range(300):
        same = r.random() < 0.5
        poly = [(-2000, -2000), (3000, -2000), (3000, 3000), (-2000, 3000)]
        for j in range(r.randint(1, 4)):
            x, y, sx, sy, lo, hi = _trapezoid(r, same)
            rows.append((f"c{k}", f"c{k}.{j}", x, y, sx, sy, lo, hi))
            for a, b, c in _half_planes(x, y, sx, sy, lo, hi):
                poly = _clip(poly, a, b, c) if poly else []
        want[f"c{k}"] = _area(poly)
    df = spark.createDataFrame(rows, "cluster_id string, name string, x long, y long, sx int, sy int, lmin long, lmax long")
    s0, s1 = g.diagonal_bounds(*[F.col(k) for k in ("x", "y", "sx", "sy", "lmin", "lmax")])
    df = df.withColumns({"same": F.col("sx") == F.col("sy"), "s0": s0, "s1": s1, "chr_l": F.lit(1), "chr_r": F.lit(1)})
    got = text.with_polygons(clusters.summarize(df)).select("cluster_id", "area", "polygon").collect()
    for row in got:
        assert row["area"] == pytest.approx(want[row["cluster_id"]], abs=1e-6)
        if row["area"] > 0:
            assert _area([(p["a"], p["b"]) for p in row["polygon"]]) == pytest.approx(row["area"], abs=1e-6)


def test_overlap_predicate_against_clipping(spark):
    r = random.Random(9)
    rows, want = [], []
    for k in range(600):
        p = _trapezoid(r)
        q = _trapezoid(r, p[2] == p[3])
        poly = [(-2000, -2000), (3000, -2000), (3000, 3000), (-2000, 3000)]
        for a, b, c in _half_planes(*p) + _half_planes(*q):
            poly = _clip(poly, a, b, c) if poly else []
        rows.append((k, *p[:4], *q[:4]))
        want.append(_area(poly) > 1e-9)
    df = spark.createDataFrame(rows, "k int, p_x long, p_y long, p_sx int, p_sy int, q_x long, q_y long, q_sx int, q_sy int")
    for p in ("p_", "q_"):
        s0, s1 = g.diagonal_bounds(*[F.col(p + k) for k in ("x", "y", "sx", "sy")], F.lit(50), F.lit(150))
        df = df.withColumns({p + "s0": s0, p + "s1": s1})
    got = {x["k"]: x["o"] for x in df.select("k", g.overlaps("p_", "q_").alias("o")).collect()}
    swapped = df.select("k", g.overlaps("q_", "p_").alias("o")).collect()
    assert all(got[k] for k, w in enumerate(want) if w)  # positive area: always reported
    assert all(got[x["k"]] == x["o"] for x in swapped)  # symmetric
    assert any(not v for v in got.values())


def test_chromosomes_strands_names(spark):
    rows = [("chr1", "+"), ("CHRx", "PLUS"), ("Y", "-"), ("7", "Minus"), ("chrM", "?"), ("chr17_alt", None)]
    df = spark.createDataFrame(rows, "c string, s string")
    got = [tuple(r) for r in df.select(g.norm_chr(F.col("c")), g.strand_sign(F.col("s"))).collect()]
    assert got == [(1, 1), (23, 1), (24, -1), (7, -1), (None, None), (None, None)]
    name = "chr17_17261_17474_2:1:0_1:0:0_2ea8b32"
    df = spark.createDataFrame([(name + ".0_2_1",), (name,)], "n string")
    assert [r[0] for r in df.select(g.fragment_name(F.col("n"))).collect()] == [name, name]


def test_log_factorial_and_poisson(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 15, 16, 40, 1000, 10**6)], "n long")
    for n, v in df.select("n", lk.log_factorial(F.col("n"))).collect():
        assert v == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-12)


def test_valid_coverage_against_sums(spark):
    rows = [(m, c) for m in (0.5, 3.0, 20.0, 99.0, 150.0) for c in (0, 1, 3, 10, 30, 60, 150, 599, 601)]
    df = spark.createDataFrame(rows, "m double, c long")
    for m, c, ok in df.select("m", "c", lk.valid_coverage(F.col("m"), F.col("c"), 1e-4)).collect():
        if m >= 100:
            assert ok == (c < 4 * m)
        else:
            tail = 1 - math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(c + 1))
            assert ok == (not tail < 1e-4), (m, c)


def test_maximal_sets_against_all_subsets():
    r = random.Random(3)
    import itertools

    from strandline.operators.prune import _area as common

    for _ in range(40):
        rows = []
        same = r.random() < 0.5
        for _ in range(5):
            x, y, sx, sy, lo, hi = _trapezoid(r, same)
            s = x + y if same else y - x
            rows.append((x if sx > 0 else x - hi, x + hi if sx > 0 else x, y if sy > 0 else y - hi, y + hi if sy > 0 else y, s + (lo if sy > 0 else -hi), s + (hi if sy > 0 else -lo), same))
        good = [set(c) for n in range(1, 6) for c in itertools.combinations(range(5), n) if common([rows[k] for k in c], same) > 0]
        want = sorted(sorted(c) for c in good if not any(c < d for d in good))
        assert sorted(maximal_sets(rows)) == want


def test_maximal_sets_whose_corner_is_no_lower_bound():
    """A and C share a region that starts above B, which holds at all lower bounds of both."""
    a, b, c = (0, 10, 2, 12, 2, 10, False), (-1, 9, -6, 4, -5, 3, False), (3, 13, 2, 12, -1, 7, False)
    assert maximal_sets([a, b, c]) == [[0, 1], [0, 2], [1, 2]]
    r = random.Random(8)
    import itertools

    from strandline.operators.prune import _area as common

    for _ in range(150):
        same, rows = r.random() < 0.5, []
        for _ in range(6):
            x, y, far, near = r.randint(0, 12), r.randint(0, 12), r.randint(8, 14), r.randint(0, 5)
            sx = r.choice([1, -1])
            sy = sx if same else -sx
            s = x + y if same else y - x
            rows.append((x if sx > 0 else x - far, x + far if sx > 0 else x, y if sy > 0 else y - far, y + far if sy > 0 else y, s + (near if sy > 0 else -far), s + (far if sy > 0 else -near), same))
        good = [set(k) for n in range(1, 7) for k in itertools.combinations(range(6), n) if common([rows[i] for i in k], same) > 0]
        assert sorted(maximal_sets(rows)) == sorted(sorted(k) for k in good if not any(k < d for d in good))


def test_large_clusters_are_split(spark):
    """A cluster of more than 400 pairs gives the same sets in several tasks as in one."""
    from strandline.operators.prune import maximal_subclusters

    r = random.Random(5)
    rows = [("big", f"p{k:03d}", x, x + 1000 + r.randint(0, 9), 1, -1, 50) for k, x in enumerate(sorted(r.randint(0, 300) for _ in range(450)))]
    members = spark.createDataFrame(rows, "cluster_id string, name string, x long, y long, sx int, sy int, lmax long").withColumns({"s0": F.expr("y - x - 50"), "s1": F.expr("y - x - 20"), "same": F.lit(False)})
    clusters = spark.createDataFrame([("big", 0.0, 450)], "cluster_id string, area double, num_prs long")
    got: dict = {}
    for x in maximal_subclusters(members, clusters, lines=100).collect():
        got.setdefault((x["sub_id"], x["num_prs"]), []).append(x["name"])
    want = maximal_sets([(x, x + 50, y - 50, y, y - x - 50, y - x - 20, False) for _, _, x, y, *_ in rows])
    assert [sorted(v) for _, v in sorted(got.items())] == [[f"p{k:03d}" for k in s] for s in want] and len(want) > 1
    assert all(n == len(v) for (_, n), v in got.items())
