"""Column builders for breakpoint regions.

A read pair with strands sx, sy (+1 or -1) and outer coordinates X, Y bounds its
breakpoint (a, b) to a trapezoid: sx(a-X) >= 0, sy(b-Y) >= 0 and
lmin <= sx(a-X) + sy(b-Y) <= lmax. With equal strands the sum a+b is bounded, else the
difference b-a; call it s, between s0 and s1. The common region of any number of pairs
of one kind is then a box cut by a diagonal band, and its six bounds are maxima and
minima of the pairs' own bounds, so a cluster's region is an ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.once import with_once

C = F.col
#: The six bounds of a region: a in [a_lo, a_hi], b in [b_lo, b_hi], s in [s0, s1]. A null box bound is open.
BOUNDS = ("a_lo", "a_hi", "b_lo", "b_hi", "s0", "s1")


def norm_chr(name: Column) -> Column:
    """Chromosome number: an optional chr prefix in any case, then a number, X (23) or Y (24); else null."""
    bare = F.upper(F.regexp_replace(F.trim(name), r"^(?i)chr", ""))
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.rlike(r"^[0-9]{1,9}$"), bare.cast("int"))


def strand_sign(name: Column) -> Column:
    """+1 or -1; anything but the known spellings is null."""
    return F.when(name.isin("+", "PLUS", "Plus"), 1).when(name.isin("-", "MINUS", "Minus"), -1)


def outer(sign: Column, start: Column, end: Column) -> Column:
    """The coordinate at the outer end of a read: its start on +, its end on -."""
    return F.when(sign > 0, start).otherwise(end)


def is_same(sx: Column | None = None, sy: Column | None = None) -> Column:
    """True where both strands are equal (inversions and their like)."""
    return (C("sx") if sx is None else sx) == (C("sy") if sy is None else sy)


def diagonal_bounds(x: Column, y: Column, sx: Column, sy: Column, lmin: Column, lmax: Column) -> tuple[Column, Column]:
    base = F.when(is_same(sx, sy), x + y).otherwise(y - x).cast("long")
    return base + F.when(sy > 0, lmin).otherwise(-lmax), base + F.when(sy > 0, lmax).otherwise(-lmin)


def extent(x: Column, sign: Column, lmax: Column) -> tuple[Column, Column]:
    """The range of a (or b) that a trapezoid covers."""
    return F.when(sign > 0, x).otherwise(x - lmax).cast("long"), F.when(sign > 0, x + lmax).otherwise(x).cast("long")


def corners(x: Column, y: Column, sx: Column, sy: Column, lmin: Column, lmax: Column) -> Column:
    """The trapezoid's corners in the order in which a boundary is written."""

    def point(a, b):
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.array(point(x + sx * lmin, y), point(x + sx * lmax, y), point(x, y + sy * lmax), point(x, y + sy * lmin))


def edge_values(p: str, v: Column) -> tuple[Column, Column]:
    """(top, bottom) in b of the trapezoid with columns ``p``X, ``p``Y, ``p``sx, ``p``sy on the line s = v."""
    x, y, sx, sy = (C(p + k) for k in ("x", "y", "sx", "sy"))
    slope = F.when(sx == sy, v - x).otherwise(x + v)
    first_is_slope = ((sx > 0) & (sy > 0)) | ((sx < 0) & (sy > 0))
    return F.when(first_is_slope, slope).otherwise(y), F.when(first_is_slope, y).otherwise(slope)


def overlaps(p: str, q: str) -> Column:
    """Closed overlap of two trapezoids of one kind (touching counts), from columns
    x, y, sx, sy, s0, s1 with prefixes ``p`` and ``q``. A deletion-like pair (+-) and a
    divergent one (-+) on one chromosome never overlap; see ``kinds_may_meet``."""
    e, x = F.greatest(p + "s0", q + "s0"), F.least(p + "s1", q + "s1")
    (pt0, pb0), (pt1, pb1) = edge_values(p, e), edge_values(p, x)
    (qt0, qb0), (qt1, qb1) = edge_values(q, e), edge_values(q, x)
    return (C(p + "s0") <= C(q + "s1")) & (C(q + "s0") <= C(p + "s1")) & ~((qb0 > pt0) & (qb1 > pt1)) & ~((qt0 < pb0) & (qt1 < pb1))


def kinds_may_meet(p: str, q: str, same_chr: Column) -> Column:
    return ~(same_chr & (C(p + "sx") != C(p + "sy")) & (C(q + "sx") != C(q + "sy")) & (C(p + "sx") != C(q + "sx")))


def orientations_match(p: str, q: str) -> Column:
    return (C(p + "sx") == C(q + "sx")) & (C(p + "sy") == C(q + "sy"))


def pair_bounds() -> list[Column]:
    """The six bounds of one pair, from x, y, sx, sy, s0, s1."""
    return [
        F.when(C("sx") > 0, C("x")).cast("long").alias("a_lo"), F.when(C("sx") < 0, C("x")).cast("long").alias("a_hi"),
        F.when(C("sy") > 0, C("y")).cast("long").alias("b_lo"), F.when(C("sy") < 0, C("y")).cast("long").alias("b_hi"), C("s0"), C("s1"),
    ]


def common_bounds() -> list[Column]:
    """Aggregates: the six bounds of the region common to a group of pairs."""
    return [
        F.max(F.when(C("sx") > 0, C("x"))).cast("long").alias("a_lo"), F.min(F.when(C("sx") < 0, C("x"))).cast("long").alias("a_hi"),
        F.max(F.when(C("sy") > 0, C("y"))).cast("long").alias("b_lo"), F.min(F.when(C("sy") < 0, C("y"))).cast("long").alias("b_hi"),
        F.max("s0").alias("s0"), F.min("s1").alias("s1"),
    ]


def closed_bounds(same: Column | None = None) -> dict[str, Column]:
    """Box bounds with open sides filled from the band and the other side."""
    same = C("same") if same is None else same
    a_lo, a_hi, b_lo, b_hi, s0, s1 = (C(k) for k in BOUNDS)
    a_lo2 = F.coalesce(a_lo, F.when(same, s0 - b_hi).otherwise(b_lo - s1))
    a_hi2 = F.coalesce(a_hi, F.when(same, s1 - b_lo).otherwise(b_hi - s0))
    b_lo2 = F.coalesce(b_lo, F.when(same, s0 - a_hi).otherwise(s0 + a_lo))
    b_hi2 = F.coalesce(b_hi, F.when(same, s1 - a_lo).otherwise(s1 + a_hi))
    return {"a_lo": a_lo2, "a_hi": a_hi2, "b_lo": b_lo2, "b_hi": b_hi2}


def region_area(same: Column | None = None) -> Column:
    """Exact area of the region of the six bounds: a box cut by a band. 0 if it is empty."""
    same = C("same") if same is None else same
    k = closed_bounds(same)
    a_lo, a_hi, s0, s1 = k["a_lo"].cast("double"), k["a_hi"].cast("double"), C("s0").cast("double"), C("s1").cast("double")
    # with different strands, b -> -b makes the band one of a sum
    b_lo = F.when(same, k["b_lo"]).otherwise(-k["b_hi"]).cast("double")
    b_hi = F.when(same, k["b_hi"]).otherwise(-k["b_lo"]).cast("double")
    lo, hi = F.when(same, s0).otherwise(-s1), F.when(same, s1).otherwise(-s0)

    def q(t):
        t = F.greatest(t, F.lit(0.0))
        return t * t / 2

    def below(s):
        return q(s - a_lo - b_lo) - q(s - a_hi - b_lo) - q(s - a_lo - b_hi) + q(s - a_hi - b_hi)

    empty = (a_lo > a_hi) | (b_lo > b_hi) | (lo > hi)
    return F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), below(hi) - below(lo)))


def region_box(same: Column | None = None) -> dict[str, Column]:
    """The region's own extent: box bounds tightened by the band."""
    same = C("same") if same is None else same
    k, s0, s1 = closed_bounds(same), C("s0"), C("s1")
    return {
        "a_min": F.greatest(k["a_lo"], F.when(same, s0 - k["b_hi"]).otherwise(k["b_lo"] - s1)),
        "a_max": F.least(k["a_hi"], F.when(same, s1 - k["b_lo"]).otherwise(k["b_hi"] - s0)),
        "b_min": F.greatest(k["b_lo"], F.when(same, s0 - k["a_hi"]).otherwise(s0 + k["a_lo"])),
        "b_max": F.least(k["b_hi"], F.when(same, s1 - k["a_lo"]).otherwise(s1 + k["a_hi"])),
    }


def region_polygon(df: DataFrame, out: str = "polygon") -> DataFrame:
    """Adds the region's corners, counter-clockwise from the least (b, a): array of (a, b);
    null if the region has no point.

    The six half-planes meet in at most six corners; each pair of adjacent bounds gives
    one, kept if it lies in all of them. Corners repeat where bounds coincide, so they
    are made distinct and ordered by angle around their mean. Each step is worked out
    once per row.
    """
    same, s0, s1 = C("same"), C("s0"), C("s1")
    df = with_once(df, {f"_c{k}": v for k, v in closed_bounds().items()})
    a_lo, a_hi, b_lo, b_hi = (C(f"_c{k}") for k in ("a_lo", "a_hi", "b_lo", "b_hi"))

    def point(a, b):
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def on(a, s):  # b on the band's line s
        return F.when(same, s - a).otherwise(a + s)

    def off(b, s):  # a on the band's line s
        return F.when(same, s - b).otherwise(b - s)

    points = [point(a, b) for a in (a_lo, a_hi) for b in (b_lo, b_hi)]
    points += [point(a, on(a, s)) for a in (a_lo, a_hi) for s in (s0, s1)] + [point(off(b, s), b) for b in (b_lo, b_hi) for s in (s0, s1)]

    def inside(p):
        s = F.when(same, p["a"] + p["b"]).otherwise(p["b"] - p["a"])
        return p["a"].between(a_lo, a_hi) & p["b"].between(b_lo, b_hi) & s.between(s0, s1)

    df = with_once(df, {"_points": F.array(*points)})
    df = with_once(df, {"_points": F.array_distinct(F.filter("_points", inside))})
    n = F.size("_points").cast("double")
    total_a = F.aggregate("_points", F.lit(0.0), lambda t, p: t + p["a"])
    total_b = F.aggregate("_points", F.lit(0.0), lambda t, p: t + p["b"])
    df = with_once(df, {"_ma": total_a / F.nullif(n, F.lit(0.0)), "_mb": total_b / F.nullif(n, F.lit(0.0))})
    keyed = F.transform("_points", lambda p: F.struct(F.atan2(p["b"] - C("_mb"), p["a"] - C("_ma")).alias("k"), p["a"].alias("a"), p["b"].alias("b")))
    df = with_once(df, {"_ring": F.transform(F.array_sort(keyed), lambda p: point(p["a"], p["b"]))})
    df = with_once(df, {"_least": F.array_min(F.transform("_ring", lambda p: F.struct(p["b"].alias("b"), p["a"].alias("a"))))})
    df = with_once(df, {"_first": F.array_position("_ring", point(C("_least.a"), C("_least.b"))).cast("int")})
    ring = F.concat(F.slice("_ring", C("_first"), F.size("_ring")), F.slice("_ring", F.lit(1), C("_first") - 1))
    extra = [f"_c{k}" for k in ("a_lo", "a_hi", "b_lo", "b_hi")] + ["_points", "_ma", "_mb", "_ring", "_least", "_first"]
    return with_once(df, {out: F.when(F.size("_ring") > 0, ring)}).drop(*extra)


def in_region(a: Column, b: Column) -> Column:
    """Whether a point lies in the closed region of the six bounds; an open bound admits all."""
    s = F.when(C("same"), a + b).otherwise(b - a)
    box = [F.coalesce(a >= C("a_lo"), F.lit(True)), F.coalesce(a <= C("a_hi"), F.lit(True)), F.coalesce(b >= C("b_lo"), F.lit(True)), F.coalesce(b <= C("b_hi"), F.lit(True))]
    out = s.between(C("s0"), C("s1"))
    for c in box:
        out = out & c
    return out


def type_code(pp: Column, mm: Column, pm: Column, mp: Column, same_chr: Column) -> Column:
    """Variant type from which strand pairs (++, --, +-, -+) a cluster has."""
    one = F.when(pm & mp, "DV").when(pp & mm, "IR").when(pp, "I+").when(mm, "I-").when(pm, "D").when(mp, "V")
    two = F.when(pm & mp, "TR+").when(pp & mm, "TR-").when(pp, "TN-1").when(mm, "TN-2").when(pm, "TN+1").when(mp, "TN+2")
    return F.when(same_chr, one).otherwise(two)


def short_number(x: Column) -> Column:
    """One decimal, half to even, without a trailing '.0'."""
    return F.regexp_replace(F.bround(x, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")


def fragment_name(name: Column) -> Column:
    """The fragment of an ambiguous mapping's name, without its '.n_n_n' suffix."""
    found = F.regexp_extract(name, r"^(.*)\.([0-9]*_[0-9]*_[0-9]*)$", 1)
    return F.when(name.rlike(r"^.*\.[0-9]*_[0-9]*_[0-9]*$"), found).otherwise(name)


def register_sql(spark) -> None:
    """SQL functions sv_area and sv_overlap over the columns named in this module, as SQL expressions."""
    q = "pow(greatest({0}, 0D), 2) / 2"
    terms = [q.format(f"(s - {a} - {b})") for a, b in (("al", "bl"), ("ah", "bl"), ("al", "bh"), ("ah", "bh"))]
    below = f"({terms[0]} - {terms[1]} - {terms[2]} + {terms[3]})"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sv_area(al DOUBLE, ah DOUBLE, bl DOUBLE, bh DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE "
        f"RETURN CASE WHEN al > ah OR bl > bh OR lo > hi THEN 0D ELSE greatest(0D, {below.replace('(s ', '(hi ')} - {below.replace('(s ', '(lo ')}) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sv_overlap(p0 DOUBLE, p1 DOUBLE, q0 DOUBLE, q1 DOUBLE) RETURNS BOOLEAN "
        "RETURN p0 <= q1 AND q0 <= p1"
    )
