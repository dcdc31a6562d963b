"""Interval operators: range joins, coverage, uniqueness, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.once import merged

C = F.col
BIN = 4096


def _binned(df: DataFrame, start: str, end: str, width: int, levels: int) -> DataFrame:
    """Rows with (_level, _bin, _own): at its own level, where bins are about as wide as the
    interval, and at every coarser one."""
    length = (C(end) - C(start)).cast("double")
    own = F.lit(0)
    for k in range(1, levels):
        own = F.when(length >= width * 8 ** (k - 1), k).otherwise(own)
    df = df.withColumn("_at", own).withColumn("_level", F.explode(F.sequence(C("_at"), F.lit(levels - 1))))
    size = F.lit(width) * F.pow(F.lit(8), C("_level")).cast("long")
    df = df.withColumn("_own", C("_level") == C("_at")).drop("_at")
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(C(start) / size), F.floor(C(end) / size))))


def _met(left: DataFrame, right: DataFrame, cols: tuple[str, str, str, str], width: int, levels: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in bins, the right one with prefixes, and what has to be equal for rows to meet.

    One of two rows has to be at its own level. So ``_own`` rows of the left meet all of a bin, and
    the others only the right's own rows, which are there once for either. Two short rows that share
    a wide bin never meet there, and a bin as wide as a chromosome does not pair all of its rows.
    """
    ls, le, rs, re_ = cols
    r = _binned(right.select(*[C(c).alias(f"r_{c}") for c in right.columns]), rs, re_, width, levels)
    both = F.array(F.lit(True), F.lit(False)) if levels > 1 else F.array(F.lit(True))
    r = r.withColumn("_to", F.explode(F.when(C("_own"), both).otherwise(F.array(F.lit(True))))).drop("_own")
    r = r.withColumnsRenamed({"_level": "r__level", "_bin": "r__bin", "_to": "r__own"})
    return _binned(left, ls, le, width, levels), r, ["_level", "_bin", "_own"]


def range_join(left: DataFrame, right: DataFrame, mode: str = "closed", how: str = "inner", width: int = BIN, key: str = "chr", l_cols=("start", "end"), r_cols=("start", "end"), levels: int = 1) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``key`` whose intervals relate by ``mode``:
    'closed' (share a point), 'open' (share more than a point) or 'contained' (right in left).

    Both sides are cut into bins and meet by equality of (key, level, bin); a pair meets at
    the coarser of its levels, and counts in the bin where its common part starts. With one
    level an interval is in every bin of ``width`` that it touches, which suits tables of
    short intervals; each further level has bins 8 times as wide, for tables that also have
    long ones. Right columns come with an ``r_`` prefix.
    """
    (ls, le), (rs, re_) = l_cols, (f"r_{r_cols[0]}", f"r_{r_cols[1]}")
    lft, r, equal = _met(left, right, (ls, le, rs, re_), width, levels)
    tests: dict[str, Column] = {"closed": (C(rs) <= C(le)) & (C(re_) >= C(ls)), "open": (C(rs) < C(le)) & (C(re_) > C(ls)), "contained": (C(rs) >= C(ls)) & (C(re_) <= C(le))}
    size = F.lit(width) * F.pow(F.lit(8), C("_level")).cast("long")
    once = C("_bin") == F.floor(F.greatest(ls, rs) / size)
    meet = C(key) == C(f"r_{key}")
    for k in equal:
        meet = meet & (C(k) == C(f"r_{k}"))
    met = lft.join(merged(r), meet & once & tests[mode]).drop(*equal, *[f"r_{k}" for k in equal])
    if how == "inner":
        return met
    if how not in ("left_semi", "left_anti"):
        raise ValueError("how is inner, left_semi or left_anti")
    keys = met.select(*left.columns).distinct()
    cond = F.lit(True)
    for c in left.columns:
        cond = cond & left[c].eqNullSafe(keys[c])
    return left.join(keys, cond, how)


def interval_coverage(regions: DataFrame, concordant: DataFrame, width: int = BIN) -> DataFrame:
    """(region_id, n): concordant fragments with f_start < end and f_end > start, for
    regions with start < end.

    Counted without a range join: fragments that start before the region's end, less those
    that end at or before its start. Both are ranks in one sorted event table per
    chromosome, so neither long regions nor deep coverage multiply rows.
    """
    points = regions.select("chr", C("end").alias("pos"), C("region_id"), F.lit(1).alias("sign"), F.lit(0).alias("kind")).unionByName(
        regions.select("chr", C("start").alias("pos"), C("region_id"), F.lit(-1).alias("sign"), F.lit(1).alias("kind"))
    )
    starts = ranks(points.where("kind = 0"), concordant.select("chr", C("f_start").alias("pos")), strict=True, width=width)
    ends = ranks(points.where("kind = 1"), concordant.select("chr", C("f_end").alias("pos")), strict=False, width=width)
    both = starts.unionByName(ends).groupBy("region_id").agg(F.sum(C("sign") * C("n")).alias("n"))
    return both


def ranks(points: DataFrame, values: DataFrame, strict: bool, width: int = BIN) -> DataFrame:
    """``points`` with ``n``, how many ``values`` of its chr are below (or at) ``pos``. Values
    with a column ``k`` count as their k.

    Values are summed per (chr, bin) with partial sums, a running sum over bins gives the
    count before a bin, and inside the bin a running sum over the events of that bin. No
    window holds more than one bin's events or one chromosome's bins.
    """
    cell = F.floor(C("pos") / width).alias("bin")
    if "k" not in values.columns:
        values = values.withColumn("k", F.lit(1))
    per_bin = values.groupBy("chr", cell).agg(F.sum("k").alias("k"))
    marks = per_bin.select("chr", "bin", "k", F.lit(0).alias("ask")).unionByName(points.select("chr", cell, F.lit(0).cast("long").alias("k"), F.lit(1).alias("ask")).distinct())
    run = Window.partitionBy("chr").orderBy("bin", F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1)
    before = marks.withColumn("before", F.coalesce(F.sum("k").over(run), F.lit(0))).where("ask = 1").select("chr", "bin", "before")
    distinct_values = values.groupBy("chr", cell, "pos").agg(F.sum("k").alias("k"))
    names = points.columns
    events = distinct_values.select("chr", "bin", "pos", "k", F.lit(1 if strict else 0).alias("ask"), F.lit(None).alias("row")).unionByName(
        points.select("chr", cell, "pos", F.lit(0).cast("long").alias("k"), F.lit(0 if strict else 1).alias("ask"), F.struct(*names).alias("row"))
    )
    inside = Window.partitionBy("chr", "bin").orderBy("pos", "ask").rowsBetween(Window.unboundedPreceding, 0)
    got = events.withColumn("in_bin", F.sum("k").over(inside)).where("row is not null")
    return got.join(merged(before), ["chr", "bin"]).select("row.*", (C("before") + C("in_bin")).alias("n"))


def point_coverage(points: DataFrame, concordant: DataFrame, width: int = BIN) -> DataFrame:
    """(chr, pos, n) for distinct points: fragments with f_start <= pos <= f_end."""
    return ranks(points.select("chr", "pos").distinct(), steps(concordant), strict=False, width=width)


def steps(concordant: DataFrame) -> DataFrame:
    """(chr, pos, k): where fragments start, k = 1, and where they have just ended, k = -1. A
    fragment without both ends is not counted."""
    whole = concordant.where("chr is not null and f_start is not null and f_end is not null")
    return whole.select("chr", C("f_start").alias("pos"), F.lit(1).alias("k")).unionByName(whole.select("chr", (C("f_end") + 1).alias("pos"), F.lit(-1).alias("k")))


def mean_uniqueness(regions: DataFrame, track: DataFrame, max_value: float, width: int = BIN) -> DataFrame:
    """(region_id, uniqueness): mean over a region's bases of the track's value, where
    bases without a track row count ``max_value``; 1.0 for an empty region."""
    met = range_join(regions, track, "closed", width=width, r_cols=("u_start", "u_end"), levels=5)
    part = F.least("end", "r_u_end") - F.greatest("start", "r_u_start")
    sums = met.where(part > 0).groupBy("region_id").agg(F.sum(part).alias("bases"), F.sum(part * C("r_value")).alias("weighted"))
    length = (C("end") - C("start")).cast("double")
    out = regions.join(merged(sums), "region_id", "left")
    bases, weighted = F.coalesce("bases", F.lit(0)), F.coalesce("weighted", F.lit(0))
    mean = (weighted.cast("double") + (length - bases) * F.lit(float(max_value))) / length
    return out.select("region_id", F.when(length > 0, mean).otherwise(F.lit(1.0)).alias("uniqueness"))


def merge_intervals(df: DataFrame, start: str = "start", end: str = "end", key: str = "chr", width: int = 1_000_000) -> DataFrame:
    """Unions of intervals of a key that overlap or touch.

    Windows hold one bin's intervals; what reaches a bin from earlier ones (the farthest
    end, and where the last union began) comes from running values over one row per bin.
    """
    rows = df.select(C(key).alias("k"), C(start).alias("s"), C(end).alias("e")).where("s is not null and e is not null").withColumn("bin", F.floor(C("s") / width))
    bins = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("k", "bin").orderBy("s", "e")
    far = rows.groupBy("k", "bin").agg(F.max("e").alias("m")).withColumn("reach", F.max("m").over(bins)).drop("m")
    rows = rows.join(merged(far), ["k", "bin"])
    seen = F.greatest(F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), C("reach"))
    rows = rows.withColumn("began", F.when(seen.isNull() | (C("s") > seen), C("s")))
    last = rows.groupBy("k", "bin").agg(F.max("began").alias("b")).withColumn("carried", F.max("b").over(bins)).drop("b")
    own = F.max("began").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(merged(last), ["k", "bin"]).withColumn("first", F.coalesce("own", "carried"))
    return rows.groupBy(C("k").alias(key), "first").agg(F.max("e").alias(end)).select(key, C("first").alias(start), end)


def relevant_points(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points inside some interval: what coverage is worth computing for."""
    merged = merge_intervals(intervals)
    as_rows = points.withColumns({"start": C("pos"), "end": C("pos")})
    return range_join(as_rows, merged, "closed").select(*points.columns).distinct()
