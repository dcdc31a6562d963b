"""Matching clusters with array copy-number segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as g
from strandline.functions.once import merged, with_once
from strandline.operators.depth import range_join

C = F.col


def _extents(clusters: DataFrame) -> DataFrame:
    """Each cluster's extent along a and b: its region's, or its members' if it has none."""
    box, found = g.region_box(), C("area") > 0
    return with_once(clusters, {
        "a_from": F.when(found, box["a_min"]).otherwise(C("left_min")), "a_to": F.when(found, box["a_max"]).otherwise(C("left_max")),
        "b_from": F.when(found, box["b_min"]).otherwise(C("right_min")), "b_to": F.when(found, box["b_max"]).otherwise(C("right_max")),
    })


def cgh_join(cgh: DataFrame, clusters: DataFrame, min_size: int = 4) -> DataFrame:
    """(cgh_id, cluster_id, axis): segments that share more than a point with a cluster's
    extent. On one chromosome either axis matches (axis 'xy'); between two, the left
    extent matches segments of the left chromosome (axis 'x') and the right one of the
    right ('y')."""
    c = _extents(clusters.where(C("num_prs") >= min_size))
    seg = cgh.select("chr", C("c_start").alias("start"), C("c_end").alias("end"), F.concat_ws("-", "probe1", "probe2").alias("cgh_id"))
    one = C("chr_l") == C("chr_r")
    left = c.select("cluster_id", C("chr_l").alias("chr"), C("a_from").alias("start"), C("a_to").alias("end"), F.when(one, "xy").otherwise("x").alias("axis"))
    right = c.select("cluster_id", C("chr_r").alias("chr"), C("b_from").alias("start"), C("b_to").alias("end"), F.when(one, "xy").otherwise("y").alias("axis"))
    return range_join(left.unionByName(right), seg, "open", levels=5).select(C("r_cgh_id").alias("cgh_id"), "cluster_id", "axis").distinct()


def cgh_pair_join(cgh: DataFrame, clusters: DataFrame, min_size: int = 4) -> DataFrame:
    """(cgh_id1, cgh_id2, cluster_id): ordered pairs of segments, a segment with itself
    included, whose rectangle meets the cluster's region in a positive area.

    The rectangle of all segment pairs is not built: segments that meet the region's a
    extent and those that meet its b extent are joined by cluster, then tested exactly.
    """
    box = g.region_box()
    c = clusters.where((C("num_prs") >= min_size) & (C("area") > 0))
    c = with_once(c, box)
    seg = cgh.select("chr", C("c_start").alias("start"), C("c_end").alias("end"), F.concat_ws("-", "probe1", "probe2").alias("cgh_id"))
    a = range_join(c.select("cluster_id", C("chr_l").alias("chr"), C("a_min").alias("start"), C("a_max").alias("end")), seg, "open", levels=5)
    b = range_join(c.select("cluster_id", C("chr_r").alias("chr"), C("b_min").alias("start"), C("b_max").alias("end")), seg, "open", levels=5)
    a = a.select("cluster_id", C("r_cgh_id").alias("cgh_id1"), C("r_start").alias("x0"), C("r_end").alias("x1"))
    b = b.select("cluster_id", C("r_cgh_id").alias("cgh_id2"), C("r_start").alias("y0"), C("r_end").alias("y1"))
    both = a.join(merged(b), "cluster_id").join(merged(c.select("cluster_id", "same", *g.BOUNDS)), "cluster_id")
    k = g.closed_bounds()
    cut = both.select("cgh_id1", "cgh_id2", "cluster_id", "same", F.greatest("x0", k["a_lo"]).alias("a_lo"), F.least("x1", k["a_hi"]).alias("a_hi"), F.greatest("y0", k["b_lo"]).alias("b_lo"), F.least("y1", k["b_hi"]).alias("b_hi"), "s0", "s1")
    return cut.where(g.region_area() > 0).select("cgh_id1", "cgh_id2", "cluster_id")


def cgh_report(matches: DataFrame) -> DataFrame:
    """(cgh_id, n, clusters): each segment's clusters once, sorted."""
    once = matches.select("cgh_id", "cluster_id").distinct()
    return once.groupBy("cgh_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("cluster_id"))).alias("clusters"))
