"""Filters between samples and sources, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.clusters import overlapping

C = F.col


def filter_against(target: DataFrame, reference: DataFrame, nonreciprocal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(retained, removed) of ``target``: pairs that overlap no, or some, reference pair.
    Each side has its own lmin and lmax. Both sides are pr* tables."""
    hit = overlapping(target, reference, nonreciprocal)
    return target.join(hit, "name", "left_anti"), target.join(hit, "name", "left_semi")


def source_counts(members: DataFrame, source: str = "source") -> DataFrame:
    return members.groupBy("cluster_id", source).agg(F.count(F.lit(1)).alias("n"))


def source_limits(members: DataFrame, limits: dict, source: str = "source") -> DataFrame:
    """Cluster ids whose members by source are within limits: {source: (least, most)},
    most None for no limit. A source without members counts 0."""
    sums = [F.count_if(C(source) == s).alias(f"n_{k}") for k, s in enumerate(limits)]
    out = members.groupBy("cluster_id").agg(*sums)
    for k, (least, most) in enumerate(limits.values()):
        out = out.where(C(f"n_{k}") >= least)
        if most is not None:
            out = out.where(C(f"n_{k}") <= most)
    return out.select("cluster_id")


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of tables with equal column names (files of a batch, libraries, stages)."""
    for df in more:
        first = first.unionByName(df)
    return first


def sort_pr(pr: DataFrame) -> DataFrame:
    """By chromosomes, then each end's outer coordinate (start on +, end on -)."""
    left = F.when(C("l_or") == "-", C("l_end")).otherwise(C("l_start"))
    right = F.when(C("r_or") == "-", C("r_end")).otherwise(C("r_start"))
    return pr.orderBy("chr_l", "chr_r", left, right)


def sort_by(df: DataFrame, keys: list[int]) -> DataFrame:
    """By column numbers from 1, descending where negative."""
    order: list[Column] = [C(df.columns[abs(k) - 1]).asc() if k > 0 else C(df.columns[abs(k) - 1]).desc() for k in keys]
    return df.orderBy(*order)


def sort_by_position(prs: DataFrame) -> DataFrame:
    return prs.orderBy(F.abs("x"), "name")


def sort_by_band(prs: DataFrame) -> DataFrame:
    return prs.orderBy("s0", "name")


def max_lmax(pr: DataFrame) -> DataFrame:
    return pr.agg(F.max("lmax").alias("max_lmax"))


def chromosome_pair(pr: DataFrame, chr_l: int, chr_r: int) -> DataFrame:
    """One chromosome pair; on a table partitioned by them, a partition filter."""
    return pr.where((C("chr_l") == chr_l) & (C("chr_r") == chr_r))
