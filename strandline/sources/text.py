"""Text sources and sinks: alignments, pairs, intervals, segments, tracks, clusters, parameters."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, fields
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import geometry as g
from strandline.sources import bam

C = F.col
SAM = ("name", "flag", "chr", "pos", "mapq", "cigar", "mate_chr", "mate_pos", "tlen", "seq", "qual")
_COMPLEMENT = ("ACGTNacgtn", "TGCANtgcan")


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).withColumn("f", F.split(F.trim("value"), r"\s+"))


def _rows(lines: DataFrame, *widths: int) -> DataFrame:
    """Lines that are no comments and have one of these numbers of columns."""
    return lines.where(~F.trim("value").startswith("#") & F.size("f").isin(*widths))


def read_sam(spark: SparkSession, path, stringency: str = "silent") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, read_groups, references) of SAM text.

    silent and lenient drop records with fewer than 11 fields or no number where one has
    to be; strict fails the job that reads them. read_groups: id, library, platform.
    references: name, length. ``read_bam`` gives the same of binary alignments.
    """
    _check_stringency(stringency)
    text = spark.read.text(path)
    f = F.split("value", "\t")
    body = text.where(~C("value").startswith("@") & (F.length("value") > 0)).withColumn("f", f)
    number = {"flag", "pos", "mapq", "mate_pos", "tlen"}
    cols = [(C("f")[k].try_cast("int") if n in number else C("f")[k]).alias(n) for k, n in enumerate(SAM)]
    group = F.get(F.filter("f", lambda v: v.startswith("RG:Z:")), 0)
    good = (F.size("f") >= 11) & C("f")[1].try_cast("int").isNotNull() & C("f")[3].try_cast("int").isNotNull() & C("f")[4].try_cast("int").isNotNull()
    if stringency == "strict":
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad alignment record: "), C("value"))).cast("boolean"))
    body = body.where(F.coalesce(good, F.lit(False))) if stringency != "strict" else body.where(good)
    reads = body.select(*cols, F.substring(group, 6, 1000).alias("read_group"))
    return _with_strand(reads), *_header_tables(text)


def read_bam(spark: SparkSession, path: str, stringency: str = "silent", split_size: int = 64 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_sam``, from a binary file or a folder of such, in parts of ``split_size``
    bytes. A file that ends early gives what it holds, and a warning; strict is an error."""
    _check_stringency(stringency)
    lines = bam.read_header(path).splitlines()  # one header, as large as the list of references
    reads = bam.load(spark, path, stringency, split_size)
    return _with_strand(reads), *_header_tables(spark.createDataFrame([(v,) for v in lines], "value string"))


def write_bam(reads: DataFrame, path: str, references: list[tuple[str, int]], read_groups: list[tuple[str, str]] = ()) -> None:
    """Alignments (columns as of ``read_sam``) as a folder of binary files, one per task.
    References are (name, length), read groups (id, library)."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in references) + "".join(f"@RG\tID:{i}\tLB:{lib}\n" for i, lib in read_groups)
    bam.save(reads, path, "@HD\tVN:1.6\n" + text)


def _check_stringency(stringency: str) -> None:
    if stringency not in ("silent", "lenient", "strict"):
        raise ValueError("stringency is silent, lenient or strict")


def _with_strand(reads: DataFrame) -> DataFrame:
    return reads.withColumn("strand", F.when(C("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")).withColumn("read_len", F.length("seq"))


def _header_tables(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_groups, references) of header lines."""
    header = text.where(C("value").startswith("@"))

    def tag(t: str) -> Column:
        return F.nullif(F.regexp_extract("value", rf"\t{t}:([^\t]*)", 1), F.lit(""))

    groups = header.where(C("value").startswith("@RG")).select(tag("ID").alias("id"), F.coalesce(tag("LB"), tag("ID")).alias("library"), F.lower(tag("PL")).alias("platform"))
    refs = header.where(C("value").startswith("@SQ")).select(tag("SN").alias("name"), tag("LN").cast("long").alias("length"))
    return groups, refs


def genome_length(references: DataFrame, default: int = 3_000_000_000) -> int:
    return references.agg(F.sum("length")).first()[0] or default


def check_platforms(read_groups: DataFrame) -> str | None:
    """The one platform of all read groups; an error if they differ."""
    found = [r[0] for r in read_groups.select("platform").where("platform is not null").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"read groups have different platforms: {sorted(found)}")
    return found[0] if found else None


def read_pr(spark: SparkSession, path, lmin: int = 100, lmax: int = 400) -> DataFrame:
    """Pairs of nine columns. Lines of other widths and rows without numbers are dropped."""
    out = _pr_columns(_rows(_lines(spark, path), 9))
    return out.withColumns({"lmin": F.lit(lmin).cast("long"), "lmax": F.lit(lmax).cast("long")})


def _pr_columns(rows: DataFrame, *others: str) -> DataFrame:
    f = C("f")
    out = rows.select(
        f[0].alias("name"), g.norm_chr(f[1]).alias("chr_l"), f[2].try_cast("int").alias("l_start"), f[3].try_cast("int").alias("l_end"), f[4].alias("l_or"),
        g.norm_chr(f[5]).alias("chr_r"), f[6].try_cast("int").alias("r_start"), f[7].try_cast("int").alias("r_end"), f[8].alias("r_or"), *others,
    )
    return out.dropna(subset=["l_start", "l_end", "r_start", "r_end"])


@dataclass(frozen=True)
class ManifestRow:
    path: str
    kind: str
    lmin: int
    lmax: int


def parse_manifest(lines, lmin: int = 100, lmax: int = 400) -> list[ManifestRow]:
    """Rows 'file type [lmin lmax]' with type PR, ESP or CGH."""
    out = []
    for line in lines:
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if len(f) not in (2, 4) or f[1] not in ("PR", "ESP", "CGH"):
            raise ValueError(f"bad manifest line: {line!r}")
        out.append(ManifestRow(f[0], f[1], *(map(int, f[2:]) if len(f) == 4 else (lmin, lmax))))
    return out


_STORE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")


def _place(path: str) -> str:
    """A path as Spark names files, without store: scheme and authority go, odd characters are escaped."""
    return quote(_STORE.sub("", path), safe="/!$&'()*+,;=:@-._~")


def _ancestors(file: str) -> list[str]:
    """A path and the folders that it is in."""
    parts = file.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts), 1, -1)]


def read_manifest(spark: SparkSession, path: str, lmin: int = 100, lmax: int = 400) -> DataFrame:
    """All pairs of a manifest's PR and ESP files or folders, with their lmin, lmax and
    ``source``: one scan of all files, joined to the manifest by the file that a line is of.
    Patterns, and paths that hold each other, are scans of their own."""
    rows = parse_manifest([r[0] for r in spark.read.text(path).collect()], lmin, lmax)  # one line per file
    pairs = [r for r in rows if r.kind != "CGH"]
    if not pairs:
        raise ValueError("the manifest has no pair files")
    paths = sorted({r.path for r in pairs})
    by_place = {_place(p).rstrip("/"): p for p in paths}
    lines = _listed(spark, paths)
    owners = {f: [by_place[a] for a in _ancestors(f) if a in by_place] for f in {_STORE.sub("", f) for f in lines.inputFiles()}}
    if len(by_place) < len(paths) or any(len(o) != 1 for o in owners.values()):
        parts = [read_pr(spark, r.path, r.lmin, r.lmax).withColumn("source", F.lit(r.path)) for r in pairs]
        return functools.reduce(DataFrame.unionByName, parts)
    listed: dict[str, list[ManifestRow]] = {}
    for r in pairs:
        listed.setdefault(r.path, []).append(r)
    bounds = [(f, r.path, r.lmin, r.lmax) for f, (p,) in owners.items() for r in listed[p]]
    table = spark.createDataFrame(bounds, "_place string, source string, _lmin long, _lmax long")
    lines = lines.select("value", F.regexp_replace("_metadata.file_path", _STORE.pattern, "").alias("_place")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    out = _pr_columns(_rows(lines, 9), "_place").join(F.broadcast(table), "_place")  # a row per file, as many as the driver listed
    return out.select(*[c for c in out.columns if c[0] != "_" and c != "source"], C("_lmin").alias("lmin"), C("_lmax").alias("lmax"), "source")


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text of all paths, listed by a few tasks a core and not by one a path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.text(paths)
    finally:
        spark.conf.set(key, before)


def read_intervals(spark: SparkSession, path, lmax: int = 400, is_inversion: bool = False) -> DataFrame:
    """Intervals of three or five columns as boxes (a_lo, a_hi, b_lo, b_hi): for a deletion
    [x, x + lmax] x [y - lmax, y], for an inversion [x - lmax, x + lmax] x [y - lmax, y + lmax].
    A row whose start is not below its end fails the job."""
    f = C("f")
    rows = _rows(_lines(spark, path), 3, 5).select(g.norm_chr(f[0]).alias("chr"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))
    rows = rows.withColumn("start", F.when(C("start") < C("end"), C("start")).otherwise(F.raise_error(F.lit("an interval's start is not below its end")).cast("long")))
    back = lmax if is_inversion else 0
    return rows.withColumns({"is_inversion": F.lit(is_inversion), "a_lo": C("start") - back, "a_hi": C("start") + lmax, "b_lo": C("end") - lmax, "b_hi": C("end") + back})


def read_cgh(spark: SparkSession, path) -> DataFrame:
    f = C("f")
    return _rows(_lines(spark, path), 5).select(f[0].alias("probe1"), f[1].alias("probe2"), g.norm_chr(f[2]).alias("chr"), f[3].try_cast("long").alias("c_start"), f[4].try_cast("long").alias("c_end")).dropna(subset=["chr", "c_start", "c_end"])


def read_concordant(spark: SparkSession, path) -> DataFrame:
    f = C("f")
    return _rows(_lines(spark, path), 3).select(g.norm_chr(f[0]).alias("chr"), f[1].try_cast("long").alias("f_start"), f[2].try_cast("long").alias("f_end")).dropna()


def read_uniqueness(spark: SparkSession, path) -> DataFrame:
    f = C("f")
    return _rows(_lines(spark, path), 4).select(g.norm_chr(f[0]).alias("chr"), f[1].try_cast("long").alias("u_start"), f[2].try_cast("long").alias("u_end"), f[3].try_cast("double").alias("value")).dropna()


def read_split_reads(spark: SparkSession, path) -> DataFrame:
    f = C("f")
    return _rows(_lines(spark, path), 2).select(f[0].alias("cluster_id"), f[1].try_cast("long").alias("n")).dropna()


def read_clusters(spark: SparkSession, path) -> DataFrame:
    """Clusters in regions layout, eight tab columns or nine with llr."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~C("value").startswith("#")).withColumn("f", f).where(F.size("f").isin(8, 9))
    f = C("f")
    return rows.select(
        f[0].alias("cluster_id"), f[1].cast("long").alias("num_prs"), f[2].cast("double").alias("localization"), f[3].alias("type"), F.split(f[4], r",\s*").alias("names"),
        g.norm_chr(f[5]).alias("chr_l"), g.norm_chr(f[6]).alias("chr_r"), F.transform(F.split(f[7], r",\s*"), lambda v: v.cast("double").cast("long")).alias("boundary"), F.get(f, 8).cast("double").alias("llr"),
    )


def read_chr_map(spark: SparkSession, path) -> DataFrame:
    f = C("f")
    return _rows(_lines(spark, path), 2).select(f[0].alias("name"), f[1].try_cast("int").alias("id")).dropna()


def parse_params(lines, into=None) -> dict | object:
    """'Key: value' lines with '#' comments as a dict of strings, or as a dataclass
    ``into`` whose field names are the keys in lower case without '_'."""
    found = {}
    for line in lines:
        line = line.split("#", 1)[0].strip()
        if line:
            key, sep, value = line.partition(":")
            if not sep:
                raise ValueError(f"no 'Key: value' line: {line!r}")
            found[key.strip()] = value.strip()
    if into is None:
        return found
    names = {f.name.replace("_", "").lower(): f for f in fields(into)}
    names |= {"lambda": names["lam"]} if "lam" in names else {}
    kinds = {"int": lambda v: int(float(v)), "float": float, "str": str}
    return into(**{f.name: kinds[str(f.type)](v) for k, v in found.items() if (f := names.get(k.lower()))})


def _boundary() -> Column:
    single = C("num_prs") == 1
    ring = F.when(single & C("corners").isNotNull(), C("corners")).otherwise(C("polygon"))
    text = F.array_join(F.transform(ring, lambda p: F.concat_ws(", ", p["a"].cast("string"), p["b"].cast("string"))), ", ")
    return F.when(C("localization") > 0, text).otherwise(F.concat_ws(", ", C("point_a").cast("string"), C("point_b").cast("string")))


HEADERS = {
    "standard": "#Cluster_ID:\tLeftChr:\tLeftBreakPoint:\tRightChr:\tRightBreakPoint:\tNum PRS:\tLocalization:\tType:",
    "reads": "#Cluster_ID:\tLeftChr:\tLeftBreakPoint:\tRightChr:\tRightBreakPoint:\tNum PRS:\tLocalization:\tType:\tList of PRS:",
    "regions": "#Cluster_ID:\tNum PRS:\tLocalization:\tType:\tList of PRS:\t LeftChr:\tRightChr:\tBoundary Points:",
}


def with_polygons(clusters: DataFrame) -> DataFrame:
    out = g.region_polygon(clusters).withColumn("polygon", F.when(C("localization") > 0, C("polygon")))
    return out if "corners" in out.columns else out.withColumn("corners", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))


def format_clusters(clusters: DataFrame, mode: str = "standard", label: str = "cluster_id") -> DataFrame:
    """One text column ``value`` per cluster in standard, reads or regions layout; an
    ``llr`` column, if there, comes last. reads and regions need ``names``."""
    if mode not in HEADERS:
        raise ValueError(f"layout is one of {sorted(HEADERS)}")
    loc = g.short_number(C("localization"))
    left, right = F.concat_ws(",", "left_min", "left_max"), F.concat_ws(",", "right_min", "right_max")
    cols = [C(label), C("chr_l").cast("string"), left, C("chr_r").cast("string"), right, C("num_prs").cast("string"), loc, C("type")]
    if mode == "reads":
        cols.append(F.array_join("names", ", "))
    if mode == "regions":
        clusters = with_polygons(clusters)
        cols = [C(label), C("num_prs").cast("string"), loc, C("type"), F.array_join("names", ", "), C("chr_l").cast("string"), C("chr_r").cast("string"), _boundary()]
    if "llr" in clusters.columns:
        cols.append(C("llr").cast("string"))
    return clusters.select(F.concat_ws("\t", *cols).alias("value"))


def convert_layout(regions: DataFrame, mode: str = "standard") -> DataFrame:
    """Regions-layout clusters (``read_clusters``) in standard or reads layout: breakpoint
    intervals are the least and greatest of the boundary's a and b coordinates."""
    at = F.sequence(F.lit(0), F.size("boundary") - 2, F.lit(2))
    a, b = F.transform(at, lambda k: C("boundary")[k]), F.transform(at, lambda k: C("boundary")[k + 1])
    out = regions.withColumns({"left_min": F.array_min(a), "left_max": F.array_max(a), "right_min": F.array_min(b), "right_max": F.array_max(b)})
    if mode not in ("standard", "reads"):
        raise ValueError("mode is standard or reads")
    if "llr" not in out.columns:
        out = out.withColumn("llr", F.lit(None).cast("double"))
    return format_clusters(out, mode)


def write_clusters(clusters: DataFrame, path: str, mode: str = "standard", header: bool = True, label: str = "cluster_id") -> None:
    """Part files of layout lines; the header is a file of its own that sorts first."""
    format_clusters(clusters, mode, label).write.mode("overwrite").text(path)
    if header:
        spark = clusters.sparkSession
        spark.createDataFrame([(HEADERS[mode],)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def pr_to_text(pr: DataFrame) -> DataFrame:
    names = ("name", "chr_l", "l_start", "l_end", "l_or", "chr_r", "r_start", "r_end", "r_or")
    return pr.select(F.concat_ws("\t", *[C(c).cast("string") for c in names]).alias("value"))


def write_discordants(pairs: DataFrame, path: str) -> None:
    """Discordant pairs, one folder per library and variant type."""
    pairs.where(C("vtype") != "CONC").write.mode("overwrite").partitionBy("library", "vtype").parquet(path)


def write_low_quality(pairs: DataFrame, path: str) -> None:
    """Pairs that are no high-quality ones: one folder per route (low, split)."""
    pairs.where(C("route") != "pair").write.mode("overwrite").partitionBy("route").parquet(path)


def write_routed_alignments(reads: DataFrame, pairs: DataFrame, path: str, references: list[tuple[str, int]], read_groups: list[tuple[str, str]] = ()) -> None:
    """The alignments of pairs that are no high-quality ones, as binary files: one folder per
    route, low and split. Both records of a pair go where the pair goes."""
    for route in ("low", "split"):
        own = reads.join(pairs.where(C("route") == route).select("name").distinct(), "name", "left_semi")
        write_bam(own, f"{path}/{route}", references, read_groups)


def library_info(bounds: DataFrame) -> DataFrame:
    """'.info' lines: library, lmin, lmax, mean, std."""
    return bounds.select(F.concat_ws("\t", *[C(c).cast("string") for c in ("library", "lmin", "lmax", "mean", "std")]).alias("value"))


def batch_manifest(bounds: DataFrame, prefix: str, types=("deletion", "inversion", "divergent", "translocation")) -> DataFrame:
    """Manifest lines, one per library and type."""
    kinds = F.explode(F.array(*[F.lit(t) for t in types]))
    path = F.concat(F.lit(prefix), F.lit("_"), C("library"), F.lit("."), C("kind"))
    return bounds.withColumn("kind", kinds).select(F.concat_ws("\t", path, F.lit("PR"), C("lmin").cast("string"), C("lmax").cast("string")).alias("value"))


def depth_manifest(depth: DataFrame, prefix: str) -> DataFrame:
    """Parameter lines for scoring, from ``depth_params``."""
    lines = F.array(
        F.lit(f"ConcordantFile: {prefix}_all.concordant"), F.concat(F.lit("Lavg: "), C("lavg").cast("string")),
        F.concat(F.lit("ReadLen: "), C("read_len").cast("string")), F.concat(F.lit("Lambda: "), C("lambda").cast("string")),
    )
    return depth.select(F.explode(lines).alias("value"))


COVERAGE = ("cluster_id", "type", "num_prs", "log_p_variant", "log_p_novariant", "best_a", "best_b", "cov_l", "cov_r", "map_l", "map_r", "code")


def coverage_lines(scored: DataFrame) -> DataFrame:
    return scored.select(F.concat_ws("\t", *[C(c).cast("string") for c in COVERAGE]).alias("value"))


def read_coverage(spark: SparkSession, path) -> DataFrame:
    kinds = ("string", "string", "long", "double", "double", "long", "long", "long", "long", "double", "double", "int")
    f = C("f")
    return _rows(_lines(spark, path), 12).select(*[f[k].cast(t).alias(n) for k, (n, t) in enumerate(zip(COVERAGE, kinds, strict=True))])


def write_components(components: DataFrame, path: str) -> None:
    """Component of each cluster, and how many components have how many clusters."""
    from strandline.operators.assign import size_summary

    components.write.mode("overwrite").parquet(f"{path}/components")
    size_summary(components).write.mode("overwrite").parquet(f"{path}/summary")


def write_assignments(assignments: DataFrame, variants: DataFrame, path: str, threshold: float) -> None:
    assignments.write.mode("overwrite").parquet(f"{path}/fragments")
    variants.write.mode("overwrite").parquet(f"{path}/variants")
    assignments.sparkSession.createDataFrame([(float(threshold),)], "threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/threshold")


def sam_to_table(reads: DataFrame) -> DataFrame:
    """Nine columns of each record."""
    return reads.select("name", "flag", "chr", "pos", "mapq", "cigar", "mate_chr", "mate_pos", "tlen")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *_COMPLEMENT))


def sam_to_fastq(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read 1, read 2) as FASTQ text, as sequenced in the record. A record that is neither
    first nor second of its pair fails the job."""
    bit = lambda b: C("flag").bitwiseAND(F.lit(b)) != 0
    side = F.when(bit(64), 1).when(bit(128), 2).otherwise(F.raise_error(F.concat(F.lit("neither first nor second of a pair: "), C("name"))).cast("int"))
    rows = reads.withColumn("_side", side)
    text = F.concat(F.lit("@"), C("name"), F.lit("\n"), C("seq"), F.lit("\n+\n"), C("qual"))
    return tuple(rows.where(C("_side") == k).select(text.alias("value")) for k in (1, 2))
