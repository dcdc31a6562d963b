"""Queries over files: tables are written below the shared folder in a source's format, and
read again by the reader under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import work
from strandline.functions import geometry as g
from strandline.operators import assign, clusters, filtering, preprocess
from strandline.plans.catalog import _INTERVAL_LLR, _LIB, _NEAREST, _VTYPE, _alignments, _clusters, _links, _paired, _pr, _prs, _scored, _typed, length_histogram, query
from strandline.plans.oracle import sql
from strandline.sources import fixtures, text

C = F.col
_PR = ("name", "chr_l", "l_start", "l_end", "l_or", "chr_r", "r_start", "r_end", "r_or")


def _written(df: DataFrame, *columns, sep: str = "\t", label: str = "lines") -> str:
    path = work.new_path(df.sparkSession, label)
    df.select(F.concat_ws(sep, *[C(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")).write.text(path)
    return path


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- sources ---------------------------------------------------------------------------


@query("SELECT 'group' AS kind, 'rg' || n_nationkey AS name, n_name AS what, 0::BIGINT AS length FROM nation UNION ALL SELECT 'reference', 'chr' || s_suppkey, '-', 1000 + s_suppkey FROM supplier UNION ALL SELECT 'genome', 'all', 'illumina', sum(1000 + s_suppkey)::BIGINT FROM supplier")
def sam_header(spark, sf):
    groups = _table(spark, sf, "nation").select(F.concat(F.lit("@RG\tID:rg"), "n_nationkey", F.lit("\tPL:ILLUMINA\tLB:"), "n_name").alias("value"))
    refs = _table(spark, sf, "supplier").select(F.concat(F.lit("@SQ\tSN:chr"), "s_suppkey", F.lit("\tLN:"), (C("s_suppkey") + 1000).cast("string")).alias("value"))
    path = work.new_path(spark, "header")
    groups.unionByName(refs).write.text(path)
    _, rg, sq = text.read_sam(spark, path)
    whole = spark.createDataFrame([("genome", "all", text.check_platforms(rg), text.genome_length(sq))], "kind string, name string, what string, length long")
    out = rg.select(F.lit("group").alias("kind"), C("id").alias("name"), C("library").alias("what"), F.lit(0).cast("long").alias("length"))
    return out.unionByName(sq.select(F.lit("reference").alias("kind"), "name", F.lit("-").alias("what"), "length")).unionByName(whole)


@query(sql(["pr"], f"SELECT {', '.join(_PR)}, CAST(120 AS BIGINT) AS lmin, CAST(480 AS BIGINT) AS lmax FROM pr"))
def pairs_read(spark, sf):
    path = work.new_path(spark, "pairs")
    text.pr_to_text(_pr(spark, sf)).write.text(path)
    return text.read_pr(spark, path, 120, 480)


@query(sql(["pr"], "SELECT sample, name, chr_l, l_start, r_or, CAST(100 + sample AS BIGINT) AS lmin, CAST(400 + sample AS BIGINT) AS lmax FROM pr"))
def manifest_read(spark, sf):
    """One file a sample, each with its own bounds, in one manifest."""
    root = work.new_path(spark, "manifest")
    pr = _pr(spark, sf)
    lines = []
    for k in range(3):
        text.pr_to_text(pr.where(C("sample") == k)).coalesce(1).write.text(f"{root}/sample{k}")
        lines += [(f"{p}\tPR\t{100 + k}\t{400 + k}",) for p in spark.read.text(f"{root}/sample{k}").inputFiles()]
    spark.createDataFrame([*lines, ("# a comment",)], "value string").coalesce(1).write.text(f"{root}/list")
    got = text.read_manifest(spark, f"{root}/list")
    return got.select(F.regexp_extract("source", r"/sample(\d)/", 1).cast("long").alias("sample"), "name", "chr_l", "l_start", "r_or", "lmin", "lmax")


@query(sql(["cgh"], "SELECT chr, c_start AS start, c_end AS \"end\", false AS is_inversion, c_start AS a_lo, c_start + 300 AS a_hi, c_end - 300 AS b_lo, c_end AS b_hi FROM cgh UNION ALL SELECT chr, c_start, c_end, true, c_start - 300, c_start + 300, c_end - 300, c_end + 300 FROM cgh"))
def intervals_read(spark, sf):
    path = _written(fixtures.load(spark, sf, "cgh"), F.concat(F.lit("chr"), "chr"), "c_start", "c_end")
    return text.read_intervals(spark, path, 300).unionByName(text.read_intervals(spark, path, 300, True))


@query(sql(["cgh"], "SELECT probe1, probe2, chr, c_start, c_end FROM cgh"))
def cgh_read(spark, sf):
    return text.read_cgh(spark, _written(fixtures.load(spark, sf, "cgh"), "probe1", "probe2", "chr", "c_start", "c_end"))


@query(sql(["concordant", "uniqueness"], "SELECT 'fragment' AS kind, chr, f_start AS start, f_end AS \"end\", CAST(0 AS DOUBLE) AS value FROM concordant UNION ALL SELECT 'unique', chr, u_start, u_end, value FROM uniqueness"))
def tracks_read(spark, sf):
    c = text.read_concordant(spark, _written(fixtures.load(spark, sf, "concordant"), "chr", "f_start", "f_end"))
    u = text.read_uniqueness(spark, _written(fixtures.load(spark, sf, "uniqueness"), "chr", "u_start", "u_end", "value"))
    frag = c.select(F.lit("fragment").alias("kind"), "chr", C("f_start").alias("start"), C("f_end").alias("end"), F.lit(0.0).alias("value"))
    return frag.unionByName(u.select(F.lit("unique").alias("kind"), "chr", C("u_start").alias("start"), C("u_end").alias("end"), "value"))


@query(sql(["pr"], "SELECT 'c' || fragment_id AS cluster_id, count(*)::BIGINT AS n FROM pr GROUP BY 1"))
def split_counts_read(spark, sf):
    counts = _pr(spark, sf).groupBy(F.concat(F.lit("c"), "fragment_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    return text.read_split_reads(spark, _written(counts, "cluster_id", "n"))


@query(sql(["reads"], "SELECT name, CAST(chr * 10 AS INTEGER) AS chr, pos FROM reads WHERE chr <= 3"))
def chromosomes_mapped(spark, sf):
    reads = _alignments(spark, sf)
    ids = reads.select("chr").distinct().where("cast(chr as int) <= 3").withColumn("id", C("chr").cast("int") * 10)
    return preprocess.map_chromosomes(reads, text.read_chr_map(spark, _written(ids, "chr", "id", sep=" "))).select("name", "chr", "pos")


@query(sql(["reads"], "SELECT CAST(chr AS VARCHAR) AS chr, count(*)::BIGINT AS n FROM reads WHERE chr > 3 GROUP BY 1"))
def references_skipped(spark, sf):
    reads = _alignments(spark, sf)
    known = reads.select(C("chr").alias("name")).distinct().where("cast(name as int) <= 3").withColumn("id", C("name").cast("int"))
    return preprocess.skipped_references(reads, known)


# --- sinks -----------------------------------------------------------------------------


@query(sql(["mates", "classed"], f"SELECT m.name, {_LIB.replace('mates.name', 'm.name')} AS library, {_VTYPE} AS vtype, a_pos AS l_start, b_pos + 49 AS r_end FROM mates m WHERE route = 'pair' AND {_VTYPE} <> 'CONC'"))
def discordants_written(spark, sf):
    path = work.new_path(spark, "discordants")
    text.write_discordants(_typed(spark, sf), path)
    return spark.read.parquet(path).select("name", "library", "vtype", "l_start", "r_end")


@query(sql(["mates"], "SELECT name, route FROM mates WHERE route <> 'pair'"))
def low_quality_written(spark, sf):
    path = work.new_path(spark, "low")
    text.write_low_quality(_paired(spark, sf), path)
    return spark.read.parquet(path).select("name", "route")


@query(sql(["mates", "classed", "hist"], "SELECT concat_ws(chr(9), 'out_' || library || '.' || kind, 'PR', 150, 320) AS value FROM (SELECT DISTINCT library FROM hist), (SELECT unnest(['deletion', 'inversion', 'divergent', 'translocation']) AS kind) UNION ALL SELECT concat_ws(chr(9), library, 150, 320, CAST(floor(sum(length*n) / sum(n) + 0.5) AS BIGINT)) FROM hist GROUP BY library"))
def metadata_lines(spark, sf):
    """Manifest lines, and the info lines without their last field."""
    bounds = preprocess.length_bounds(length_histogram(spark, sf), "EXACT=150,320")
    info = text.library_info(bounds).select(F.array_join(F.slice(F.split("value", "\t"), 1, 4), "\t").alias("value"))
    return text.batch_manifest(bounds, "out").unionByName(info)


@query(sql(["mates"], f"SELECT key, CASE WHEN key = 'ConcordantFile' THEN 'out_all.concordant' ELSE CAST(round(v, 4) AS VARCHAR) END AS value FROM (SELECT unnest(['ConcordantFile', 'Lavg', 'ReadLen']) AS key, unnest([0.0, lavg, 50.0]) AS v FROM (SELECT avg(b_pos+50-a_pos) AS lavg FROM mates WHERE route = 'pair' AND {_VTYPE} = 'CONC'))"))
def depth_lines(spark, sf):
    f = F.split("value", ": ")
    lines = text.depth_manifest(preprocess.depth_params(_typed(spark, sf)), "out").where(~C("value").startswith("Lambda"))
    number = F.round(f[1].try_cast("double"), 4).cast("string")
    return lines.select(f[0].alias("key"), F.coalesce(number, f[1]).alias("value"))


@query(sql(["clusters", "concordant", "uniqueness"], f"SELECT cluster_id, best_a, best_b, cov_l, map_l FROM ({_INTERVAL_LLR})"))
def coverage_written(spark, sf):
    path = work.new_path(spark, "coverage")
    text.coverage_lines(_scored(spark, sf)[1]).write.text(path)
    return text.read_coverage(spark, path).where("code = 1").select("cluster_id", "best_a", "best_b", "cov_l", F.round("map_l", 6).alias("map_l"))


@query(sql(["frag_roots"], "SELECT 'cluster' AS kind, id AS name, root AS component_id, 0::BIGINT AS n FROM frag_roots UNION ALL SELECT 'size', CAST(n AS VARCHAR), '-', count(*)::BIGINT FROM (SELECT root, count(*) AS n FROM frag_roots GROUP BY 1) GROUP BY n"))
def components_written(spark, sf):
    path = work.new_path(spark, "components")
    text.write_components(work.materialize(assign.fragment_components(_links(spark, sf)), "found"), path)
    own = spark.read.parquet(f"{path}/components").select(F.lit("cluster").alias("kind"), C("cluster_id").alias("name"), "component_id", F.lit(0).cast("long").alias("n"))
    sizes = spark.read.parquet(f"{path}/summary").select(F.lit("size").alias("kind"), C("clusters").cast("string").alias("name"), F.lit("-").alias("component_id"), C("components").alias("n"))
    return own.unionByName(sizes)


# --- rows that other queries only count, and options -----------------------------------


@query(sql(["checked"], "SELECT coalesce(reject_reason, 'ok') AS reason, CAST(count(*) AS BIGINT) AS n FROM checked GROUP BY 1"))
def pairs_counted(spark, sf):
    """Pairs and the counts of their rejects from one job."""
    pairs, counts = clusters.valid_pairs_counted(_pr(spark, sf))
    work.materialize(pairs, "pairs")
    return spark.createDataFrame(sorted(counts().items()), "reason string, n long")


@query(sql(["prs"], "SELECT name, s0 FROM prs ORDER BY s0, name"))
def pairs_sorted_by_band(spark, sf):
    return filtering.sort_by_band(_prs(spark, sf)).select("name", "s0")


@query(sql(["clusters"], f"SELECT cluster_id, CAST({_NEAREST.format('a')} AS BIGINT) AS point_a, CAST({_NEAREST.format('b')} AS BIGINT) AS point_b FROM clusters"))
def cluster_points(spark, sf):
    return _clusters(spark, sf).select("cluster_id", "point_a", "point_b")


def _flip(c: str) -> str:
    return f"CASE WHEN {c} = '+' THEN '-' ELSE '+' END"


@query(sql(["mates", "reads"], f"SELECT name, 'matepair' AS platform, {_flip('a_strand')} AS l_or, {_flip('b_strand')} AS r_or FROM mates UNION ALL SELECT m.name, 'solid', a_strand, CASE WHEN (r.flag & 128) <> 0 THEN {_flip('b_strand')} ELSE b_strand END FROM mates m JOIN reads r ON r.ord = m.b_ord"))
def platform_flips(spark, sf):
    pairs = preprocess.pair_mates(preprocess.classify_reads(fixtures.load(spark, sf, "reads")))
    parts = [preprocess.pair_geometry(pairs, p).select("name", F.lit(p).alias("platform"), "l_or", "r_or") for p in ("matepair", "solid")]
    return parts[0].unionByName(parts[1])


@query(sql(["mates", "classed", "hist"], "SELECT library, CASE library WHEN 'lib0' THEN 140 ELSE greatest(0, mean - 2*std) END::BIGINT AS lmin, CASE library WHEN 'lib0' THEN 333 ELSE mean + 2*std END::BIGINT AS lmax FROM (SELECT library, mean, CAST(floor(sqrt(sum(n*(length-mean)*(length-mean)) / sum(n)) + 0.5) AS BIGINT) AS std FROM hist JOIN (SELECT library, CAST(floor(sum(length*n) / sum(n) + 0.5) AS BIGINT) AS mean FROM hist GROUP BY 1) USING (library) GROUP BY 1, 2) WHERE library <> 'lib2'"))
def length_bounds_by_library(spark, sf):
    return preprocess.library_cutoffs(length_histogram(spark, sf), {"lib0": "EXACT=140,333", "lib1": "SD=2"}).select("library", "lmin", "lmax")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'f.' || o_orderkey WHEN 1 THEN 'f' WHEN 2 THEN 'f.x.1_2_3y' WHEN 3 THEN 'f.1_2' ELSE 'f.a' END AS fragment FROM orders")
def fragment_names_odd(spark, sf):
    """Names with and without a mapping's suffix, and with what only looks like one."""
    k = C("o_orderkey")
    key = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("f."), key, F.lit(".7__12"))).when(k % 5 == 1, F.lit("f")).when(k % 5 == 2, F.lit("f.x.1_2_3y")).when(k % 5 == 3, F.lit("f.1_2")).otherwise(F.concat(F.lit("f.a."), key, F.lit("_0_0")))
    return _table(spark, sf, "orders").select(k.alias("k"), g.fragment_name(name).alias("fragment"))
