"""All queries of the engine by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import work
from strandline.functions import geometry as g
from strandline.functions import likelihood as lk
from strandline.functions.once import merged
from strandline.operators import assign, cgh, clusters, depth, filtering, preprocess, prune, scoring
from strandline.plans import pipelines
from strandline.plans.oracle import sql
from strandline.sources import fixtures, text

C = F.col
MIN_SIZE = 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with SQL if there is some."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return wrap


def _pr(spark, sf) -> DataFrame:
    return fixtures.load(spark, sf, "pr")


def _prs(spark, sf) -> DataFrame:
    return clusters.valid_pairs(_pr(spark, sf))


def _slim(prs: DataFrame, *more: str) -> DataFrame:
    """What clusters and their summaries need of pairs, for that is what their shuffle moves."""
    return prs.select(*clusters.KEPT, "lmin", "lmax", *more)


def _members(spark, sf, *more: str) -> DataFrame:
    return clusters.cluster_members(_slim(_prs(spark, sf), *more))


def _clusters(spark, sf) -> DataFrame:
    return clusters.summarize(_members(spark, sf))


def _clusters_again(spark, sf) -> DataFrame:
    """Clusters of the table in which calls are redundant."""
    prs = clusters.valid_pairs(fixtures.load(spark, sf, "pr_again"))
    return clusters.summarize(clusters.cluster_members(_slim(prs)))


_SUMMARY = ["cluster_id", "chr_l", "chr_r", "num_prs", "type", "left_min", "left_max", "right_min", "right_max"]
_LEFT = "CAST(CASE WHEN area > 0 THEN a_min ELSE na_min END AS BIGINT) AS left_min, CAST(CASE WHEN area > 0 THEN a_max ELSE na_max END AS BIGINT) AS left_max, CAST(CASE WHEN area > 0 THEN b_min ELSE nb_min END AS BIGINT) AS right_min, CAST(CASE WHEN area > 0 THEN b_max ELSE nb_max END AS BIGINT) AS right_max"
_SHORT = "CASE WHEN area > 0 THEN round(localization, 6) ELSE -1.0 END AS localization"


def _shown(c: DataFrame) -> DataFrame:
    return c.select(*_SUMMARY, F.when(C("area") > 0, F.round("localization", 6)).otherwise(-1.0).alias("localization"))


# --- pairs -----------------------------------------------------------------------------


@query(sql(["checked"], "SELECT name, chr_l, chr_r, x, y, sx, sy, same, s0, s1 FROM checked WHERE reject_reason IS NULL"))
def pairs_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _prs(spark, sf).select("name", "chr_l", "chr_r", "x", "y", "sx", "sy", "same", "s0", "s1")


@query(sql(["checked"], "SELECT coalesce(reject_reason, 'ok') AS reason, CAST(count(*) AS BIGINT) AS n FROM checked GROUP BY 1"))
def pairs_rejected(spark, sf):
    return clusters.reject_report(_pr(spark, sf))


@query(sql(["prs"], "SELECT name, x + sx*lmin AS a1, y AS b1, x + sx*lmax AS a2, y AS b2, x AS a3, y + sy*lmax AS b3, x AS a4, y + sy*lmin AS b4 FROM prs"))
def pair_corners(spark, sf):
    p = _prs(spark, sf).withColumn("c", g.corners(*[C(k) for k in ("x", "y", "sx", "sy", "lmin", "lmax")]))
    return p.select("name", *[C("c")[k][d].alias(f"{d}{k + 1}") for k in range(4) for d in "ab"])


_KIND = "CASE WHEN chr_l = chr_r THEN CASE WHEN sx=1 AND sy=1 THEN 'I+' WHEN sx=-1 AND sy=-1 THEN 'I-' WHEN sx=1 THEN 'D' ELSE 'V' END ELSE CASE WHEN sx=1 AND sy=1 THEN 'TN-1' WHEN sx=-1 AND sy=-1 THEN 'TN-2' WHEN sx=1 THEN 'TN+1' ELSE 'TN+2' END END"


@query(sql(["prs"], f"SELECT {_KIND} AS type, CAST(count(*) AS BIGINT) AS n FROM prs GROUP BY 1"))
def pair_types(spark, sf):
    return clusters.type_presence(_prs(spark, sf))


@query(sql(["prs"], "SELECT name FROM (SELECT name, count(*) OVER (PARTITION BY chr_l, chr_r, x // 525) AS k FROM prs) WHERE k <= 12"))
def pairs_density_cap(spark, sf):
    return clusters.density_cap(_prs(spark, sf), 12).select("name")


@query(sql(["prs"], "SELECT name, x, y FROM prs WHERE chr_l = 2 AND chr_r = 3"))
def pairs_of_chromosomes(spark, sf):
    return filtering.chromosome_pair(_prs(spark, sf), 2, 3).select("name", "x", "y")


@query(sql(["pr"], "SELECT max(lmax) AS max_lmax FROM pr"))
def pairs_max_lmax(spark, sf):
    return filtering.max_lmax(_pr(spark, sf))


@query(sql(["pr"], "SELECT chr_l, chr_r, l_start, l_end, l_or, r_start, r_end, r_or, name FROM pr ORDER BY chr_l, chr_r, CASE l_or WHEN '-' THEN l_end ELSE l_start END, CASE r_or WHEN '-' THEN r_end ELSE r_start END"))
def pairs_sorted(spark, sf):
    return filtering.sort_pr(_pr(spark, sf)).select("chr_l", "chr_r", "l_start", "l_end", "l_or", "r_start", "r_end", "r_or", "name")


@query(sql(["pr"], "SELECT name, chr_l, l_start FROM pr ORDER BY l_start DESC, name"))
def pairs_sorted_by_keys(spark, sf):
    return filtering.sort_by(_pr(spark, sf).select("name", "chr_l", "l_start"), [-3, 1])


@query(sql(["prs"], "SELECT name, x FROM prs ORDER BY abs(x), name"))
def pairs_sorted_by_position(spark, sf):
    return filtering.sort_by_position(_prs(spark, sf)).select("name", "x")


@query(sql(["pr"], "SELECT name FROM pr WHERE sample = 0 UNION ALL SELECT name FROM pr WHERE sample = 1 UNION ALL SELECT name FROM pr WHERE sample = 2"))
def pairs_union(spark, sf):
    p = _pr(spark, sf)
    return filtering.union_all(*[p.where(C("sample") == k) for k in range(3)]).select("name")


@query(sql(["pr"], "SELECT concat_ws(chr(9), name, chr_l, l_start, l_end, l_or, chr_r, r_start, r_end, r_or) AS value FROM pr"))
def pairs_text(spark, sf):
    return text.pr_to_text(_pr(spark, sf))


# --- clusters --------------------------------------------------------------------------


@query(sql(["edges"], "SELECT u, v FROM edges"))
def overlap_edges(spark, sf):
    return clusters.overlap_edges(_prs(spark, sf))


@query(sql(["edges_nr"], "SELECT u, v FROM edges_nr"))
def overlap_edges_nonreciprocal(spark, sf):
    return clusters.overlap_edges(_prs(spark, sf), True)


@query(sql(["members"], "SELECT name, cluster_id FROM members"))
def cluster_members(spark, sf):
    return _members(spark, sf).select("name", "cluster_id")


@query(sql(["clusters"], f"SELECT cluster_id, chr_l, chr_r, num_prs, type, {_LEFT}, {_SHORT} FROM clusters WHERE num_prs >= 4"))
def sv_clusters(spark, sf):
    return _shown(clusters.size_filter(_clusters(spark, sf), MIN_SIZE))


@query(sql(["clusters_nr"], f"SELECT cluster_id, chr_l, chr_r, num_prs, type, {_LEFT}, {_SHORT} FROM clusters_nr WHERE num_prs >= 4"))
def sv_clusters_nonreciprocal(spark, sf):
    mem = clusters.cluster_members(_slim(_prs(spark, sf)), True)
    return _shown(clusters.size_filter(clusters.summarize(mem), MIN_SIZE))


@query(sql(["prs"], f"SELECT name AS cluster_id, CAST(1 AS BIGINT) AS num_prs, {_KIND} AS type, round(sqrt((lmax*lmax - lmin*lmin)/2.0), 6) AS localization FROM prs"))
def sv_no_cluster(spark, sf):
    c = clusters.summarize(clusters.no_cluster(_prs(spark, sf)))
    return c.select("cluster_id", "num_prs", "type", F.round("localization", 6).alias("localization"))


@query(sql(["clusters"], "SELECT cluster_id, num_prs, CASE WHEN num_prs > 20 OR area <= 0 THEN -1.0 ELSE round(localization, 6) END AS localization FROM clusters WHERE num_prs BETWEEN 6 AND 40"))
def sv_size_limits(spark, sf):
    c = clusters.size_filter(_clusters(spark, sf), 6, 40, 20)
    return c.select("cluster_id", "num_prs", F.when(C("localization") > 0, F.round("localization", 6)).otherwise(-1.0).alias("localization"))


@query(sql(["members", "edges"], "SELECT m.cluster_id, CAST(m.n AS BIGINT) AS num_prs, CAST(coalesce(e.n, 0) AS BIGINT) AS num_edges, 2*coalesce(e.n, 0) = m.n*(m.n-1) AS is_clique FROM (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) m LEFT JOIN (SELECT cluster_id, count(*) AS n FROM edges JOIN members ON u = name GROUP BY 1) e USING (cluster_id)"))
def sv_clique_test(spark, sf):
    return clusters.clique_counts(_members(spark, sf))


@query(sql(["clusters"], "SELECT cluster_id, a_min, a_max, b_min, b_max, area FROM clusters WHERE area > 0"))
def sv_bounding_boxes(spark, sf):
    return clusters.bounding_boxes(_clusters(spark, sf), "area")


_LOC = "CASE WHEN area > 0 THEN regexp_replace(CAST(CAST(round_even(localization, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') ELSE '-1' END"


@query(sql(["clusters"], f"SELECT concat_ws(chr(9), cluster_id, chr_l, left_min || ',' || left_max, chr_r, right_min || ',' || right_max, num_prs, loc, type) AS value FROM (SELECT cluster_id, chr_l, chr_r, num_prs, type, {_LOC} AS loc, {_LEFT} FROM clusters WHERE num_prs >= 4)"))
def sv_layout_standard(spark, sf):
    return text.format_clusters(clusters.size_filter(_clusters(spark, sf), MIN_SIZE), "standard")


@query(sql(["clusters", "members"], f"SELECT concat_ws(chr(9), cluster_id, chr_l, left_min || ',' || left_max, chr_r, right_min || ',' || right_max, num_prs, loc, type, names) AS value FROM (SELECT cluster_id, chr_l, chr_r, num_prs, type, {_LOC} AS loc, {_LEFT} FROM clusters WHERE num_prs >= 4) JOIN (SELECT cluster_id, string_agg(name, ', ' ORDER BY name) AS names FROM members GROUP BY 1) USING (cluster_id)"))
def sv_layout_reads(spark, sf):
    return text.format_clusters(clusters.size_filter(clusters.summarize(_members(spark, sf), True), MIN_SIZE), "reads")


@query()
def sv_layout_regions(spark, sf):
    return text.format_clusters(clusters.size_filter(clusters.summarize(_members(spark, sf), True), MIN_SIZE), "regions")


_NEAREST = "CASE WHEN {0}_lo > 0 AND ({0}_hi IS NULL OR {0}_lo < {0}_hi) THEN {0}_lo ELSE coalesce({0}_hi, 2147483647) END"
_ENDS = ", ".join(f"CAST(CASE WHEN area > 0 THEN {c}_{m} ELSE {_NEAREST.format(c)} END AS BIGINT) AS {c}_{m[1:]}" for c in "ab" for m in ("min", "max"))


@query(sql(["clusters"], f"SELECT concat_ws(chr(9), cluster_id, chr_l, a_in || ',' || a_ax, chr_r, b_in || ',' || b_ax, num_prs, loc, type) AS value FROM (SELECT cluster_id, chr_l, chr_r, num_prs, type, {_LOC} AS loc, {_ENDS} FROM clusters WHERE num_prs >= 4)"))
def sv_layout_converted(spark, sf):
    lines = sv_layout_regions(spark, sf)
    path = work.new_path(spark, "regions")
    lines.write.text(path)
    return text.convert_layout(text.read_clusters(spark, path), "standard")


@query(sql(["clusters"], "SELECT cluster_id, 'c' || row_number() OVER (ORDER BY chr_l, chr_r, same DESC, s0, cluster_id) AS label FROM clusters"))
def sv_labels(spark, sf):
    return clusters.numbered(_clusters(spark, sf)).select("cluster_id", "label")


# --- filters ---------------------------------------------------------------------------


@query(sql(["prs", "hits"], "SELECT name FROM prs WHERE sample = 0 AND name NOT IN (SELECT name FROM hits)"))
def filter_retained(spark, sf):
    p = work.materialize(_prs(spark, sf), "prs")
    return filtering.filter_against(p.where("sample = 0"), p.where("sample = 1"))[0].select("name")


@query(sql(["prs", "hits"], "SELECT name FROM prs WHERE sample = 0 AND name IN (SELECT name FROM hits)"))
def filter_removed(spark, sf):
    p = work.materialize(_prs(spark, sf), "prs")
    return filtering.filter_against(p.where("sample = 0"), p.where("sample = 1"))[1].select("name")


@query(sql(["members"], "SELECT cluster_id FROM members GROUP BY 1 HAVING count(*) FILTER (sample = 0) >= 3 AND count(*) FILTER (sample = 1) <= 9"))
def filter_source_limits(spark, sf):
    return filtering.source_limits(_members(spark, sf, "sample"), {0: (3, None), 1: (0, 9)}, "sample")


# --- alignment records -----------------------------------------------------------------


def _paired(spark, sf):
    return preprocess.pair_geometry(preprocess.pair_mates(preprocess.classify_reads(fixtures.load(spark, sf, "reads"))))


_LIB = "(SELECT min(library) FROM classed c WHERE c.name = mates.name AND class <> 'DUPLICATE')"


@query(sql(["classed"], "SELECT class, CAST(count(*) AS BIGINT) AS n FROM classed GROUP BY 1"))
def read_classes(spark, sf):
    return preprocess.classify_reads(fixtures.load(spark, sf, "reads")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(sql(["mates"], "SELECT name, a_chr, a_pos, a_strand, b_chr, b_pos, b_strand, route FROM mates"))
def read_pairs(spark, sf):
    return _paired(spark, sf).select("name", "a_chr", "a_pos", "a_strand", "b_chr", "b_pos", "b_strand", "route")


def _typed(spark, sf):
    bounds = F.lit(150).cast("long"), F.lit(300).cast("long")
    return preprocess.classify_pairs(_paired(spark, sf).where("route = 'pair'").withColumns({"lmin": bounds[0], "lmax": bounds[1]}))


_VTYPE = "CASE WHEN a_chr <> b_chr THEN 'TRANS' WHEN a_strand = b_strand THEN 'INV' WHEN a_strand = '+' THEN CASE WHEN b_pos+50-a_pos BETWEEN 150 AND 300 THEN 'CONC' WHEN b_pos+50-a_pos > 300 THEN 'DEL' ELSE 'INS' END ELSE 'DIV' END"


@query(sql(["mates"], f"SELECT name, b_pos + 50 - a_pos AS insert, {_VTYPE} AS vtype FROM mates WHERE route = 'pair'"))
def read_pair_types(spark, sf):
    return _typed(spark, sf).select("name", "insert", "vtype")


@query(sql(["mates", "classed", "hist"], "SELECT library, length, n FROM hist"))
def length_histogram(spark, sf):
    return preprocess.length_histogram(_paired(spark, sf))


@query(sql(["mates", "classed", "hist"], """
SELECT library, max(CASE WHEN floor(total * ((100-99.0)/100) + 1.0) BETWEEN hi - n AND hi THEN length END) AS lmin,
  coalesce(max(CASE WHEN floor(total * (99.0/100) + 1.0) BETWEEN hi - n AND hi THEN length END), max(length)) AS lmax
FROM (SELECT *, sum(n) OVER (PARTITION BY library ORDER BY length) AS hi, sum(n) OVER (PARTITION BY library) AS total FROM hist) GROUP BY library"""))
def length_bounds_pct(spark, sf):
    return preprocess.length_bounds(length_histogram(spark, sf), "PCT=99").select("library", "lmin", "lmax")


@query(sql(["mates", "classed", "hist"], """
SELECT library, greatest(0, CAST(mean - 3*std AS BIGINT)) AS lmin, CAST(mean + 3*std AS BIGINT) AS lmax, mean, std FROM (
 SELECT library, mean, CAST(floor(sqrt(sum(n*(length-mean)*(length-mean)) / sum(n)) + 0.5) AS BIGINT) AS std FROM hist
 JOIN (SELECT library, CAST(floor(sum(length*n) / sum(n) + 0.5) AS BIGINT) AS mean FROM hist GROUP BY 1) USING (library) GROUP BY 1, 2)"""))
def length_bounds_sd(spark, sf):
    return preprocess.check_bounds(preprocess.length_bounds(length_histogram(spark, sf), "SD=3"))


@query(sql(["mates"], f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(b_pos+50-a_pos), 6) AS lavg, 50.0 AS read_len, round(sum(b_pos+50-a_pos) / 3e9 * 1e6, 6) AS lambda_millionths FROM mates WHERE route = 'pair' AND {_VTYPE} = 'CONC'"))
def depth_params(spark, sf):
    d = preprocess.depth_params(_typed(spark, sf))
    return d.select("n", F.round("lavg", 6).alias("lavg"), "read_len", F.round(C("lambda") * 1e6, 6).alias("lambda_millionths"))


@query(sql(["mates"], f"SELECT a_chr AS chr, CAST(count(*) AS BIGINT) AS n, CAST(sum(b_pos+50-a_pos) AS BIGINT) AS bases FROM mates WHERE route = 'pair' AND {_VTYPE} = 'CONC' GROUP BY 1"))
def concordant_by_chromosome(spark, sf):
    return preprocess.concordant_by_chromosome(_typed(spark, sf))


@query(sql(["mates"], f"SELECT a_chr AS chr, a_pos AS f_start, b_pos + 49 AS f_end FROM mates WHERE route = 'pair' AND {_VTYPE} = 'CONC'"))
def concordant_fragments(spark, sf):
    return preprocess.concordant_fragments(_typed(spark, sf))


@query(sql(["reads"], "SELECT 'f' || (a.ord % 700) AS fragment_id, a.ord AS a_ord, b.ord AS b_ord, row_number() OVER (PARTITION BY a.ord % 700 ORDER BY a.ord, b.ord) - 1 AS mapping_id FROM reads a JOIN reads b ON a.ord % 700 = b.ord % 700 AND a.ord % 2 = 0 AND b.ord % 2 = 0 AND a.mapq >= 10 AND b.mapq >= 10 AND a.ord < b.ord AND false UNION ALL SELECT 'f' || k, a_ord, b_ord, row_number() OVER (PARTITION BY k ORDER BY a_ord, b_ord) - 1 FROM (SELECT a.ord // 8 AS k, a.ord AS a_ord, b.ord AS b_ord FROM reads a JOIN reads b ON a.ord // 8 = b.ord // 8 AND a.ord % 2 = 0 AND b.ord % 2 = 1 AND a.mapq >= 10 AND b.mapq >= 10)"))
def read_all_combinations(spark, sf):
    r = fixtures.load(spark, sf, "reads").withColumn("name", F.concat(F.lit("f"), F.expr("ord div 8").cast("string")))
    return preprocess.pair_all(r.where("ord % 2 = 0"), r.where("ord % 2 = 1")).select("fragment_id", "a_ord", "b_ord", C("mapping_id").cast("long").alias("mapping_id"))


_ALIGNMENTS = "SELECT name, flag, CAST(chr AS VARCHAR) AS chr, pos, mapq, cigar, '=' AS mate_chr, pos + 100 AS mate_pos, 150 - ord % 300 AS tlen, substr(repeat('ACGTN', 12), CAST(1 + ord % 5 AS INTEGER), CAST(50 - ord % 3 AS INTEGER)) AS seq, repeat('I', CAST(50 - ord % 3 AS INTEGER)) AS qual, library AS read_group, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, 50 - ord % 3 AS read_len FROM reads"
_REFERENCES = [(str(k), 250_000_000) for k in range(1, 6)]


def _alignments(spark, sf) -> DataFrame:
    r = fixtures.load(spark, sf, "reads")
    n = (50 - C("ord") % 3).cast("int")
    return r.select(
        "name", C("flag").cast("int").alias("flag"), C("chr").cast("string").alias("chr"), C("pos").cast("int").alias("pos"), C("mapq").cast("int").alias("mapq"), "cigar", F.lit("=").alias("mate_chr"), (C("pos") + 100).cast("int").alias("mate_pos"),
        (150 - C("ord") % 300).cast("int").alias("tlen"), F.lit("ACGTN" * 12).substr((1 + C("ord") % 5).cast("int"), n).alias("seq"), F.lit("I" * 60).substr(F.lit(1), n).alias("qual"), C("library").alias("read_group"),
    )


def _written_bam(spark, sf) -> str:
    path = work.new_path(spark, "alignments")
    text.write_bam(_alignments(spark, sf), path, _REFERENCES, [(f"lib{k}", f"lib{k}") for k in range(3)])
    return path


@query(sql(["reads"], f"SELECT *, CAST(2 AS BIGINT) AS n FROM ({_ALIGNMENTS})"))
def reads_sam_and_bam(spark, sf):
    """Alignments written as text and as binary files, both read again: equal rows, each twice."""
    rows, lines = _alignments(spark, sf), work.new_path(spark, "sam")
    rows.select(F.concat(F.concat_ws("\t", *[C(c).cast("string") for c in text.SAM]), F.lit("\tRG:Z:"), C("read_group")).alias("value")).write.text(lines)
    sam, binary = text.read_sam(spark, lines)[0], text.read_bam(spark, _written_bam(spark, sf), split_size=1 << 17)[0]
    both = sam.unionByName(binary)
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


@query(sql(["reads"], f"SELECT name, flag, chr, pos, mapq, cigar, mate_chr, mate_pos, tlen FROM ({_ALIGNMENTS})"))
def reads_table(spark, sf):
    return text.sam_to_table(text.read_bam(spark, _written_bam(spark, sf))[0])


@query(sql(["reads"], f"SELECT name, side, '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value, reverse(translate(seq, 'ACGT', 'TGCA')) AS turned FROM (SELECT *, CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 2 END AS side FROM ({_ALIGNMENTS}))"))
def reads_fastq(spark, sf):
    reads = _alignments(spark, sf)
    sides = [t.withColumn("side", F.lit(k)) for k, t in enumerate(text.sam_to_fastq(reads), 1)]
    line = F.split("value", "\n")
    return sides[0].unionByName(sides[1]).select(F.substring(line[0], 2, 1000).alias("name"), "side", "value", text.reverse_complement(line[1]).alias("turned"))


@query(sql(["mates", "reads"], f"SELECT a.*, route FROM ({_ALIGNMENTS}) a JOIN (SELECT name, route FROM mates WHERE route <> 'pair') USING (name)"))
def reads_routed(spark, sf):
    """Alignments of low-quality and of split pairs, written as binary files and read again."""
    path = work.new_path(spark, "routed")
    text.write_routed_alignments(_alignments(spark, sf), work.materialize(_paired(spark, sf), "paired"), path, _REFERENCES)
    parts = [text.read_bam(spark, f"{path}/{r}")[0].withColumn("route", F.lit(r)) for r in ("low", "split")]
    return parts[0].unionByName(parts[1])


# --- depth -----------------------------------------------------------------------------


def _regions(spark, sf):
    return fixtures.load(spark, sf, "cgh").select(C("probe1").alias("region_id"), "chr", C("c_start").alias("start"), C("c_end").alias("end"))


@query(sql(["cgh", "concordant"], "SELECT probe1 AS region_id, CAST(count(f_start) AS BIGINT) AS n FROM cgh LEFT JOIN concordant ON cgh.chr = concordant.chr AND f_start < c_end AND f_end > c_start GROUP BY 1"))
def interval_coverage(spark, sf):
    return depth.interval_coverage(_regions(spark, sf), fixtures.load(spark, sf, "concordant"))


@query(sql(["uniqueness", "concordant"], "SELECT p.chr, p.pos, CAST(count(f_start) AS BIGINT) AS n FROM (SELECT DISTINCT chr, u_start AS pos FROM uniqueness) p LEFT JOIN concordant c ON p.chr = c.chr AND f_start <= pos AND f_end >= pos GROUP BY 1, 2"))
def point_coverage(spark, sf):
    return depth.point_coverage(fixtures.load(spark, sf, "uniqueness").select("chr", C("u_start").alias("pos")), fixtures.load(spark, sf, "concordant"))


@query(sql(["cgh", "uniqueness"], "SELECT probe1 AS region_id, round((coalesce(sum((least(c_end,u_end)-greatest(c_start,u_start))*value), 0) + (c_end-c_start-coalesce(sum(least(c_end,u_end)-greatest(c_start,u_start)), 0))*1.0) / (c_end-c_start), 6) AS uniqueness FROM cgh LEFT JOIN uniqueness u ON cgh.chr = u.chr AND u_start < c_end AND u_end > c_start GROUP BY probe1, c_start, c_end"))
def mean_uniqueness(spark, sf):
    out = depth.mean_uniqueness(_regions(spark, sf), fixtures.load(spark, sf, "uniqueness"), 1.0)
    return out.select("region_id", F.round("uniqueness", 6).alias("uniqueness"))


@query(sql(["concordant"], """
SELECT chr, min(f_start) AS f_start, max(f_end) AS f_end FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY f_start, f_end ROWS UNBOUNDED PRECEDING) AS grp FROM (
  SELECT *, CASE WHEN f_start <= max(f_end) OVER (PARTITION BY chr ORDER BY f_start, f_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM concordant)) GROUP BY chr, grp"""))
def merged_intervals(spark, sf):
    return depth.merge_intervals(fixtures.load(spark, sf, "concordant"), "f_start", "f_end")


def _ranges(mode):
    def run(spark, sf):
        right = fixtures.load(spark, sf, "concordant").select("chr", C("f_start").alias("start"), C("f_end").alias("end"))
        return depth.range_join(_regions(spark, sf), right, mode).select("region_id", C("r_start").alias("f_start"), C("r_end").alias("f_end"))

    return run


for _mode, _test in (("closed", "f_start <= c_end AND f_end >= c_start"), ("open", "f_start < c_end AND f_end > c_start"), ("contained", "f_start >= c_start AND f_end <= c_end")):
    QUERIES[f"range_join_{_mode}"] = _ranges(_mode)
    ORACLE_SQL[f"range_join_{_mode}"] = sql(["cgh", "concordant"], f"SELECT probe1 AS region_id, f_start, f_end FROM cgh JOIN concordant c ON cgh.chr = c.chr AND {_test}")


# --- scoring ---------------------------------------------------------------------------

SCORE = scoring.ScoreParams(lavg=250, read_len=50, lam=0.002, limit=1000)


def _scored(spark, sf, split=None, mem=None):
    found = work.materialize(clusters.size_filter(clusters.summarize(_members(spark, sf) if mem is None else mem), MIN_SIZE), "clusters")
    return found, scoring.score_clusters(found, fixtures.load(spark, sf, "concordant"), fixtures.load(spark, sf, "uniqueness"), SCORE, split)


def _pois(rate: str, length: str, n: str) -> str:
    return f"(floor({n})*ln({rate}*{length}) - {rate}*{length} - lgamma(floor({n})+1))"


_CODE1 = f"""
SELECT cluster_id, n, uniq, sc, len, num_prs, num_prs*ln(0.01) AS d_none, {_pois("0.002", "150.0", "num_prs")} AS d_hom, {_pois("0.001", "150.0", "num_prs")} AS d_het,
  sc*ln(0.01) AS hom, {_pois("0.001", "len", "sc")} AS het, {_pois("0.002", "len", "sc")} AS err, a_max, b_min
FROM (SELECT *, floor(n / (0.7*uniq + 0.3) + 0.5) AS sc, CAST(b_min - a_max + 250 AS DOUBLE) AS len FROM (
  SELECT c.cluster_id, c.num_prs, c.a_max, c.b_min,
    (SELECT count(*) FROM concordant f WHERE f.chr = c.chr_l AND f_start < c.b_min AND f_end > c.a_max) AS n,
    (SELECT (coalesce(sum((least(c.b_min+250,u_end)-greatest(c.a_max-250,u_start))*value), 0) + (c.b_min-c.a_max+500-coalesce(sum(least(c.b_min+250,u_end)-greatest(c.a_max-250,u_start)), 0))*1.0) / CAST(c.b_min-c.a_max+500 AS DOUBLE) FROM uniqueness u WHERE u.chr = c.chr_l AND u_start < c.b_min+250 AND u_end > c.a_max-250) AS uniq
  FROM clusters c WHERE num_prs >= 4 AND area > 0 AND chr_l = chr_r AND type = 'D' AND b_min - a_max >= 1000))
"""


_INTERVAL_LLR = f"SELECT cluster_id, CAST(n AS BIGINT) AS cov_l, round(uniq, 6) AS map_l, a_max AS best_a, b_min AS best_b, round(CASE WHEN sc >= 4*0.002*len AND 0.002*len >= 100 THEN -4e8 ELSE greatest(d_hom+hom, d_het+het) - (d_none+err) END, 4) AS llr FROM ({_CODE1})"


@query(sql(["clusters", "concordant", "uniqueness"], _INTERVAL_LLR))
def score_intervals(spark, sf):
    _, s = _scored(spark, sf)
    # a mean depth under 100 with coverage in the far tail is rejected too; see score_points
    return s.where("code = 1").select("cluster_id", "cov_l", F.round("map_l", 6).alias("map_l"), "best_a", "best_b", F.round("llr", 4).alias("llr"))


def _points_sql() -> str:
    """Every point (a, b) of every region, scored by depth at a and at b."""
    hom, het, err = "n*ln(0.01)", _pois("0.001", "250.0", "n"), _pois("0.002", "250.0", "n")
    size = "(CASE WHEN type IN ('IR', 'TR+', 'TR-') THEN 300.0 ELSE 150.0 END)"
    return f"""
SELECT cluster_id, any_value(type) AS type, CASE WHEN bool_or(beyond) THEN any_value(a_max) ELSE arg_min(a, (-diff, a, b)) END AS best_a,
  CASE WHEN bool_or(beyond) THEN any_value(b_min) ELSE arg_min(b, (-diff, a, b)) END AS best_b, round(CASE WHEN bool_or(beyond) THEN -4e8 ELSE max(diff) END, 4) AS llr
FROM (
  WITH c0 AS MATERIALIZED (
    SELECT *, num_prs*ln(0.01) AS d_none, {_pois("0.002", size, "num_prs")} AS d_hom, {_pois("0.001", size, "num_prs")} AS d_het FROM clusters
    WHERE num_prs >= 4 AND area > 0 AND type <> 'V' AND (chr_l <> chr_r OR type IN ('I+', 'I-', 'IR') OR b_min - a_max < 1000)),
  pa AS MATERIALIZED (SELECT cluster_id, chr_l AS chr, unnest(generate_series(a_min, a_max)) AS pos FROM c0),
  pb AS MATERIALIZED (SELECT cluster_id, chr_r AS chr, unnest(generate_series(b_min, b_max)) AS pos FROM c0),
  cov AS MATERIALIZED (SELECT p.chr, p.pos, count(f_start) AS n FROM (SELECT chr, pos FROM pa UNION SELECT chr, pos FROM pb) p LEFT JOIN concordant f ON f.chr = p.chr AND f_start <= pos AND f_end >= pos GROUP BY 1, 2),
  sa AS MATERIALIZED (SELECT cluster_id, pos AS a, n AS na, {hom} - {err} AS hom_a, {het} - {err} AS het_a FROM pa JOIN cov USING (chr, pos)),
  sb AS MATERIALIZED (SELECT cluster_id, pos AS b, n AS nb, {hom} - {err} AS hom_b, {het} - {err} AS het_b FROM pb JOIN cov USING (chr, pos))
  SELECT c.cluster_id, type, a_max, b_min, a, b, greatest(d_hom + hom_a + hom_b - d_none, d_het + het_a + het_b - d_none) AS diff,
    1 - exp(-0.004) * CASE na + nb WHEN 0 THEN 1.0 WHEN 1 THEN 1.004 ELSE 1.004008 END < 0.0001 AS beyond
  FROM c0 c JOIN sa ON sa.cluster_id = c.cluster_id JOIN sb ON sb.cluster_id = c.cluster_id
  WHERE CASE WHEN same THEN a + b ELSE b - a END BETWEEN s0 AND s1)
GROUP BY cluster_id"""


@query(sql(["clusters", "concordant"], _points_sql()))
def score_points(spark, sf):
    _, s = _scored(spark, sf)
    return s.where("code = 0").select("cluster_id", "type", "best_a", "best_b", F.round("llr", 4).alias("llr"))


@query(sql(["clusters", "concordant", "uniqueness"], f"SELECT cluster_id, 1 AS code, llr FROM ({_INTERVAL_LLR}) WHERE llr >= 0 UNION ALL SELECT cluster_id, 0, llr FROM ({_points_sql()}) WHERE llr >= 0"))
def score_filtered(spark, sf):
    return scoring.llr_filter(_scored(spark, sf)[1], 0.0).select("cluster_id", "code", F.round("llr", 4).alias("llr"))


_SIDES = "SELECT * FROM (SELECT m.cluster_id, m.name, CASE WHEN x <= a_max AND x+50 >= a_min AND y <= b_max AND y+50 >= b_min THEN 'Both' WHEN x <= a_max AND x+50 >= a_min THEN 'X' WHEN y <= b_max AND y+50 >= b_min THEN 'Y' END AS side FROM members m JOIN clusters c ON m.cluster_id = c.cluster_id AND c.area > 0) WHERE side IS NOT NULL"


def _split_sql() -> str:
    """Intervals and points scored with split reads added to each call's support, without a track."""
    more = f"(SELECT * REPLACE (num_prs + coalesce(n, 0) AS num_prs) FROM clusters LEFT JOIN (SELECT cluster_id, count(*) AS n FROM ({_SIDES}) GROUP BY 1) USING (cluster_id) WHERE num_prs >= 4)"
    both = f"SELECT cluster_id, 1 AS code, llr FROM ({_INTERVAL_LLR}) UNION ALL SELECT cluster_id, 0, llr FROM ({_points_sql()})"
    return both.replace("FROM clusters", f"FROM {more}")


@query(sql(["clusters", "members", "concordant", "uniqueness"], _split_sql(), uniqueness=fixtures.duck("uniqueness") + " WHERE false"))
def score_with_split_reads(spark, sf):
    mem = _members(spark, sf)
    found = work.materialize(clusters.size_filter(clusters.summarize(mem), MIN_SIZE), "clusters")
    split = work.materialize(scoring.split_read_candidates(mem, found, 50).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "split")
    s = scoring.score_clusters(found, fixtures.load(spark, sf, "concordant"), None, SCORE, split)
    return s.select("cluster_id", "code", F.round("llr", 4).alias("llr"))


@query(sql(["clusters"], "SELECT cluster_id, num_prs FROM clusters WHERE num_prs >= 10 AND area > 0"))
def support_filtered(spark, sf):
    return scoring.support_filter(_clusters(spark, sf), 10).select("cluster_id", "num_prs")


@query(sql(["clusters", "members"], _SIDES))
def split_read_candidates(spark, sf):
    mem = _members(spark, sf)
    return scoring.split_read_candidates(mem, clusters.summarize(mem), 50)


@query("SELECT o_orderkey AS k, round(lgamma(o_orderkey + 1), 6) AS v FROM orders")
def log_factorials(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(C("o_orderkey").alias("k"), F.round(lk.log_factorial(C("o_orderkey")), 6).alias("v"))


# --- array copy-number segments --------------------------------------------------------


_SEGMENT = "probe1 || '-' || probe2"
_EXT = "SELECT *, CASE WHEN area > 0 THEN a_min ELSE na_min END AS af, CASE WHEN area > 0 THEN a_max ELSE na_max END AS a_to, CASE WHEN area > 0 THEN b_min ELSE nb_min END AS bf, CASE WHEN area > 0 THEN b_max ELSE nb_max END AS bt FROM clusters WHERE num_prs >= 4"
_CGH = f"SELECT DISTINCT {_SEGMENT} AS cgh_id, cluster_id, CASE WHEN chr_l = chr_r THEN 'xy' ELSE ax END AS axis FROM (SELECT *, 'x' AS ax, chr_l AS ch, af AS f, a_to AS t FROM ({_EXT}) UNION ALL SELECT *, 'y', chr_r, bf, bt FROM ({_EXT})) e JOIN cgh s ON s.chr = e.ch AND c_start < t AND c_end > f"


@query(sql(["clusters", "cgh"], _CGH))
def cgh_single(spark, sf):
    return cgh.cgh_join(fixtures.load(spark, sf, "cgh"), _clusters(spark, sf))


@query(sql(["clusters", "cgh"], f"SELECT cgh_id, CAST(count(*) AS BIGINT) AS n, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM (SELECT DISTINCT cgh_id, cluster_id FROM ({_CGH})) GROUP BY 1"))
def cgh_report(spark, sf):
    return cgh.cgh_report(cgh_single(spark, sf))


def _pair_sql() -> str:
    from strandline.plans.oracle import _below

    return f"""
SELECT i1 AS cgh_id1, i2 AS cgh_id2, cluster_id FROM (SELECT *,
   CAST(CASE WHEN same THEN lo_b ELSE -hi_b END AS DOUBLE) AS bl, CAST(CASE WHEN same THEN hi_b ELSE -lo_b END AS DOUBLE) AS bh FROM (
 SELECT p.probe1 || '-' || p.probe2 AS i1, q.probe1 || '-' || q.probe2 AS i2, cluster_id, same,
   CAST(greatest(p.c_start, ca_lo) AS DOUBLE) AS al, CAST(least(p.c_end, ca_hi) AS DOUBLE) AS ah, greatest(q.c_start, cb_lo) AS lo_b, least(q.c_end, cb_hi) AS hi_b,
   c.lo AS lo, c.hi AS hi
 FROM clusters c JOIN cgh p ON p.chr = c.chr_l AND p.c_start < a_max AND p.c_end > a_min JOIN cgh q ON q.chr = c.chr_r AND q.c_start < b_max AND q.c_end > b_min WHERE num_prs >= 4 AND area > 0))
WHERE al <= ah AND bl <= bh AND lo <= hi AND {_below("hi")} - {_below("lo")} > 0"""


@query(sql(["clusters", "cgh"], _pair_sql()))
def cgh_paired(spark, sf):
    return cgh.cgh_pair_join(fixtures.load(spark, sf, "cgh"), work.materialize(_clusters(spark, sf), "clusters"))


# --- fragments with several mappings ---------------------------------------------------


def _links(spark, sf):
    return work.materialize(assign.fragment_clusters(_members(spark, sf, "fragment_id")), "links")


@query(sql(["links"], "SELECT fragment_id, CAST(count(*) AS BIGINT) AS n_clusters FROM links GROUP BY 1"))
def fragment_support(spark, sf):
    return assign.fragment_support(_links(spark, sf))


@query(sql(["frag_roots"], "SELECT id AS cluster_id, root AS component_id FROM frag_roots"))
def fragment_components(spark, sf):
    return assign.fragment_components(_links(spark, sf))


@query(sql(["frag_roots"], "SELECT n AS clusters, CAST(count(*) AS BIGINT) AS components FROM (SELECT root, CAST(count(*) AS BIGINT) AS n FROM frag_roots GROUP BY 1) GROUP BY 1"))
def component_sizes(spark, sf):
    return assign.size_summary(assign.fragment_components(_links(spark, sf)))


@query(sql(["pr"], "SELECT name || '.3_0_0' AS mapping, name AS fragment FROM pr"))
def fragment_names(spark, sf):
    m = _pr(spark, sf).select(F.concat("name", F.lit(".3_0_0")).alias("mapping"))
    return m.select("mapping", g.fragment_name(C("mapping")).alias("fragment"))


MCMC = assign.McmcParams(lam=0.05)


@query()
def assignment(spark, sf):
    mem = _members(spark, sf, "fragment_id")  # one search for both
    _, scored = _scored(spark, sf, mem=mem)
    links = work.materialize(assign.fragment_clusters(mem), "links")
    got, _ = assign.mcmc(links, assign.fragment_components(links), scored, MCMC)
    return got.where("kept").select("component_id", "fragment_id", "cluster_id")


# --- pruning, splitting, pipelines -----------------------------------------------------


_REDUNDANT = """
SELECT p.cluster_id AS u, q.cluster_id AS v FROM clusters p JOIN clusters q ON p.chr_l = q.chr_l AND p.chr_r = q.chr_r AND left(p.type, 1) = left(q.type, 1) AND p.cluster_id < q.cluster_id
WHERE p.area > 0 AND q.area > 0 AND CASE WHEN p.chr_l = p.chr_r THEN q.b_min >= p.a_max AND p.b_min >= q.a_max AND (
    (p.a_max < q.a_max AND p.b_min > q.b_min) OR (q.a_max < p.a_max AND q.b_min > p.b_min)
    OR 2 * (least(p.b_min, q.b_min) - greatest(p.a_max, q.a_max) + 1) >= greatest(p.b_min, q.b_min) - least(p.a_max, q.a_max) + 1)
  ELSE p.a_max >= q.a_min AND q.a_max >= p.a_min AND p.b_max >= q.b_min AND q.b_max >= p.b_min END"""


def _pruned_sql(calls: str, weight: str, shown: str) -> str:
    """The greedy pass over ``calls`` in order of cluster_id, one redundant pair per step."""
    pairs = _REDUNDANT.replace("clusters p", "calls p").replace("clusters q", "calls q")
    return f"""
SELECT {shown} FROM (WITH RECURSIVE calls AS MATERIALIZED ({calls}),
 steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, v) AS k, u, v, CASE WHEN q.{weight} > p.{weight} THEN u ELSE v END AS loser
   FROM ({pairs}) r JOIN calls p ON p.cluster_id = r.u JOIN calls q ON q.cluster_id = r.v),
 pass(k, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
   SELECT s.k, CASE WHEN list_contains(gone, u) OR list_contains(gone, v) THEN gone ELSE list_append(gone, loser) END FROM pass JOIN steps s ON s.k = pass.k + 1)
 SELECT calls.* FROM calls, (SELECT arg_max(gone, k) AS gone FROM pass) WHERE area > 0 AND NOT list_contains(gone, cluster_id))"""


@query(sql(["clusters"], _REDUNDANT, pr=fixtures.duck("pr_again")))
def redundant_pairs(spark, sf):
    return prune.redundant_pairs(_clusters_again(spark, sf))


@query(sql(["clusters"], _pruned_sql("SELECT * FROM clusters WHERE num_prs >= 4", "num_prs", "cluster_id, num_prs, type"), pr=fixtures.duck("pr_again")))
def pruned_by_support(spark, sf):
    c = work.materialize(clusters.size_filter(_clusters_again(spark, sf), MIN_SIZE), "clusters")
    return prune.prune(c, "ESP").select("cluster_id", "num_prs", "type")


@query()
def maximal_subclusters(spark, sf):
    mem = _members(spark, sf)
    return prune.maximal_subclusters(mem, clusters.summarize(mem)).where(C("num_prs") >= MIN_SIZE)


_CALLS = f"SELECT c.*, llr FROM clusters c JOIN (SELECT cluster_id, llr FROM ({_INTERVAL_LLR}) WHERE llr >= 0 UNION ALL SELECT cluster_id, llr FROM ({_points_sql()}) WHERE llr >= 0) USING (cluster_id)"


@query(sql(["clusters", "concordant", "uniqueness"], _pruned_sql(_CALLS, "llr", "cluster_id, type, num_prs, llr"), pr=fixtures.duck("pr_again")))
def pipeline_hq(spark, sf):
    out = pipelines.hq(fixtures.load(spark, sf, "pr_again"), fixtures.load(spark, sf, "concordant"), fixtures.load(spark, sf, "uniqueness"), pipelines.PipelineParams(score=SCORE))
    return out.select("cluster_id", "type", "num_prs", F.round("llr", 4).alias("llr"))


@query()
def pipeline_full(spark, sf):
    p = pipelines.PipelineParams(score=SCORE, mcmc=MCMC)
    out = pipelines.full(_pr(spark, sf), fixtures.load(spark, sf, "concordant"), fixtures.load(spark, sf, "uniqueness"), p)
    return out.select("cluster_id", "type", "num_prs", "support", F.round("llr", 4).alias("llr"))


@query(sql(["clusters"], "SELECT cluster_id, num_prs FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY num_prs DESC, cluster_id) AS k FROM clusters WHERE num_prs >= 4) WHERE k <= 3"))
def top_calls_by_type(spark, sf):
    """A report of the three largest calls of each type; the limit is the feature."""
    order = Window.partitionBy("type").orderBy(F.desc("num_prs"), "cluster_id")
    return clusters.size_filter(_clusters(spark, sf), MIN_SIZE).withColumn("k", F.row_number().over(order)).where("k <= 3").select("cluster_id", "num_prs")
