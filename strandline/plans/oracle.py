"""SQL for DuckDB that gives the same rows as the queries, from the same star-schema tables.

Common table expressions build on each other; ``sql(names, body)`` puts the needed ones,
with what they need, before a body.
"""

from __future__ import annotations

from strandline.sources.fixtures import duck

_EDGE = """
SELECT p.name AS u, q.name AS v
FROM {p} p JOIN {q} q ON p.chr_l = q.chr_l AND p.chr_r = q.chr_r AND p.same = q.same AND p.bin = q.bin AND {order}
WHERE p.bin = greatest(p.a0, q.a0) // 512
  AND p.s0 <= q.s1 AND q.s0 <= p.s1
  AND NOT (p.chr_l = p.chr_r AND NOT p.same AND p.sx <> q.sx)
  AND NOT ({qb0} > {pt0} AND {qb1} > {pt1}) AND NOT ({qt0} < {pb0} AND {qt1} < {pb1})
"""


def _edge_sql(p: str, q: str, order: str) -> str:
    e, x = "greatest(p.s0, q.s0)", "least(p.s1, q.s1)"
    parts = {}
    for k, v in (("0", e), ("1", x)):
        for t in "pq":
            slope = f"(CASE WHEN {t}.same THEN {v} - {t}.x ELSE {t}.x + {v} END)"
            parts[f"{t}t{k}"] = f"(CASE WHEN {t}.sy > 0 THEN {slope} ELSE {t}.y END)"
            parts[f"{t}b{k}"] = f"(CASE WHEN {t}.sy > 0 THEN {t}.y ELSE {slope} END)"
    return _EDGE.format(p=p, q=q, order=order, **parts)


def _q(t: str) -> str:
    return f"(pow(greatest({t}, 0.0), 2) / 2)"


def _below(s: str) -> str:
    return f"({_q(f'{s} - al - bl')} - {_q(f'{s} - ah - bl')} - {_q(f'{s} - al - bh')} + {_q(f'{s} - ah - bh')})"


#: (same, six bounds) -> filled bounds; then area and box, for a relation with those columns.
def _region(source: str) -> str:
    return f"""
SELECT *, CASE WHEN al > ah OR bl > bh OR lo > hi THEN 0.0 ELSE greatest(0.0, {_below("hi")} - {_below("lo")}) END AS area
FROM (SELECT *, CAST(ca_lo AS DOUBLE) AS al, CAST(ca_hi AS DOUBLE) AS ah,
        CAST(CASE WHEN same THEN cb_lo ELSE -cb_hi END AS DOUBLE) AS bl, CAST(CASE WHEN same THEN cb_hi ELSE -cb_lo END AS DOUBLE) AS bh,
        CAST(CASE WHEN same THEN s0 ELSE -s1 END AS DOUBLE) AS lo, CAST(CASE WHEN same THEN s1 ELSE -s0 END AS DOUBLE) AS hi
  FROM (SELECT *, coalesce(a_lo, CASE WHEN same THEN s0 - b_hi ELSE b_lo - s1 END) AS ca_lo, coalesce(a_hi, CASE WHEN same THEN s1 - b_lo ELSE b_hi - s0 END) AS ca_hi,
          coalesce(b_lo, CASE WHEN same THEN s0 - a_hi ELSE s0 + a_lo END) AS cb_lo, coalesce(b_hi, CASE WHEN same THEN s1 - a_lo ELSE s1 + a_hi END) AS cb_hi
    FROM ({source})))
"""


def _summary(mem: str) -> str:
    agg = f"""
SELECT cluster_id, CAST(count(*) AS BIGINT) AS num_prs, min(chr_l) AS chr_l, min(chr_r) AS chr_r, bool_and(same) AS same,
  bool_or(sx=1 AND sy=1) AS pp, bool_or(sx=-1 AND sy=-1) AS mm, bool_or(sx=1 AND sy=-1) AS pm, bool_or(sx=-1 AND sy=1) AS mp,
  max(CASE WHEN sx>0 THEN x END) AS a_lo, min(CASE WHEN sx<0 THEN x END) AS a_hi, max(CASE WHEN sy>0 THEN y END) AS b_lo, min(CASE WHEN sy<0 THEN y END) AS b_hi,
  max(s0) AS s0, min(s1) AS s1, max(x+lmax) AS na_max, min(x+lmax) AS na_min, max(y+lmax) AS nb_max, min(y+lmax) AS nb_min
FROM {mem} GROUP BY cluster_id
"""
    return f"""
SELECT *, CASE WHEN area > 0 THEN sqrt(area) ELSE -1.0 END AS localization,
  CASE WHEN chr_l = chr_r THEN CASE WHEN pm AND mp THEN 'DV' WHEN pp AND mm THEN 'IR' WHEN pp THEN 'I+' WHEN mm THEN 'I-' WHEN pm THEN 'D' ELSE 'V' END
       ELSE CASE WHEN pm AND mp THEN 'TR+' WHEN pp AND mm THEN 'TR-' WHEN pp THEN 'TN-1' WHEN mm THEN 'TN-2' WHEN pm THEN 'TN+1' ELSE 'TN+2' END END AS type,
  greatest(ca_lo, CASE WHEN same THEN s0 - cb_hi ELSE cb_lo - s1 END) AS a_min, least(ca_hi, CASE WHEN same THEN s1 - cb_lo ELSE cb_hi - s0 END) AS a_max,
  greatest(cb_lo, CASE WHEN same THEN s0 - ca_hi ELSE s0 + ca_lo END) AS b_min, least(cb_hi, CASE WHEN same THEN s1 - ca_lo ELSE s1 + ca_hi END) AS b_max
FROM ({_region(agg)})
"""


def _components(vertices: str, edges: str) -> str:
    return f"""
SELECT v AS id, min(r) AS root FROM (
  WITH RECURSIVE both_ways AS MATERIALIZED (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}),
  reach(v, r) AS (
    SELECT id, id FROM ({vertices})
    UNION
    SELECT b.v, min(r.r) FROM reach r JOIN both_ways b ON b.u = r.v WHERE r.r < b.v GROUP BY b.v)
  SELECT v, r FROM reach) GROUP BY v
"""


CTES: dict[str, tuple[list[str], str]] = {
    "pr": ([], duck("pr")),
    "concordant": ([], duck("concordant")),
    "uniqueness": ([], duck("uniqueness")),
    "cgh": ([], duck("cgh")),
    "reads": ([], duck("reads")),
    "signed": (["pr"], "SELECT *, CASE l_or WHEN '+' THEN 1 ELSE -1 END AS lx, CASE r_or WHEN '+' THEN 1 ELSE -1 END AS rx, CASE l_or WHEN '+' THEN l_start ELSE l_end END AS lp, CASE r_or WHEN '+' THEN r_start ELSE r_end END AS rp FROM pr"),
    "ordered": (["signed"], """
SELECT name, fragment_id, mapping_id, sample, lmin, lmax,
  CASE WHEN w THEN chr_r ELSE chr_l END AS chr_l, CASE WHEN w THEN chr_l ELSE chr_r END AS chr_r,
  CASE WHEN w THEN r_start ELSE l_start END AS l_start, CASE WHEN w THEN r_end ELSE l_end END AS l_end,
  CASE WHEN w THEN l_start ELSE r_start END AS r_start, CASE WHEN w THEN l_end ELSE r_end END AS r_end,
  CASE WHEN w THEN rp ELSE lp END AS x, CASE WHEN w THEN lp ELSE rp END AS y, CASE WHEN w THEN rx ELSE lx END AS sx, CASE WHEN w THEN lx ELSE rx END AS sy
FROM (SELECT *, chr_l > chr_r OR (chr_l = chr_r AND lp >= rp) AS w FROM signed)"""),
    "checked": (["ordered"], """
SELECT *, CASE WHEN sx > 0 THEN x ELSE x - lmax END AS a0, CASE WHEN sx > 0 THEN x + lmax ELSE x END AS a1,
  CASE WHEN (CASE WHEN 2*(l_end-l_start)*(l_end-l_start) + 2*(r_end-r_start)*(r_end-r_start) > lmin*lmin THEN abs(l_end-l_start)+abs(r_end-r_start) ELSE lmin END) > lmax THEN 'invalid_lmin'
       WHEN chr_l = chr_r AND least(l_start,l_end) <= greatest(r_start,r_end) AND least(r_start,r_end) <= greatest(l_start,l_end) THEN 'overlapping'
       WHEN chr_l = chr_r AND sx > 0 AND sy < 0 AND y - x > lmin AND y - x < lmax THEN 'concordant' END AS reject_reason,
  (CASE WHEN same THEN x + y ELSE y - x END) + CASE WHEN sy > 0 THEN lmin ELSE -lmax END AS s0,
  (CASE WHEN same THEN x + y ELSE y - x END) + CASE WHEN sy > 0 THEN lmax ELSE -lmin END AS s1
FROM (SELECT *, sx = sy AS same FROM ordered)"""),
    "prs": (["checked"], "SELECT * FROM checked WHERE reject_reason IS NULL"),
    "binned": (["prs"], "SELECT *, unnest(generate_series(a0 // 512, a1 // 512)) AS bin FROM prs"),
    "edges": (["binned"], _edge_sql("binned", "binned", "p.name < q.name")),
    "edges_nr": (["binned"], _edge_sql("binned", "binned", "p.name < q.name AND p.sx = q.sx AND p.sy = q.sy")),
    "roots": (["prs", "edges"], _components("SELECT name AS id FROM prs", "edges")),
    "roots_nr": (["prs", "edges_nr"], _components("SELECT name AS id FROM prs", "edges_nr")),
    "members": (["prs", "roots"], "SELECT prs.*, root AS cluster_id FROM prs JOIN roots ON name = id"),
    "members_nr": (["prs", "roots_nr"], "SELECT prs.*, root AS cluster_id FROM prs JOIN roots_nr ON name = id"),
    "clusters": (["members"], _summary("members")),
    "clusters_nr": (["members_nr"], _summary("members_nr")),
    "target_bin": (["binned"], "SELECT * FROM binned WHERE sample = 0"),
    "reference_bin": (["binned"], "SELECT * FROM binned WHERE sample = 1"),
    "hits": (["target_bin", "reference_bin"], f"SELECT DISTINCT u AS name FROM ({_edge_sql('target_bin', 'reference_bin', 'true')})"),
    "classed": (["reads"], """
SELECT *, CASE WHEN (flag & 1024) <> 0 THEN 'DUPLICATE' WHEN (flag & 4) <> 0 THEN 'UNMAPPED'
   WHEN coalesce(list_sum([CAST(v AS INTEGER) FOR v IN regexp_extract_all(cigar, '([0-9]+)S', 1)]), 0) >= (100-95)*0.01*50 THEN 'SPLIT' WHEN mapq >= 10 THEN 'HIGHQ' ELSE 'LOWQ' END AS class, 50 AS read_len FROM reads WHERE (flag & 1) <> 0"""),
    "mates": (["classed"], """
SELECT a.name, a.library, a.chr AS a_chr, a.pos AS a_pos, a.strand AS a_strand, a.class AS a_class, b.chr AS b_chr, b.pos AS b_pos, b.strand AS b_strand, b.class AS b_class, a.ord AS a_ord, b.ord AS b_ord,
  CASE WHEN a.class = 'HIGHQ' AND b.class = 'HIGHQ' THEN 'pair' WHEN (a.class = 'HIGHQ' AND b.class IN ('SPLIT','UNMAPPED')) OR (b.class = 'HIGHQ' AND a.class IN ('SPLIT','UNMAPPED')) THEN 'split' ELSE 'low' END AS route
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chr, pos, ord) AS k, count(*) OVER (PARTITION BY name) AS n, min(library) OVER (PARTITION BY name) AS lib FROM classed WHERE class <> 'DUPLICATE') a
JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chr, pos, ord) AS k FROM classed WHERE class <> 'DUPLICATE') b ON a.name = b.name AND a.k = 1 AND b.k = 2 AND a.n = 2"""),
    "hist": (["mates"], "SELECT library, b_pos + 49 - a_pos + 1 AS length, CAST(count(*) AS BIGINT) AS n FROM (SELECT * REPLACE (least(library, (SELECT min(library) FROM classed c WHERE c.name = mates.name AND class <> 'DUPLICATE')) AS library) FROM mates) WHERE route = 'pair' AND a_chr = b_chr AND a_strand = '+' AND b_strand = '-' AND b_pos + 49 - a_pos + 1 <= 10000 GROUP BY 1, 2"),
    "links": (["members", "clusters"], "SELECT DISTINCT m.fragment_id, m.cluster_id FROM members m JOIN clusters c ON m.cluster_id = c.cluster_id AND c.num_prs >= 4"),
    "cluster_links": (["links"], "SELECT DISTINCT l.cluster_id AS u, f.v FROM links l JOIN (SELECT fragment_id, min(cluster_id) AS v FROM links GROUP BY 1) f USING (fragment_id)"),
    "frag_roots": (["links", "cluster_links"], _components("SELECT DISTINCT cluster_id AS id FROM links", "cluster_links")),
}


def needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for k in [*needed(CTES[n][0]), n]:
            if k not in out:
                out.append(k)
    return out


def sql(names: list[str], body: str, **instead: str) -> str:
    """``body`` with the expressions it needs; ``instead`` gives other SQL for some of them."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({instead.get(n, CTES[n][1])})" for n in needed(names)) + "\n" + body
