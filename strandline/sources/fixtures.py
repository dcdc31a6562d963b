"""Domain tables derived from the star-schema tables, in SQL that Spark and DuckDB share.

Whole-number arithmetic only. ``DIV`` stands for integer division, which the two
engines write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline import work

LMIN, LMAX = 150, 350

PR = """
with b as (
 select l_orderkey o, cast(l_linenumber as bigint) n, l_partkey p, l_suppkey s,
        cast(l_quantity as bigint) q, cast(round(l_discount*100) as bigint) dc,
        cast(round(l_tax*100) as bigint) tx, cast(round(l_extendedprice*100) as bigint) ep
 from {lineitem}),
c as (
 select *, p % 20 k, (p DIV 20) % 2 h, n % 2 odd, (p DIV 40) % 2 wide from b),
d as (
 select *,
  case when k<=10 then '+' when k=11 then '-' when k=12 then '+' when k=13 then '-'
       when k in (16,17) then case when h=0 then '+' else '-' end
       else case when odd=0 then '+' else '-' end end l_or,
  case when k<=10 then '-' when k=11 then '+' when k=12 then '+' when k=13 then '-'
       when k=16 then case when h=0 then '+' else '-' end
       when k=17 then case when h=0 then '-' else '+' end
       when k=19 then case when odd=0 then '-' else '+' end
       else case when odd=0 then '+' else '-' end end r_or,
  1000000 + (p DIV 5)*5000 + q*(3+3*wide) + dc*2 as l0
 from c),
e as (
 select *, l0 + case when l_or='-' then 201 else 0 end l_start,
  case when k=10 then l0 + (q % 4)*40
       when k=9 and n=7 then l0 - 181
       else 1000000 + (p DIV 5)*5000 + 1200 + (s % 60) + tx*4 end
  + case when r_or='-' then 201 else 0 end r_start
 from d)
select concat(o,'.',n,'.',p,'.',s,'.',ep) as name, (p DIV 4)*1000 + o % 200 as fragment_id, n as mapping_id,
 1 + p % 5 as chr_l, l_start, l_start+49 as l_end, l_or,
 case when k>=16 then 1 + (p+1) % 5 else 1 + p % 5 end as chr_r, r_start, r_start+49 as r_end, r_or,
 cast(150 as bigint) as lmin, cast(350 as bigint) as lmax, s % 3 as sample
from e
"""

CONCORDANT = "select 1 + o_custkey % 5 as chr, 1000000 + ((o_orderkey*7919 + o_custkey*31) % 2000000) as f_start, 1000000 + ((o_orderkey*7919 + o_custkey*31) % 2000000) + 200 + o_orderkey % 100 as f_end from {orders}"
UNIQUENESS = "select 1 + p_partkey % 5 as chr, 1000000 + (p_partkey DIV 5)*5000 as u_start, 1000000 + (p_partkey DIV 5)*5000 + 1000 + p_size*20 as u_end, cast(1 + p_partkey % 37 as bigint) as value from {part}"
CGH = "select concat('pa',s_suppkey) as probe1, concat('pb',s_suppkey) as probe2, 1 + s_suppkey % 5 as chr, 1000000 + s_suppkey*9000 as c_start, 1000000 + s_suppkey*9000 + 6000 + cast(s_nationkey as bigint)*100 as c_end from {supplier}"
READS = """
select concat('r', event_id DIV 2) as name, event_id as ord, concat('lib', user_id % 3) as library,
 case when event_id % 2 = 0 then 99 else 147 end + case when event_id % 101 = 7 then 1024 else 0 end + case when event_id % 97 = 5 then 4 else 0 end as flag,
 1 + (event_id DIV 2) % 5 as chr, case when event_id % 17 = 0 then 5 else 30 end as mapq,
 1000000 + (event_id DIV 2)*40 + case when event_id % 2 = 1 then 150 + (event_id*13) % 120 else 0 end as pos,
 case when event_id % 23 = 0 then '12S38M' when event_id % 29 = 0 then '2S48M' else '50M' end as cigar,
 case when event_id % 31 = 3 then '-' when event_id % 2 = 0 then '+' else '-' end as strand
from {events}
"""
#: ``PR`` and most pairs of one chromosome once more with the right end 500 further on, which makes calls redundant
PR_AGAIN = f"""
with base as ({PR})
select * from base
union all
select concat(name, ':again') as name, fragment_id, mapping_id, chr_l, l_start, l_end, l_or, chr_r, r_start + 500 as r_start, r_end + 500 as r_end, r_or, lmin, lmax, sample
from base where chr_l = chr_r and fragment_id % 3 <> 0
"""
#: name -> (SQL, table that it reads)
TABLES = {"pr": (PR, "lineitem"), "pr_again": (PR_AGAIN, "lineitem"), "concordant": (CONCORDANT, "orders"), "uniqueness": (UNIQUENESS, "part"), "cgh": (CGH, "supplier"), "reads": (READS, "events")}


def duck(name: str) -> str:
    """The table's SQL for DuckDB."""
    sql, table = TABLES[name]
    return sql.replace("DIV", "//").format(**{table: table})


SMALL = 128 << 20
APART = 1 << 20


def _bytes(spark: SparkSession, path: str) -> int:
    fs, at = work.filesystem(spark, path)
    return fs.getFileStatus(at).getLen()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, table = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if len(files := rows.inputFiles()) == 1 and _bytes(spark, files[0]) < SMALL:  # one small file is one task: the rows are dealt over all cores first
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    else:  # above any number of tasks, so none are joined; but the scan is compiled apart: one method of both would be more than the JVM compiles, and interpreted
        rows = rows.coalesce(APART)
    return spark.sql(sql.replace("DIV", "div"), **{table: rows})
