"""Queries over files against their SQL, on the smallest tables; manifests of many files."""

import time

import duckdb
import pytest

from strandline.operators import clusters
from strandline.plans import catalog, files
from strandline.sources import fixtures, text

SF = "/root/testdata/sf0.001"
NAMES = ["sam_header", "pairs_read", "manifest_read", "intervals_read", "cgh_read", "tracks_read", "split_counts_read", "chromosomes_mapped", "references_skipped", "discordants_written", "low_quality_written", "metadata_lines", "depth_lines", "components_written", "pairs_counted", "pairs_sorted_by_band", "cluster_points", "platform_flips", "length_bounds_by_library", "fragment_names_odd", "reads_sam_and_bam", "reads_table", "reads_fastq", "reads_routed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_file_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in duck.execute(f"select {quoted} from ({catalog.ORACLE_SQL[name]})").fetchall()) and got


def test_all_file_queries_are_in_the_catalog():
    assert all(catalog.QUERIES[n].__module__ in (files.__name__, catalog.__name__) for n in NAMES)


def test_manifests_of_many_files_are_one_scan(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for k in range(5000):
        (tmp_path / "f" / f"a {k}.pr").write_text(f"n{k}\t1\t1000\t1049\t+\t1\t9000\t9049\t-\n")
    # names with spaces can't be told in a manifest line, so every file is named without
    for p in (tmp_path / "f").iterdir():
        p.rename(p.with_name(p.name.replace(" ", "+")))
    (tmp_path / "list").write_text("".join(f"{tmp_path}/f/a+{k}.pr PR {k} {k + 9}\n" for k in range(5000)) + f"file://{tmp_path}/cgh CGH\n")
    start = time.time()
    df = text.read_manifest(spark, str(tmp_path / "list"))
    assert time.time() - start < 15
    assert df._jdf.queryExecution().analyzed().toString().count("Relation") == 1
    got = df.where("lmin in (3, 4999)").select("name", "lmin", "lmax", "source").collect()
    assert sorted(map(tuple, got)) == [("n3", 3, 12, f"{tmp_path}/f/a+3.pr"), ("n4999", 4999, 5008, f"{tmp_path}/f/a+4999.pr")]


def test_counts_and_pairs_come_from_one_job(spark):
    pr = fixtures.load(spark, SF, "pr")
    pairs, counts = clusters.valid_pairs_counted(pr)
    n = pairs.count()
    want = {r["reason"]: r["n"] for r in clusters.reject_report(pr).collect()}
    assert counts() == want and want["ok"] == n
