"""Registered queries against their SQL, run by another engine on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
QUICK = [
    "campaign_parameters", "double_exact", "double_variance_fix_alpha", "interpolate_by_key", "matching_locations", "merge_double_ended", "noise_bins", "noise_exponential", "p1_statuses", "p3_counter", "p3_grid", "p5_found", "p6_found", "p6_table", "p7_found", "pair_times",
    "report_sigma", "resample_mean", "sections_levels", "shift_errors", "single_components", "single_p_cov", "source_header_fields", "source_silixa", "stored_recording",
]


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield c
    c.close()


def sorted_rows(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUICK)
@pytest.mark.filterwarnings("ignore")
def test_query_equals_its_sql(spark, engine, name):
    df = entry.queries()[name](spark, FOLDER)
    found = engine.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted_rows(df.collect()) == sorted_rows(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_sql_belongs_to_a_query_and_the_flagship_runs(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["run_id", "slot_us"]
