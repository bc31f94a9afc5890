"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge.plans import catalog


def _value(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, smoke, name):
    c = duckdb.connect()
    for f in glob.glob(f"{smoke}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = c.execute(catalog.ORACLES[name])
    cols = [x[0] for x in cur.description]
    df = catalog.QUERIES[name](spark, smoke)
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(_value(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(_value(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["within_fit_covariates", "moderated_variance", "gls_probe_model", "tv_track", "permutation_null", "hmm_blocks", "bumphunter_like", "blockfinder_like", "fisher_group_array", "hwe_tail", "audit_simulation"])
def test_kernel_queries_run(spark, smoke, name):
    assert catalog.QUERIES[name](spark, smoke).count() > 0
