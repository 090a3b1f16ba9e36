"""Representative query keys against their DuckDB oracles on the smallest test tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from riskflow.sources.tables import DRIVER_TABLES

SMALL = "/root/testdata/sf0.001"
KEYS = ["feat_two_level_credit", "feat_instalment_block", "feat_row_stats", "rank_metrics", "roc_points",
        "threshold_sweep", "woe_oof", "calibration_bins", "psi_score", "box_stats", "validate_split",
        "advice_rules", "stream_score", "stream_counters", "evaluation_report", "blend_scores", "feat_star_join"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert _hash(df.columns, rows) == _hash(rel.columns, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "bureau_total_loans" in df.columns


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
