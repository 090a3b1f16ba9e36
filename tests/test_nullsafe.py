"""Micro-fixtures for the null and numeric rules (FIXTURES §4)."""

import math

from pyspark.sql import functions as F

from riskflow.functions import nullsafe as ns
from riskflow.operators import blocks, features
from riskflow.operators.aggspec import AggSpec, aggregate_block


def test_all_missing_group(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    specs = [AggSpec("s", "sum", "x"), AggSpec("m", "mean", "x"), AggSpec("mx", "max", "x"),
             AggSpec("sd", "std", "x"), AggSpec("c", "count", "x"), AggSpec("ge", "count_ge", "x", 1)]
    r = aggregate_block(df, "k", specs).collect()[0]
    assert r.s == 0 and r.m is None and r.mx is None and r.sd is None and r.c == 0 and r.ge == 0


def test_single_row_std_is_null(spark):
    df = spark.createDataFrame([(1, 3.0)], "k int, x double")
    assert aggregate_block(df, "k", [AggSpec("sd", "std", "x")]).collect()[0].sd is None


def test_clip_of_missing_stays_missing(spark):
    df = spark.createDataFrame([(None,), (7.0,), (-1.0,)], "x double")
    got = [r.c for r in df.select(ns.clip("x", 0, 5).alias("c")).collect()]
    assert got == [None, 5.0, 0.0]


def test_late_days_missing_entry(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 10.0, -10.0, None)],
                               "SK_ID_PREV long, SK_ID_CURR long, AMT_PAYMENT double, AMT_INSTALMENT double, "
                               "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double")
    r = blocks.prepare_instalments(df).collect()[0]
    assert r.DAYS_LATE is None and r.LATE_FLAG == 0 and r.DAYS_EARLY is None


def test_row_stats(spark):
    df = spark.createDataFrame([(0.2, None, 0.6), (None, None, None)], "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    a, b = features.row_stat_features(df).collect()
    assert math.isclose(a.EXT_SOURCE_MEAN, 0.4) and math.isclose(a.EXT_SOURCE_STD, 0.28284271, rel_tol=1e-6)
    assert a.EXT_SOURCE_MAX == 0.6 and a.EXT_SOURCE_MIN == 0.2 and a.EXT_SOURCE_PROD == 0.0
    assert b.EXT_SOURCE_MEAN is None and b.EXT_SOURCE_STD is None and b.EXT_SOURCE_MAX is None and b.EXT_SOURCE_PROD == 0.0


def test_payment_ratio_zero_instalment_is_clipped(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 0.0, -5.0, -5.0)],
                               "SK_ID_PREV long, SK_ID_CURR long, AMT_PAYMENT double, AMT_INSTALMENT double, "
                               "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double")
    assert blocks.prepare_instalments(df).collect()[0].PAYMENT_RATIO == 5.0


def test_sentinel(spark):
    df = spark.createDataFrame([(365243,), (-100,)], "DAYS_EMPLOYED int")
    rows = features.sentinel_features(df).collect()
    assert (rows[0].FLAG_DAYS_EMPLOYED_ANOM, rows[0].DAYS_EMPLOYED) == (1, None)
    assert (rows[1].FLAG_DAYS_EMPLOYED_ANOM, rows[1].DAYS_EMPLOYED) == (0, -100)


def test_status_decode(spark):
    df = spark.createDataFrame([("C",), ("X",), ("3",), ("9",)], "STATUS string")
    got = [r.v for r in df.select(blocks.decode_status("STATUS").alias("v")).collect()]
    assert got == [0, None, 3, None]


def test_applicant_without_history_keeps_nulls(spark):
    from riskflow.operators.joins import star_join
    app = spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")
    prev = spark.createDataFrame([(10, 1, "Approved")], "SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_STATUS string")
    agg = aggregate_block(prev, "SK_ID_CURR", [AggSpec("n", "count", "SK_ID_PREV"),
                                               AggSpec("a", "count_eq", "NAME_CONTRACT_STATUS", "Approved")])
    r = {x.SK_ID_CURR: x for x in star_join(app, [agg], "SK_ID_CURR").collect()}
    assert r[1].n == 1 and r[1].a == 1 and r[2].n is None and r[2].a is None


def test_zero_denominator_gives_null_not_error(spark):
    df = spark.createDataFrame([(5.0, -1.0)], "a double, b double")
    assert df.select(ns.ratio_plus1("a", "b").alias("r")).collect()[0].r is None


def test_falsy_default(spark):
    df = spark.createDataFrame([(0.0, 7.0), (None, 7.0), (3.0, 7.0)], "x double, y double")
    got = [r.v for r in df.select(ns.falsy_default("x", F.col("y")).alias("v")).collect()]
    assert got == [7.0, 7.0, 3.0]


def test_row_statistics_match_numpy_on_random_rows(spark):
    import random

    import numpy as np
    rnd = random.Random(21)
    rows = [tuple(None if rnd.random() < 0.3 else round(rnd.random(), 3) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    got = features.row_stat_features(df).collect()
    for r, src in zip(sorted(got, key=lambda x: tuple(-1 if v is None else v for v in x[:3])),
                      sorted(rows, key=lambda x: tuple(-1 if v is None else v for v in x))):
        vals = np.array([np.nan if v is None else v for v in src])
        present = vals[~np.isnan(vals)]
        if present.size == 0:
            assert r.EXT_SOURCE_MEAN is None and r.EXT_SOURCE_MAX is None
        else:
            assert math.isclose(r.EXT_SOURCE_MEAN, present.mean(), abs_tol=1e-12)
            assert r.EXT_SOURCE_MAX == present.max() and r.EXT_SOURCE_MIN == present.min()
        if present.size >= 2:
            assert math.isclose(r.EXT_SOURCE_STD, present.std(ddof=1), abs_tol=1e-12)
        else:
            assert r.EXT_SOURCE_STD is None
        assert math.isclose(r.EXT_SOURCE_PROD, float(np.prod(np.nan_to_num(vals, nan=0.0))), abs_tol=1e-12)


def test_block_aggregates_match_python_on_random_groups(spark):
    import random
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 20), None if rnd.random() < 0.25 else float(rnd.randint(-5, 5))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, x double")
    specs = [AggSpec("s", "sum", "x"), AggSpec("c", "count", "x"), AggSpec("ge", "count_ge", "x", 1),
             AggSpec("mx", "max", "x"), AggSpec("nu", "nunique", "x")]
    got = {r.k: r for r in aggregate_block(df, "k", specs).collect()}
    for k in set(g for g, _ in rows):
        xs = [x for g, x in rows if g == k and x is not None]
        r = got[k]
        assert r.s == sum(xs) and r.c == len(xs) and r.ge == sum(1 for x in xs if x >= 1)
        assert r.mx == (max(xs) if xs else None) and r.nu == len(set(xs))
