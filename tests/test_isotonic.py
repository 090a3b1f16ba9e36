"""Isotonic calibration in partitions against the library's own fit and against plain pooling."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskflow.operators import calibration as C


def library(df, out="want"):
    return IsotonicRegression(featuresCol="s", labelCol="y", predictionCol=out).fit(df.filter("s IS NOT NULL AND y IS NOT NULL"))


@pytest.mark.parametrize("shape,partitions", [("noise", 1), ("noise", 16), ("falling", 16), ("rising", 7), ("waves", 16), ("ties", 3)])
def test_blocks_are_those_of_one_pass(spark, shape, partitions):
    rng = np.random.default_rng(len(shape))
    s = rng.random(1500) if shape != "ties" else np.round(rng.random(1500), 2)
    p = {"noise": 0.5, "falling": 1 - s, "rising": s, "waves": 0.5 + 0.4 * np.sin(20 * s), "ties": s}[shape]
    y = (rng.random(1500) < p).astype(float)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y double").repartition(5)
    got = np.array(sorted(map(tuple, C.isotonic_blocks(df, "y", "s", partitions, 5).collect())))
    x, at = np.unique(s, return_inverse=True)
    want = np.stack(C.pool(x, x, np.bincount(at, y), np.bincount(at).astype(float)), axis=1)
    assert np.allclose(got, want) and (np.diff(got[:, 2] / got[:, 3]) > 0).all() and got[:, 3].sum() == 1500


def test_calibrated_scores_are_those_of_the_library(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(s) if i % 50 else None, float(rng.random() < s ** 2) if i % 7 else None) for i, s in enumerate(np.round(rng.random(3000), 3))]
    df = spark.createDataFrame(rows, "id long, s double, y double")
    got = {r.id: r.c for r in C.isotonic_calibration(df, "y", "s", "c").collect()}
    known = df.filter("s IS NOT NULL")
    want = {r.id: r.want for r in library(df).transform(known).collect()}
    assert len(got) == 3000 and all(got[i] is None for i in got if i not in want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    # New scores: between blocks on a line, beyond the ends flat.
    new = spark.createDataFrame([(i, float(s)) for i, s in enumerate(rng.random(500) * 1.4 - 0.2)], "id long, s double")
    got = {r.id: r.c for r in C.apply_isotonic(new, C.isotonic_blocks(df, "y", "s", 6), "s", "c").collect()}
    want = {r.id: r.want for r in library(df).transform(new).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_many_distinct_scores(spark):
    df = spark.range(1_000_000).select(F.rand(3).alias("s")).withColumn("y", (F.rand(4) < F.col("s")).cast("double"))
    df = df.repartition(8).persist()
    try:
        blocks = C.isotonic_blocks(df, "y", "s").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("c")).first()
        assert blocks.n == 1_000_000 and blocks.y == df.agg(F.sum("y")).first()[0] and blocks.c < 20_000
        model = library(df)
        values = sorted(set(model.predictions.toArray().tolist()))
        assert blocks.c == len(values)
    finally:
        df.unpersist()


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(0.5, None), (None, 1.0)], "s double, y double")
    assert C.isotonic_blocks(df, "y", "s").count() == 0
    assert [r.c for r in C.isotonic_calibration(df, "y", "s", "c").collect()] == [None, None]
