"""Calibration table (V-15), score density by class (V-16) and probability calibration (M-14).

Quantile edges are exact linear-interpolation percentiles per group, computed
with the distributed prefix sum of ``riskflow.operators.prefix`` (no group is
gathered into one task); ``exact=False`` uses ``percentile_approx``. Rows are
then binned by comparing with the small per-group edge array (one row per
group; adaptive execution broadcasts it from its measured size).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.literals import double_array
from riskflow.operators.joins import join_groups
from riskflow.session import cut_lineage


def _g(groups) -> list[str]:
    return [] if not groups else ([groups] if isinstance(groups, str) else list(groups))


def quantile_levels(n_bins: int) -> list[float]:
    """Fixed rule of the reference: np.linspace(0, 1, n_bins + 1)."""
    return [float(x) for x in np.linspace(0, 1, n_bins + 1)]


def quantile_edges(df: DataFrame, col: str, n_bins: int, groups: Sequence[str] = (),
                   exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """(groups..., edges array<double>) with n_bins + 1 edges per group."""
    g = _g(groups)
    if exact:
        from riskflow.operators.prefix import exact_quantiles
        return exact_quantiles(df, col, quantile_levels(n_bins), g).withColumnRenamed("q", "edges")
    levels = double_array(quantile_levels(n_bins))
    agg = F.percentile_approx(F.col(col).cast("double"), levels, accuracy)
    return df.groupBy(*g).agg(agg.alias("edges")) if g else df.agg(agg.alias("edges"))


def calibration_bins(df: DataFrame, label: str = "label", score: str = "prob", n_bins: int = 15,
                     groups: Sequence[str] = ()) -> DataFrame:
    """V-15: quantile bins; bin id = number of inner edges strictly below the score
    (an edge value goes to the lower bin); empty bins are absent."""
    g = _g(groups)
    edges = quantile_edges(df, score, n_bins, g)
    rows = join_groups(df.select(*g, label, score), edges, g)
    inner = F.slice(F.col("edges"), 2, n_bins - 1)
    binned = rows.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(score))))
    return (binned.groupBy(*g, "bin")
                  .agg(F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_rate"),
                       F.count(F.lit(1)).alias("n")))


def density_by_class(df: DataFrame, col: str, label: str = "label", bins: int = 40,
                     groups: Sequence[str] = ()) -> DataFrame:
    """V-16 / D-04: equal-width histogram per class with density n / (total * width);
    the last bin is closed. Range = min/max over all rows of the group."""
    g = _g(groups)
    x = F.col(col).cast("double")
    if g:
        rng = df.groupBy(*g).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))  # one row per group
        rows = join_groups(df.filter(x.isNotNull()).select(*g, label, col), rng, g)
    else:  # two scalars for the whole table
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
        rows = df.filter(x.isNotNull()).select(label, col, F.lit(r.lo).cast("double").alias("lo"),
                                               F.lit(r.hi).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = (rows.withColumn("bin", idx)
                   .groupBy(*g, label, "bin", "lo", "hi")
                   .agg(F.count(F.lit(1)).alias("n")))
    per_class = Window.partitionBy(*g, label)
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return (counted.withColumn("class_total", F.sum("n").over(per_class))
                   .withColumn("bin_lo", F.col("lo") + F.col("bin") * w)
                   .withColumn("density", F.try_divide(F.col("n"), F.col("class_total") * w))
                   .drop("lo", "hi"))


def platt_scaling(df: DataFrame, label: str, margin: str, out: str = "prob_cal") -> DataFrame:
    """M-14 sigmoid: one-feature logistic regression on the model margin (Spark ML)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=[margin], outputCol="_m")
    lr = LogisticRegression(featuresCol="_m", labelCol=label, regParam=0.0, probabilityCol="_p",
                            rawPredictionCol="_r", predictionCol="_y")
    fitted = lr.fit(va.transform(df))
    scored = fitted.transform(va.transform(df))
    return scored.withColumn(out, vector_to_array("_p")[1]).drop("_m", "_p", "_r", "_y")


def pool(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks, by ascending score, pooled until their means ascend."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), y.tolist(), n.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, ys, ns = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = top, out[-1][2] + ys, out[-1][3] + ns
    return tuple(np.array([b[k] for b in out], float) for k in range(4))


LEAST_BLOCKS = 4096
_BLOCKS = "lo double, hi double, y double, n double"


def isotonic_blocks(df: DataFrame, label: str, score: str, partitions: int | None = None, least: int = LEAST_BLOCKS) -> DataFrame:
    """M-14: blocks (lo, hi, y, n) of the isotonic regression of the label on the score: y / n ascends with the score.

    Scores are collapsed to distinct values and range-partitioned; each partition pools its own adjacent violators. Pooling
    may be done in any order, so the blocks are dealt by range again, into other partitions (of ``least`` blocks or more, so
    neighbours come together), until no two neighbours across partitions violate the order either. The driver sees the
    two end blocks of each partition."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(score).cast("double")
    blocks = df.filter(x.isNotNull() & F.col(label).isNotNull()).groupBy(x.alias("lo")).agg(
        F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n")).select("lo", F.col("lo").alias("hi"), "y", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [b[c].to_numpy() for c in ("lo", "hi", "y", "n")]
            held = pool(*(rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]))
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["lo", "hi", "y", "n"])

    rounds = 0
    while True:
        dealt = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
        blocks = cut_lineage(dealt.mapInArrow(run, _BLOCKS).withColumn("_p", F.spark_partition_id()))
        block = F.struct("lo", "y", "n")
        ends = blocks.groupBy("_p").agg(F.min(block).alias("first"), F.max(block).alias("last"), F.count(F.lit(1)).alias("c")).orderBy("first.lo").collect()
        blocks = blocks.drop("_p")
        if all(a.last.y * b.first.n < b.first.y * a.last.n for a, b in zip(ends, ends[1:])):
            return blocks
        rounds += 1
        most = max(1, sum(e.c for e in ends) // least)
        parts = min(max(parts - 1, 1) if rounds % 2 else parts + 1, most)


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str, out: str = "prob_cal") -> DataFrame:
    """All rows with the calibrated score: the mean of the block that holds it, between two blocks the straight line, beyond
    the first and last their means; a null score has none.

    Distinct scores and blocks are range-partitioned together and the neighbours of each score are found within the
    partition, or in the end blocks of the next partitions (one row each)."""
    x = F.col(score).cast("double")
    value = F.col("y") / F.col("n")
    marks = blocks.select(F.col("lo").alias("x"), F.struct("lo", "hi", value.alias("v")).alias("block"))
    asked = df.filter(x.isNotNull()).select(x.alias("x")).distinct().withColumn("block", F.lit(None).cast(marks.schema["block"].dataType))
    both = cut_lineage(marks.unionByName(asked).repartitionByRange("x").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p")
    up = own.orderBy("x", F.col("block").isNull())
    ends = both.filter("block IS NOT NULL").groupBy("_p").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    ends = both.select("_p").distinct().join(ends, "_p", "left")
    order = Window.orderBy("_p")                                            # a row a partition
    ends = ends.select(F.col("_p").alias("_q"), F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                       F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    near = both.select("x", "block", "_p", F.last("block", True).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
                       F.first("block", True).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("_b"))
    near = near.filter("block IS NULL").join(ends, F.col("_p") == F.col("_q")).select(
        "x", F.coalesce("_a", "_before").alias("a"), F.coalesce("_b", "_after").alias("b"))
    share = (F.col("x") - F.col("a.hi")) / (F.col("b.lo") - F.col("a.hi"))
    got = (F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("x") <= F.col("a.hi")), F.col("a.v"))
           .otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share))
    table = near.select(F.col("x").alias("_x"), got.alias(out))
    return df.join(table, x == F.col("_x"), "left").drop("_x")


def isotonic_calibration(df: DataFrame, label: str, score: str, out: str = "prob_cal") -> DataFrame:
    """M-14 isotonic: rows with their label regressed on their score in ascending steps; fitted on the rows that have both."""
    return apply_isotonic(df, isotonic_blocks(df, label, score), score, out)
