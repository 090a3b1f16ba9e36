"""Exploratory profiling (D-01 .. D-14, A-70 .. A-80, F-01 .. F-05).

Every profile is one (or two) aggregates over the table: wide one-pass
aggregates (one expression per column) followed by an unpivot of the single
result row, never one job per column. Percentiles are exact (linear
interpolation, per group) through the distributed quantile of
``riskflow.operators.prefix``; an ``exact=False`` switch uses ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.joins import join_groups


def _g(groups) -> list[str]:
    return [] if not groups else ([groups] if isinstance(groups, str) else list(groups))


def _unpivot_row(wide: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])
    return wide.select(F.explode(pairs).alias("x")).select("x.feature", f"x.{value}")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """A-70 / D-01 / D-13: rows, positives, rate, imbalance ratio and the integer weight."""
    y = F.col(label)
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 1).alias("n_pos"), F.count_if(y != 1).alias("n_neg"))
              .withColumn("pos_rate", F.col("n_pos") / F.col("n_rows"))
              .withColumn("imbalance_ratio", F.try_divide(F.col("n_neg"), F.col("n_pos")))
              .withColumn("scale_pos_weight", F.col("imbalance_ratio").cast("int"))
              .withColumn("n_columns", F.lit(len(df.columns))))


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """D-02 / K-04 / F-04: missing count and % per column in one pass, ranked."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    n = wide.select("_n")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("missing_count")) for i, c in enumerate(cols)])
    out = (wide.select("_n", F.explode(pairs).alias("x"))
               .select("x.feature", "x.missing_count", (F.col("x.missing_count") / F.col("_n") * 100).alias("missing_pct")))
    if only_missing:
        out = out.filter("missing_count > 0")
    w = Window.orderBy(F.col("missing_pct").desc(), F.col("feature"))  # one row per column
    del n
    return out.withColumn("missing_rank", F.row_number().over(w))


def missing_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D-03: co-occurrence of missing values as a 0/1 mask string over ``cols``."""
    mask = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def sentinel_frequency(df: DataFrame, col: str, sentinel) -> DataFrame:
    """D-07: rows carrying the sentinel and their share."""
    return df.agg(F.count_if(F.col(col) == F.lit(sentinel)).alias("n_sentinel"), F.count(F.lit(1)).alias("n_rows")) \
             .withColumn("sentinel_pct", F.col("n_sentinel") / F.col("n_rows") * 100)


def percentiles(df: DataFrame, col: str, qs: Sequence[float], groups: Sequence[str] = (), exact: bool = True,
                accuracy: int = 100000) -> DataFrame:
    """A-78: percentiles per group (exact linear interpolation by default)."""
    g0 = _g(groups)
    g = g0 or ["_all"]
    d = df if g0 else df.withColumn("_all", F.lit(0))
    x = F.col(col).cast("double")
    mx = d.groupBy(*g).agg(F.max(x).alias("max"))
    if exact:
        from riskflow.operators.prefix import exact_quantiles
        qt = exact_quantiles(d, col, qs, g).withColumnRenamed("q", "_p")
    else:
        arr = F.array(*[F.lit(float(q)) for q in qs])
        qt = d.groupBy(*g).agg(F.percentile_approx(x, arr, accuracy).alias("_p"))
    out = join_groups(qt, mx, g)  # one row per group on each side
    return out.select(*g0, *[F.col("_p")[i].alias(f"p{round(q * 100):g}") for i, q in enumerate(qs)], "max")


def box_stats(df: DataFrame, col: str, groups: Sequence[str] = ()) -> DataFrame:
    """D-05: quartiles, IQR, whiskers at data points within 1.5 IQR, outlier count (missing dropped)."""
    g = _g(groups)
    d = df.filter(F.col(col).isNotNull())
    x = F.col(col).cast("double")
    from riskflow.operators.prefix import exact_quantiles
    q = exact_quantiles(d, col, [0.25, 0.5, 0.75], g)
    q = q.select(*g, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    return (join_groups(d, q, g)
            .groupBy(*g, "q1", "median", "q3", "iqr")
            .agg(F.min(F.when(x >= lo, x)).alias("lower_whisker"), F.max(F.when(x <= hi, x)).alias("upper_whisker"),
                 F.count_if((x < lo) | (x > hi)).alias("n_outliers"), F.count(F.lit(1)).alias("n")))


def mann_whitney(df: DataFrame, col: str, label: str, first_class: int = 0) -> DataFrame:
    """D-06 / W-03: two-sided Mann-Whitney U with mid-ranks, tie-corrected sigma and continuity
    correction. U1 (first sample = ``first_class``) is the exact tie-aware pair count
    sum_g n_g (cp_g - p_g / 2) over distinct values in descending order, where p counts the
    first sample; the tie term sum (t^3 - t) comes from the same distinct-value table, so the
    whole test is one aggregate over the distributed running totals."""
    from riskflow.operators.metrics import score_points
    d = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"),
                                                 (F.col(label) == first_class).cast("int").alias("_first"))
    pts = score_points(d, "_first", "v")
    t = (F.col("p") + F.col("n")).cast("double")
    agg = pts.agg(F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2.0)).alias("u1"),
                  F.sum("p").alias("n1"), F.sum("n").alias("n2"), F.sum(t * t * t - t).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = (agg.withColumn("u", F.greatest(F.col("u1"), n1 * n2 - F.col("u1")))
              .withColumn("mu", n1 * n2 / 2)
              .withColumn("sigma", F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))))
    return out.withColumn("z", (F.col("u") - F.col("mu") - 0.5) / F.col("sigma"))


def mann_whitney_p(stats: DataFrame) -> DataFrame:
    """Two-sided normal p-value from the single result row of ``mann_whitney`` (erfc in a tiny
    Arrow-batched helper; Spark has no built-in erfc)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def erfc_p(z):  # one row
        return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2.0))) if v == v else float("nan"))

    return stats.withColumn("p_value", erfc_p(F.col("z")))


def corr_safe(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; NULL (not an error) for a constant column."""
    xp, yp = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xp) * F.stddev_pop(yp))


def corr_with_target(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """D-09 / K-05: Pearson correlation of each column with the label (pairwise complete), |r| ranked."""
    wide = df.agg(*[corr_safe(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"_{i}")
                    for i, c in enumerate(cols)])
    out = _unpivot_row(wide, cols, "corr").withColumn("abs_corr", F.abs("corr"))
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))  # one row per column
    return out.withColumn("corr_rank", F.row_number().over(w))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D-10: pairwise (NULL-skipping) correlations as (a, b, corr), one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[corr_safe(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{k}")
                    for k, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("corr"))
                    for k, (a, b) in enumerate(pairs)])
    half = wide.select(F.explode(arr).alias("x")).select("x.a", "x.b", "x.corr")
    mirror = half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return half.unionByName(mirror)


def frequency_top(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """A-73: value counts, most frequent first (ties by value), optionally the top n."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))
    return out.limit(n) if n else out


def normalized_pivot(df: DataFrame, row: str, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """A-74: within-class normalized frequency of ``row`` values, one column per class."""
    c = df.groupBy(row, label).agg(F.count(F.lit(1)).alias("n"))
    totals = c.groupBy(label).agg(F.sum("n").alias("_t"))  # one row per class
    c = c.join(totals, label, "inner").withColumn("share", F.col("n") / F.col("_t"))
    return c.groupBy(row).pivot(label, list(classes)).agg(F.first("share")).select(
        row, *[F.col(str(k)).alias(f"share_{k}") for k in classes])


def rate_by_category(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """A-75 / D-08: target rate and n by category for several categoricals in one pass
    (missing categories dropped), highest rate first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols])
    st = df.select(F.col(label).cast("double").alias("_y"), F.explode(pairs).alias("x")).select("_y", "x.*")
    return (st.filter(F.col("category").isNotNull()).groupBy("column", "category")
              .agg(F.avg("_y").alias("rate"), F.count(F.lit(1)).alias("n"))
              .withColumn("rate_pct", F.col("rate") * 100))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """A-71 / A-72 / D-11: rows, distinct keys, and mean / min / max rows per key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.avg("k").alias("rows_per_key_mean"),
                   F.min("k").alias("rows_per_key_min"), F.max("k").alias("rows_per_key_max"))


def impute_median(df: DataFrame, col: str, groups: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """A-79: median imputation (grouped when ``groups`` is given) plus a missing-indicator column."""
    from riskflow.operators.prefix import exact_quantiles
    g = _g(groups)
    med = exact_quantiles(df, col, [0.5], g).select(*g, F.col("q")[0].alias("_med"))
    joined = join_groups(df, med, g, "left")
    return joined.withColumns({out or f"{col}_IMPUTED": F.coalesce(F.col(col).cast("double"), F.col("_med")),
                               f"{col}_MISSING": F.col(col).isNull().cast("int")}).drop("_med")


def summary(df: DataFrame, col: str, groups: Sequence[str] = ()) -> DataFrame:
    """A-80: min / max / mean of a score."""
    g = _g(groups)
    return (df.groupBy(*g) if g else df).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))


def late_rate_by_class(inst: DataFrame, app: DataFrame, key: str, label: str) -> DataFrame:
    """A-76 (sign as in the feature pipeline: paid after due is late): per-key late rate,
    inner-joined to the label (J-03), summarized per class."""
    from riskflow.functions.nullsafe import flag
    late = flag(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT") > 0)  # N5: missing entry date -> 0
    per = inst.groupBy(key).agg(F.avg(late).alias("late_payment_rate"))
    j = per.join(app.select(key, label), key, "inner")
    return j.groupBy(label).agg(F.count(F.lit(1)).alias("n_keys"), F.avg("late_payment_rate").alias("mean_late_rate"),
                                F.max("late_payment_rate").alias("max_late_rate"))


def class_condition(col: Column | str, value) -> Column:
    """F-01: equality predicate on the class column."""
    return (F.col(col) if isinstance(col, str) else col) == F.lit(value)
