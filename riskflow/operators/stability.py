"""Population stability (V-17, V-18) and the drift report (X-01 .. X-04).

One table of (feature, value, expected rows, actual rows) is counted from one scan
of each population and written once. Edges (quantiles of the *expected* population,
one small row per feature), the bin counts of both populations and both means come
from that table. Several features are handled in one pass by unpivoting them to
(feature, value) first.

Bin rule (as the reference's histogram): bin j holds e_j <= x < e_{j+1},
the last bin is closed, values outside [e_0, e_B] are not counted but stay
in the denominator. Shares are floored at 1e-4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.calibration import quantile_levels
from riskflow.operators.joins import join_groups
from riskflow.operators.prefix import exact_quantiles
from riskflow.session import cut_lineage

PSI_FLOOR = 1e-4
# Status bands and texts of the drift report.
PSI_STABLE, PSI_MODERATE = 0.10, 0.25
STATUS_STABLE, STATUS_MODERATE, STATUS_CRITICAL = "stable", "moderate", "critical"
RECOMMENDATIONS = {
    STATUS_STABLE: "No action needed. Model is stable.",
    STATUS_MODERATE: "Monitor closely. Consider retraining within 30 days.",
    STATUS_CRITICAL: "Retrain model immediately.",
}


def psi_status(c):
    """V-18 / X-02: <0.10 stable, <0.25 moderate, else critical."""
    return (F.when(c < PSI_STABLE, F.lit(STATUS_STABLE))
             .when(c < PSI_MODERATE, F.lit(STATUS_MODERATE)).otherwise(F.lit(STATUS_CRITICAL)))


def _g(groups) -> list[str]:
    return [] if not groups else ([groups] if isinstance(groups, str) else list(groups))


def population_table(expected: DataFrame, actual: DataFrame, col: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., x, e, a): how many rows of each population have a value. Each population is read once, here; the table
    is written to the shared folder, and edges, bin counts and means all come from it."""
    g = _g(groups)
    x = F.col(col).cast("double").alias("x")
    both = (expected.select(*g, x, F.lit(1).cast("long").alias("e"), F.lit(0).cast("long").alias("a"))
            .unionByName(actual.select(*g, x, F.lit(0).cast("long").alias("e"), F.lit(1).cast("long").alias("a"))))
    return cut_lineage(both.groupBy(*g, "x").agg(F.sum("e").alias("e"), F.sum("a").alias("a")))


def _psi(table: DataFrame, g: list[str], buckets: int) -> DataFrame:
    """(groups..., psi, status, mean_expected, mean_actual) from a population table; groups without an expected value have no
    edges and are left out, a NULL group is a group like any other."""
    edges = exact_quantiles(table, "x", quantile_levels(buckets), g, weight="e").withColumnRenamed("q", "edges")
    rows = join_groups(table, edges, g)
    e = F.col("edges")
    in_range = (F.col("x") >= F.element_at(e, 1)) & (F.col("x") <= F.element_at(e, buckets + 1))
    # Number of edges e_0..e_{B-1} that are <= x, minus one; the closed last bin falls out of the same rule.
    rows = rows.withColumn("bin", F.when(in_range, F.size(F.filter(F.slice(e, 1, buckets), lambda v: v <= F.col("x"))) - 1))
    sums = [F.sum(F.when(F.col("bin") == j, F.col(w))).alias(f"{w}{j}") for w in "ea" for j in range(buckets)]
    known = F.col("x").isNotNull()
    means = [F.try_divide(F.sum(F.col("x") * F.col(w)), F.sum(F.when(known, F.col(w)))).alias(f"m{w}") for w in "ea"]
    out = (rows.groupBy(*g) if g else rows).agg(*sums, F.sum("e").alias("te"), F.sum("a").alias("ta"), *means)

    def share(w: str, j: int):
        return F.greatest(F.coalesce(F.try_divide(F.col(f"{w}{j}"), F.col(f"t{w}")), F.lit(0.0)), F.lit(PSI_FLOOR))
    shares = F.array(*[F.struct(share("e", j).alias("e"), share("a", j).alias("a")) for j in range(buckets)])
    total = F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + (s["e"] - s["a"]) * F.ln(s["e"] / s["a"]))
    return out.filter("te > 0").select(*g, total.alias("psi"), F.col("me").alias("mean_expected"), F.col("ma").alias("mean_actual")).withColumn(
        "status", psi_status(F.col("psi")))


def psi(expected: DataFrame, actual: DataFrame, col: str, groups: Sequence[str] = (), buckets: int = 10) -> DataFrame:
    """V-17: PSI per group of ``actual`` against quantile buckets of ``expected``."""
    g = _g(groups)
    return _psi(population_table(expected, actual, col, g), g, buckets).select(*g, "psi", "status")


def unpivot_features(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value")


def drift_report(baseline: DataFrame, live: DataFrame, features: Sequence[str], buckets: int = 10) -> DataFrame:
    """X-01: (feature, psi, status, mean_train, mean_live) for every feature, in one pass per population."""
    table = population_table(unpivot_features(baseline, features), unpivot_features(live, features), "value", ["feature"])
    return _psi(table, ["feature"], buckets).select(
        "feature", "psi", "status", F.col("mean_expected").alias("mean_train"), F.col("mean_actual").alias("mean_live"))


def drift_summary(report: DataFrame, drift_cut: float = PSI_STABLE) -> DataFrame:
    """X-02, X-03: overall PSI (mean over features), status, recommendation, drifted features."""
    overall = F.avg("psi")
    rec = F.create_map(*[x for k, v in RECOMMENDATIONS.items() for x in (F.lit(k), F.lit(v))])
    drifted = F.array_sort(F.collect_list(F.when(F.col("psi") > drift_cut, F.col("feature"))))
    return (report.agg(overall.alias("overall_psi"), drifted.alias("drifted"),
                       F.count_if(F.col("psi") > drift_cut).alias("n_drifted"))
                  .withColumn("overall_status", psi_status(F.col("overall_psi")))
                  .withColumn("recommendation", rec[F.col("overall_status")])
                  .withColumn("drifted_features", F.array_join("drifted", ","))
                  .drop("drifted"))
