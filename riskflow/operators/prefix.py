"""Distributed ordered prefix sums and exact quantiles.

Running totals in value order are the core of exact rank metrics and exact
quantiles. A single ``Window.orderBy`` over a whole group would move the
group into one task, so instead:

1. rows are first collapsed to one row per (group, distinct value);
2. the distinct values are range-partitioned on (group, value)
   (``repartitionByRange``: sampled boundaries and a binary search per row,
   Spark's own distributed-sort machinery); the partition id is the bucket.
   It is monotone in the value within a group whatever the distribution or
   skew, and the number of buckets follows ``spark.sql.shuffle.partitions``
   (adaptive coalescing merges neighbouring ranges, which keeps the order);
3. per-(group, bucket) totals form a small table whose running totals give
   each bucket's offset;
4. the running total inside a bucket is a window partitioned by
   (group, bucket), and offset + inner running total is the exact prefix.

A bucket can hold several groups' ranges and a group can span many buckets;
both are handled because every bucket-level quantity is keyed by (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.literals import struct_array
from riskflow.session import cut_lineage


def _g(groups) -> list[str]:
    return [] if not groups else ([groups] if isinstance(groups, str) else list(groups))


def with_buckets(hist: DataFrame, value: str, groups: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add bucket id ``_b`` = range-partition id of (groups, value): monotone in ``value``
    within a group. ``buckets`` fixes the number of ranges (default: shuffle partitions)."""
    keys = [*_g(groups), value]
    h = hist.repartitionByRange(buckets, *keys) if buckets else hist.repartitionByRange(*keys)
    # The boundaries are sampled: written once, so that offsets and rows read the same bucket ids.
    return cut_lineage(h.withColumn("_b", F.spark_partition_id()))


def prefix_sums(hist: DataFrame, value: str, weights: Sequence[str], groups: Sequence[str] = (),
                descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Inclusive running totals ``cum_<w>`` of each weight column in value order per group.

    ``hist`` must have one row per (groups, value). Adds ``_b``, the group totals
    ``tot_<w>``, and per bucket ``_head`` (struct of the weights of the bucket's first
    row in order) and ``_next_head`` (first row of the next non-empty bucket) for
    neighbour lookups. Every join is an equi-join on (groups, bucket)."""
    g = _g(groups)
    if not g:
        hist, g = hist.withColumn("_all", F.lit(0)), ["_all"]
    h = with_buckets(hist, value, g, buckets)
    order_b = F.col("_b").desc() if descending else F.col("_b").asc()
    wb = Window.partitionBy(*g).orderBy(order_b)
    head = F.struct(*[F.col(w).alias(w) for w in weights])
    pick = F.max_by if descending else F.min_by
    bt = h.groupBy(*g, "_b").agg(*[F.sum(w).alias(f"_bt_{w}") for w in weights],
                                 pick(head, F.col(value)).alias("_head"))
    for w in weights:
        bt = bt.withColumn(f"_off_{w}", F.coalesce(F.sum(f"_bt_{w}").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                                   F.lit(0)))
    per_group = Window.partitionBy(*g)  # over the small per-bucket table
    for w in weights:
        bt = bt.withColumn(f"tot_{w}", F.sum(f"_bt_{w}").over(per_group))
    bt = bt.withColumn("_next_head", F.lead("_head").over(wb)).drop(*[f"_bt_{w}" for w in weights])
    order_v = F.col(value).desc() if descending else F.col(value).asc()
    w_in = Window.partitionBy(*g, "_b").orderBy(order_v)
    run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    # A NULL group is a group like any other.
    names = {c: f"_k_{c}" for c in [*g, "_b"]}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    out = h.join(bt.withColumnsRenamed(names), same, "inner").drop(*names.values())
    for w in weights:
        out = out.withColumn(f"cum_{w}", F.col(f"_off_{w}") + F.sum(w).over(run)).drop(f"_off_{w}")
    return out, w_in


def exact_quantiles(df: DataFrame, col: str, levels: Sequence[float], groups: Sequence[str] = (),
                    buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (the rule of Spark ``percentile`` and SQL
    ``quantile_cont``: position h = q (n - 1), value = x_floor + (x_ceil - x_floor)(h - floor(h))),
    computed without gathering a group's values in one task.
    ``weight``: a column that says how many rows a row stands for. Returns (groups..., q array<double>) in the order of
    ``levels``."""
    g0 = _g(groups)
    g = g0 or ["_all"]
    x = F.col(col).cast("double")
    d = df if g0 else df.withColumn("_all", F.lit(0))
    hist = d.filter(x.isNotNull()).groupBy(*g, x.alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    if weight:
        hist = hist.filter("_c > 0")
    pref, _ = prefix_sums(hist, "_v", ["_c"], g, descending=False, buckets=buckets)
    # 0-based positions wanted per level: h = q (n - 1), floor(h) and ceil(h). Each distinct
    # value covers positions [cum - c, cum); a row keeps the levels whose positions it covers.
    levels_arr = struct_array([{"i": i, "q": float(q)} for i, q in enumerate(levels)])
    nm1 = (F.col("tot__c") - 1).cast("double")
    start = F.col("cum__c") - F.col("_c")
    end_ = F.col("cum__c")

    def covers(r):
        h = r["q"] * nm1
        lo, hi = F.floor(h), F.ceil(h)
        return ((lo >= start) & (lo < end_)) | ((hi >= start) & (hi < end_))

    hits = (pref.select(*g, "_v", start.alias("_s"), end_.alias("_e"), nm1.alias("_nm1"),
                        F.explode(F.filter(levels_arr, covers)).alias("_r"))
                .select(*g, "_v", "_s", "_e", F.col("_r.i").alias("_i"), (F.col("_r.q") * F.col("_nm1")).alias("_h"))
                .withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h")))
    lo_v = F.when((F.col("_lo") >= F.col("_s")) & (F.col("_lo") < F.col("_e")), F.col("_v"))
    hi_v = F.when((F.col("_hi") >= F.col("_s")) & (F.col("_hi") < F.col("_e")), F.col("_v"))
    per = hits.groupBy(*g, "_i", "_h", "_lo", "_hi").agg(F.max(lo_v).alias("_a"), F.max(hi_v).alias("_b2"))
    # Equal neighbours need no interpolation (exactly the value, as Spark and DuckDB return).
    val = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_a") == F.col("_b2")), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b2") - F.col("_a")) * (F.col("_h") - F.col("_lo")))
    res = per.select(*g, "_i", val.alias("_q"))
    out = res.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_i", "_q"))).alias("_qs"))  # levels per group
    return out.select(*g0, F.transform("_qs", lambda s: s["_q"]).alias("q"))


def quantile_column(levels: Sequence[float], arr: Column | str = "q") -> list[Column]:
    a = F.col(arr) if isinstance(arr, str) else arr
    return [a[i] for i in range(len(levels))]
