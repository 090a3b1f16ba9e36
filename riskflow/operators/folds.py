"""Stratified fold assignment (W-01), class weights (M-01) and fold summaries (A-77, D-14).

Folds are reproducible without a shuffle of all rows into one task per
class: within each class rows are ordered by ``md5(id || ':' || seed)`` and
the fold is ``(rank - 1) mod k``, so class counts per fold differ by at most
one. The exact rank is a distributed prefix sum: the first four hex digits
of the hash give 65536 buckets (uniform by construction, so a class holding a
third of all rows is still spread evenly), bucket counts form a small table
whose running totals give each bucket's offset, and ``row_number`` runs only
inside a (class, bucket) partition. Rows without a label are a class of
their own; rows without an id come last in their class, in buckets by a hash
of their columns of fixed width (texts are not read for it). No row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType

from riskflow.operators.joins import bounded_broadcast

HASH_BUCKET_HEX = 4
MOST_CLASSES = 15       # of a label, for which offsets are broadcast and weights are literals


def fold_hash(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """W-01: add ``fold`` in [0, k) stratified by ``label``; a NULL label is a class of its own."""
    h, n = fold_hash(id_col, seed), 16 ** HASH_BUCKET_HEX
    known = F.conv(F.substring("_h", 1, HASH_BUCKET_HEX), 16, 10).cast("int")
    fixed = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType, DateType))]
    rest = (F.lit(n) + F.pmod(F.xxhash64(F.lit(seed), *fixed), F.lit(n))).cast("int")
    d = df.withColumn("_h", h).withColumn("_b", F.when(F.col("_h").isNull(), rest).otherwise(known))
    counts = d.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy("_l").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wb), F.lit(0))).drop("_c")
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))
    # Offsets table: at most classes x 2 buckets (id or NULL id); broadcast where that is known to be small.
    classes = df.select(label).distinct().limit(MOST_CLASSES + 1).count()
    bound = 2 * n * classes if classes <= MOST_CLASSES else None
    on = F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_bucket"))
    return (d.join(bounded_broadcast(offs, bound=bound), on, "inner")
             .withColumn(out, ((F.col("_off") + rn - 1) % F.lit(k)).cast("int"))
             .select(label, *[f"`{c}`" for c in df.columns if c not in (label, out)], out))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M-01: per class n, balanced weight n_total / (2 n_class) and the integer neg/pos ratio."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy(F.lit(1))  # two rows
    pos = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(tot)
    neg = F.sum(F.when(F.col(label) != 1, F.col("n"))).over(tot)
    return (c.withColumn("balanced_weight", F.sum("n").over(tot) / (2.0 * F.col("n")))
             .withColumn("scale_pos_weight", F.try_divide(neg, pos).cast("int")))


def with_weight_column(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M-01 as a ``weightCol`` for Spark ML (balanced)."""
    w = {r[label]: r.balanced_weight for r in class_weights(df, label).limit(MOST_CLASSES + 1).collect() if r[label] is not None}
    if len(w) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes in {label}")
    table = F.create_map(*[F.lit(x) for kv in w.items() for x in kv]) if w else None
    return df.withColumn(out, F.try_element_at(table, F.col(label)) if w else F.lit(None).cast("double"))


def fold_stability(per_fold: DataFrame, metric: str, fold: str = "fold", groups=()) -> DataFrame:
    """A-77 / D-14: per-fold metric next to its mean and population std across folds."""
    g = list(groups)
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    return (per_fold.withColumn(f"{metric}_mean", F.avg(metric).over(w))
                    .withColumn(f"{metric}_std", F.stddev_pop(metric).over(w))
                    .withColumn(f"{metric}_vs_mean", F.col(metric) - F.col(f"{metric}_mean")))
