"""Weight of Evidence and Information Value (E-01 .. E-05, K-03, J-04).

Fit: all categorical columns are unpivoted once to (column, category) and
counted in **one** grouped aggregate; per-column totals (events, rows,
number of categories) come from a second tiny aggregate over that result.
With smoothing s and k categories in a column:

    de  = (events + s) / (E + s k)         dn = (nonevents + s) / (N + s k)
    woe = ln(de / dn)                      iv = sum over categories (de - dn) woe

A missing category is the string ``__MISSING__`` (same grouping as the
reference's string conversion). Unseen categories transform to 0.0.

Fold-safe fit (E-05): per (column, category, fold) counts in the same single
pass; the map used for fold f is built from totals minus fold f, so no row
is encoded with statistics that include its own label.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.joins import bounded_broadcast
from riskflow.session import cut_lineage

MISSING = "__MISSING__"
MAP_CATEGORIES, MAP_BYTES = 256, 1 << 16        # of a column whose map is a value of the plan, not a table to join
# IV strength bands of the reference report (E-03).
IV_BANDS = [(0.02, "Unpredictive"), (0.10, "Weak"), (0.30, "Medium"), (0.50, "Strong")]
IV_TOP = "Suspicious"


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _stack(df: DataFrame, label: str, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("category")) for c in cols])
    return (df.select(F.col(label).cast("long").alias("_y"), *extra, F.explode(pairs).alias("_kv"))
              .select("_y", *extra, "_kv.column", "_kv.category"))


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """F-09: string columns of the schema (dtype-class predicate)."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]


def _finish_map(counts: DataFrame, keys: Sequence[str], smoothing: float, bound: int | None = None) -> DataFrame:
    """counts: (*keys, category, events, total) -> + woe, iv_part using per-keys totals."""
    stats = counts.groupBy(*keys).agg(F.sum("events").alias("E"), F.sum("total").alias("T"),
                                      F.count(F.lit(1)).alias("k"))
    s = F.lit(float(smoothing))
    de = (F.col("events") + s) / (F.col("E") + s * F.col("k"))
    dn = (F.col("total") - F.col("events") + s) / (F.col("T") - F.col("E") + s * F.col("k"))
    # stats: one row per column (per fold and column for E-05) - bounded by construction.
    return (counts.join(bounded_broadcast(stats, bound), list(keys), "inner")
                  .withColumn("de", de).withColumn("dn", dn)
                  .withColumn("woe", F.ln(F.col("de") / F.col("dn")))
                  .withColumn("iv", (F.col("de") - F.col("dn")) * F.col("woe"))
                  .drop("E", "T", "k", "de", "dn"))


def woe_fit(df: DataFrame, label: str, cols: Sequence[str], smoothing: float = 0.5) -> DataFrame:
    """E-01 / E-02: map table (column, category, events, total, woe, iv) where iv is the category's share."""
    st = _stack(df, label, cols)
    counts = st.groupBy("column", "category").agg(F.sum("_y").alias("events"), F.count(F.lit(1)).alias("total"))
    return _finish_map(counts, ["column"], smoothing, bound=len(cols))


def information_value(woe_map: DataFrame) -> DataFrame:
    """E-02 / E-03 / K-03: IV per column with its strength band, ranked by IV."""
    iv = woe_map.groupBy("column").agg(F.sum("iv").alias("iv"))
    band = None
    for cut, name in IV_BANDS:
        band = F.when(F.col("iv") < cut, F.lit(name)) if band is None else band.when(F.col("iv") < cut, F.lit(name))
    w = Window.orderBy(F.col("iv").desc(), F.col("column"))  # one row per column
    return iv.withColumn("strength", band.otherwise(F.lit(IV_TOP))).withColumn("iv_rank", F.row_number().over(w))


def woe_transform(df: DataFrame, woe_map: DataFrame, cols: Sequence[str], suffix: str = "_WOE") -> DataFrame:
    """E-04 / J-04: add ``<col>_WOE`` for each column; unseen categories get 0.0 (N14)."""
    return _apply_map(df, woe_map, cols, [], suffix)


def _apply_map(df: DataFrame, woe_map: DataFrame, cols: Sequence[str], keys: Sequence[str], suffix: str) -> DataFrame:
    """The map (one row per category) is written once, so fitting it is not planned again for every column.

    Columns of few and short categories (checked: ``MAP_CATEGORIES`` and ``MAP_BYTES`` for each key) are encoded in one
    projection, by a map for each column (and fold) that is a constant of the plan: no join. The others are joined with their slice."""
    woe_map = cut_lineage(woe_map.filter(F.col("column").isin(list(cols))).select(*keys, "column", "category", "woe"))
    size = woe_map.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("category") + 8).alias("b"))
    size = {r["column"]: (r.n, r.b) for r in size.groupBy("column").agg(F.max("n").alias("n"), F.sum("b").alias("b")).collect()}
    small = [c for c in cols if c not in size or size[c][0] <= MAP_CATEGORIES and size[c][1] <= MAP_BYTES]
    out = df
    if small:
        tables: dict = {c: {} for c in small}                    # at most MAP_BYTES of categories a column
        for r in woe_map.filter(F.col("column").isin(small)).collect():
            at = tables[r["column"]]
            for k in keys:
                at = at.setdefault(str(r[k]), {})
            at[r["category"]] = r["woe"]
        kind = "map<string,double>"
        for _ in keys:
            kind = f"map<string,{kind}>"

        def encoded(c: str) -> Column:
            m = F.from_json(F.lit(json.dumps(tables[c])), kind)  # a constant of the plan
            for k in keys:
                m = F.try_element_at(m, F.col(k).cast("string"))
            return F.coalesce(F.try_element_at(m, _category(c)), F.lit(0.0))

        out = out.withColumns({f"{c}{suffix}": encoded(c) for c in small})
    for c in cols:
        if c in small:
            continue
        m = woe_map.filter(F.col("column") == c).select(
            *keys, F.col("category").alias(f"_cat_{c}"), F.col("woe").alias(f"{c}{suffix}"))
        out = (out.withColumn(f"_cat_{c}", _category(c))
                  .join(bounded_broadcast(m), [*keys, f"_cat_{c}"], "left")
                  .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(0.0)))
                  .drop(f"_cat_{c}"))
    return out


def woe_fit_oof(df: DataFrame, label: str, cols: Sequence[str], fold: str = "fold", k: int = 5,
                smoothing: float = 0.5) -> DataFrame:
    """E-05: maps (fold, column, category, woe) fitted on all folds but ``fold``."""
    st = _stack(df, label, cols, [fold])
    per_fold = st.groupBy("column", "category", fold).agg(F.sum("_y").alias("ev"), F.count(F.lit(1)).alias("tot"))
    allc = per_fold.groupBy("column", "category").agg(F.sum("ev").alias("ev_all"), F.sum("tot").alias("tot_all"))
    grid = allc.select("column", "category", "ev_all", "tot_all",
                       F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
    oof = (grid.join(per_fold, ["column", "category", fold], "left")
               .select(fold, "column", "category",
                       (F.col("ev_all") - F.coalesce("ev", F.lit(0))).alias("events"),
                       (F.col("tot_all") - F.coalesce("tot", F.lit(0))).alias("total"))
               .filter(F.col("total") > 0))
    return _finish_map(oof, [fold, "column"], smoothing, bound=k * len(cols))


def woe_transform_oof(df: DataFrame, oof_map: DataFrame, cols: Sequence[str], fold: str = "fold",
                      suffix: str = "_WOE") -> DataFrame:
    """E-05 transform: each row is encoded with the map of its own fold (unseen -> 0.0)."""
    return _apply_map(df, oof_map, cols, [fold], suffix)


# ------------------------------------------------------------------ Spark ML wrappers

from pyspark import keyword_only  # noqa: E402
from pyspark.ml import Estimator, Model  # noqa: E402
from pyspark.ml.param import Param, Params, TypeConverters  # noqa: E402


class _WoEParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "categorical columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label column", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "additive smoothing", TypeConverters.toFloat)
    suffix = Param(Params._dummy(), "suffix", "output column suffix", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", smoothing=0.5, suffix="_WOE")


class WoEEncoder(Estimator, _WoEParams):
    """E-01 .. E-04 as a Spark ML estimator, so WoE can sit in a ``Pipeline``."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", smoothing=0.5, suffix="_WOE"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "WoEModel":
        cols = self.getOrDefault(self.inputCols)
        m = woe_fit(dataset, self.getOrDefault(self.labelCol), cols, self.getOrDefault(self.smoothing))
        model = WoEModel(m, cols, self.getOrDefault(self.suffix))
        return self._copyValues(model)


class WoEModel(Model, _WoEParams):
    """Fitted WoE map; ``transform`` adds ``<col>_WOE`` (unseen categories -> 0.0)."""

    def __init__(self, woe_map: DataFrame | None = None, cols: Sequence[str] = (), suffix: str = "_WOE"):
        super().__init__()
        self.woe_map = woe_map
        self._cols = list(cols)
        self._suffix = suffix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return woe_transform(dataset, self.woe_map, self._cols, self._suffix)

    def information_value(self) -> DataFrame:
        return information_value(self.woe_map)
