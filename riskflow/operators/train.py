"""Model training as Spark ML jobs (M-01 .. M-13, D-12).

* k-fold cross-validation with an out-of-fold table ``(id, label, fold, model, prob)``:
  a driver loop over k folds, each fit and transform a distributed Spark ML job.
* Logistic regression equivalent to the reference's L2 / C / balanced setup:
  standardize, then ``regParam = 1 / (C * sum(weights))`` with ``standardization=False``.
* The published boosted members and the search over folds are ``riskflow.operators.boost``; MLlib trees serve as the
  random forest and as a plain boosted member (missing values are filled with a constant first).
* Random hyper-parameter search from seeded draws.
* Linear attributions ``coef * (x - mean)`` (exact additive contributions of a
  linear margin) as columns; reason codes are the top-5 by absolute value.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.folds import with_weight_column
from riskflow.operators.metrics import rank_metrics

FEATURES = "_features"


@dataclass
class ModelSpec:
    name: str
    kind: str  # logistic | gbt | forest
    params: dict = field(default_factory=dict)
    fill: float = 0.0  # P-40 constant fill before the model


# Reference configurations (the boosted members are in ``boost``).
LOGISTIC = ModelSpec("logistic_baseline", "logistic", {"C": 0.1, "maxIter": 500}, 0.0)
FOREST_C = ModelSpec("forest", "forest", {"numTrees": 300, "maxDepth": 6}, -999.0)


def _estimator(spec: ModelSpec, label: str, weight: str | None, total_weight: float | None):
    p = dict(spec.params)
    weighted = {"weightCol": weight} if weight else {}
    if spec.kind == "logistic":
        c = p.pop("C", 1.0)
        reg = 1.0 / (c * total_weight) if total_weight else 0.0
        scaler = StandardScaler(inputCol=FEATURES, outputCol="_scaled", withMean=True, withStd=True)
        lr = LogisticRegression(featuresCol="_scaled", labelCol=label, regParam=reg, **weighted,
                                elasticNetParam=0.0, standardization=False, maxIter=int(p.get("maxIter", 100)))
        return [scaler, lr]
    if spec.kind == "gbt":
        kw = {k: v for k, v in p.items() if k in {"maxIter", "maxDepth", "stepSize", "subsamplingRate",
                                                 "featureSubsetStrategy", "maxBins", "minInstancesPerNode", "validationIndicatorCol", "validationTol"}}
        return [GBTClassifier(featuresCol=FEATURES, labelCol=label, seed=p.get("seed", 42), **weighted, **kw)]
    if spec.kind == "forest":
        kw = {k: v for k, v in p.items() if k in {"numTrees", "maxDepth", "featureSubsetStrategy", "subsamplingRate",
                                                 "maxBins", "minInstancesPerNode"}}
        return [RandomForestClassifier(featuresCol=FEATURES, labelCol=label, seed=p.get("seed", 42), **weighted, **kw)]
    raise ValueError(spec.kind)


def pipeline(spec: ModelSpec, features: Sequence[str], label: str, weight: str | None = None,
             total_weight: float | None = None) -> Pipeline:
    va = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")
    return Pipeline(stages=[va, *_estimator(spec, label, weight, total_weight)])


def _prepare(df: DataFrame, features: Sequence[str], label: str, spec: ModelSpec) -> DataFrame:
    d = df.withColumn(label, F.col(label).cast("double"))
    return d.fillna(spec.fill, subset=list(features))


def positive_prob(df: DataFrame, out: str = "prob") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def fit(df: DataFrame, spec: ModelSpec, features: Sequence[str], label: str, balanced: bool = True) -> PipelineModel:
    """M-10: fit on all given rows."""
    d = _prepare(df, features, label, spec)
    weight, total = None, None
    if balanced:
        d = with_weight_column(d, label, "_w")
        weight = "_w"
        total = d.agg(F.sum("_w")).collect()[0][0] if spec.kind == "logistic" else None
    return pipeline(spec, features, label, weight, total).fit(d)


def score(model: PipelineModel, df: DataFrame, spec: ModelSpec, features: Sequence[str], keep: Sequence[str],
          out: str = "prob") -> DataFrame:
    d = df.fillna(spec.fill, subset=list(features))
    return positive_prob(model.transform(d), out).select(*keep, out)


def cross_validate(df: DataFrame, spec: ModelSpec, features: Sequence[str], id_col: str, label: str,
                   fold: str = "fold", k: int = 5, balanced: bool = True,
                   materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """M-06: OOF table and per-fold metrics. Each fold's rows are scored by the model fitted
    on the other folds; the OOF table is the union of the k scored slices.

    The training columns are first written as a reliable checkpoint in the shared folder
    (``materialize``), so the k fits and every optimizer pass read that instead of
    re-running the feature plan."""
    if materialize:
        from riskflow.session import cut_lineage
        df = cut_lineage(df.select(id_col, label, fold, *[c for c in features if c not in (id_col, label, fold)]))
    parts = []
    for i in range(k):
        train = df.filter(F.col(fold) != i)
        valid = df.filter(F.col(fold) == i)
        m = fit(train, spec, features, label, balanced)
        parts.append(score(m, valid, spec, features, [id_col, label, fold]).withColumn("model", F.lit(spec.name)))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = oof.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"),
                     "model", "prob")
    per_fold = rank_metrics(oof, "label", "prob", ["model", "fold"])
    return oof, per_fold


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """M-11: (feature, importance) from a tree model, or |coefficient| for the linear model."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(float(x)) for x in last.coefficients.toArray()]
    return spark.createDataFrame(list(zip(list(features), [float(v) for v in vals])), "feature string, importance double")


def random_search(space: Mapping[str, Callable[[random.Random], object]], n_trials: int, seed: int = 42) -> list[dict]:
    """M-07: seeded random draws from the given ranges (the Bayesian sampler is not rebuilt)."""
    rnd = random.Random(seed)
    return [{k: draw(rnd) for k, draw in space.items()} for _ in range(n_trials)]


def linear_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """M-13 (linear member): per-row contributions coef_j * z_j on the standardized inputs,
    which sum with the intercept to the margin; returned as (keep..., feature, contribution)."""
    scaler, lr = model.stages[1], model.stages[2]
    coef = lr.coefficients.toArray().tolist()
    t = model.transform(df).withColumn("_z", vector_to_array("_scaled"))
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("_z")[i] * F.lit(float(coef[i]))).alias("contribution"))
                    for i, f in enumerate(features)])
    del scaler
    return t.select(*keep, F.explode(arr).alias("x")).select(*keep, "x.feature", "x.contribution")


def linear_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The same as one array<feature, contribution> a row (column ``contributions``): nothing is exploded."""
    coef = model.stages[2].coefficients.toArray().tolist()
    t = model.transform(df).withColumn("_z", vector_to_array("_scaled"))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("_z")[i] * F.lit(float(coef[i]))).alias("contribution"))
                      for i, f in enumerate(features)])
    return t.select(*keep, items.alias("contributions"))


def _reason(feature, contribution, descriptions: Mapping[str, str] | None):
    """One contribution as (size, feature, value, direction, description)."""
    plain = F.initcap(F.regexp_replace(feature, "_", " "))
    if descriptions:
        plain = F.coalesce(F.create_map(*[F.lit(x) for kv in descriptions.items() for x in kv])[feature], plain)
    return F.struct(F.abs(contribution).alias("_a"), feature.alias("feature"), contribution.alias("shap_value"),
                    F.when(contribution > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk")).alias("direction"),
                    plain.alias("description"))


def top_reasons(items, n: int = 5, descriptions: Mapping[str, str] | None = None):
    """S-05 / W-05: the n contributions of the largest size of an array<feature, contribution>, within the row."""
    scored = F.transform(items, lambda x: _reason(x["feature"], x["contribution"], descriptions))
    return F.transform(F.slice(F.sort_array(scored, asc=False), 1, n), lambda s: s.dropFields("_a"))


def reason_codes(contrib: DataFrame, keys: Sequence[str], n: int = 5,
                 descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """S-05 / W-05 for a long table (keys..., feature, contribution): grouped by the keys, one ``array<struct>`` each.
    Where the contributions of a row are still together, ``top_reasons`` needs no grouping."""
    items = F.collect_list(F.struct("feature", "contribution")).alias("_items")
    return contrib.groupBy(*keys).agg(items).select(*keys, top_reasons(F.col("_items"), n, descriptions).alias("top_risk_factors"))


def save_model(model: PipelineModel, path: str) -> str:
    """IO-10: persist a fitted pipeline (Spark ML writer, shared folder)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """IO-10: restore a fitted pipeline."""
    return PipelineModel.load(path)


def oof_or_run(spark: SparkSession, path: str, run: Callable[[], DataFrame]) -> DataFrame:
    """M-12: resume - reuse a stored OOF table when present, otherwise run the stage and store it."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # absent table: run the stage
        run().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
