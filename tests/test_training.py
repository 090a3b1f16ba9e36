"""Training, attribution and streaming properties (small inputs)."""

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow.operators import attribution, folds, train


def _data(spark, n=300):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        a, b = rnd.random(), rnd.random()
        y = 1 if a + 0.3 * b + rnd.random() * 0.5 > 0.9 else 0
        rows.append((i, y, a, b if i % 9 else None))
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    return folds.stratified_folds(df, "id", "label", k=3)


def test_oof_covers_every_row_once(spark):
    d = _data(spark)
    oof, per = train.cross_validate(d, train.ModelSpec("lr", "logistic", {"C": 1.0, "maxIter": 50}), ["a", "b"],
                                    "id", "label", "fold", 3)
    assert oof.count() == 300 and oof.select("id").distinct().count() == 300
    assert all(0.0 <= r.auc_roc <= 1.0 for r in per.collect())


def test_tree_attributions_add_up_to_margin(spark):
    d = _data(spark)
    spec = train.ModelSpec("gbt", "gbt", {"maxIter": 5, "maxDepth": 3}, -999.0)
    model = train.fit(d, spec, ["a", "b"], "label")
    att = attribution.tree_attributions(d, model, ["a", "b"], ["id"], fill=-999.0)
    raw = model.transform(d.fillna(-999.0, subset=["a", "b"])).select(
        "id", vector_to_array("rawPrediction")[1].alias("raw"))
    j = att.join(raw, "id")
    worst = j.select(F.max(F.abs(F.col("margin") - F.col("raw"))).alias("e")).collect()[0].e
    assert worst < 1e-9
    s = j.select(F.max(F.abs(F.col("base") + F.col("phi_a") + F.col("phi_b") - F.col("margin"))).alias("e")).collect()[0].e
    assert s < 1e-9
