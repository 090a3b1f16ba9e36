"""Shapley values of trees against the sum over all subsets, and reason codes within the row."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow.operators import attribution as A
from riskflow.operators import boost as B
from riskflow.operators import train as TR
from tests.test_boost import FEATURES, table


def known(tree, goes_left, features, node=0):
    """Answer of a tree for one row of which ``features`` are known; elsewhere the mean of both sides by their cover."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in features:
        return known(tree, goes_left, features, left if goes_left[node] else right)
    share = tree["cover"][left] / tree["cover"][node]
    return share * known(tree, goes_left, features, left) + (1 - share) * known(tree, goes_left, features, right)


def all_subsets(tree, goes_left, m):
    phi = np.zeros(m)
    for j in range(m):
        others = [k for k in range(m) if k != j]
        for size in range(m):
            for s in combinations(others, size):
                w = factorial(size) * factorial(m - 1 - size) / factorial(m)
                phi[j] += w * (known(tree, goes_left, {*s, j}) - known(tree, goes_left, set(s)))
    return phi


def random_tree(rng, m, depth):
    t = {k: [] for k in ("feature", "left", "right", "value", "cover")}

    def add(d, cover):
        v = len(t["feature"])
        for k, x in (("feature", -1), ("left", -1), ("right", -1), ("value", float(rng.normal())), ("cover", float(cover))):
            t[k].append(x)
        if d < depth and cover > 1 and rng.random() < 0.85:
            part = int(rng.integers(1, cover))
            t["feature"][v] = int(rng.integers(0, m))
            t["left"][v] = add(d + 1, part)
            t["right"][v] = add(d + 1, cover - part)
        return v

    add(0, 1000)
    return {k: np.asarray(x) for k, x in t.items()}


@pytest.mark.parametrize("seed", range(12))
def test_shapley_values_are_the_mean_over_all_subsets(seed):
    rng = np.random.default_rng(seed)
    m = 6
    tree = random_tree(rng, m, 6)          # features repeat on paths
    rows = rng.random((9, len(tree["feature"]))) < 0.5
    got = A.shapley(rows, A.leaf_paths(tree), m)
    for r, row in enumerate(rows):
        assert got[r] == pytest.approx(all_subsets(tree, row, m), abs=1e-12)
        assert got[r].sum() == pytest.approx(known(tree, row, set(range(m))) - known(tree, row, set()), abs=1e-12)


def test_boosted_members_add_up_to_their_margin(spark):
    df, _ = table(spark)
    model = B.fit(df, B.BoostSpec("s", 5, 0.3, None, 9, min_child_rows=3), FEATURES, "id", "label")
    got = A.shapley_attributions(df, model, FEATURES, ["id"], rows_at_once=50)
    both = got.join(B.score(df, [model], ["id"], ["p"]), "id").collect()
    assert len(both) == df.count()
    for r in both:
        assert 1 / (1 + np.exp(-r.margin)) == pytest.approx(r.p, abs=1e-12)
        assert r.base + r.phi_a + r.phi_b + r.phi_c == pytest.approx(r.margin, abs=1e-12)
    labelled = [r.margin for r in got.join(df.filter("label IS NOT NULL"), "id").collect()]
    assert np.mean(labelled) == pytest.approx(both[0].base, abs=1e-9)        # the mean over the training rows

    filled = df.filter("label IS NOT NULL").fillna(-999.0)
    gbt = TR.fit(filled, TR.ModelSpec("gbt", "gbt", {"maxIter": 4, "maxDepth": 3}, -999.0), FEATURES, "label", balanced=False)
    raw = gbt.transform(filled).select("id", vector_to_array("rawPrediction")[1].alias("raw"))
    worst = A.shapley_attributions(filled, gbt, FEATURES, ["id"]).join(raw, "id").agg(F.max(F.abs(F.col("margin") - F.col("raw")))).first()[0]
    assert worst < 1e-9


def test_reasons_within_the_row_are_those_of_the_long_table(spark):
    wide = spark.createDataFrame([(1, 0.5, -0.7, 0.1), (2, 0.0, 0.2, -0.2), (3, 1.0, 1.0, 1.0)], "id long, phi_a double, phi_b_c double, phi_d double")
    names = ["a", "b_c", "d"]
    said = {"d": "the last one"}
    one = wide.select("id", TR.top_reasons(A.contributions(names), 2, said).alias("top_risk_factors"))
    two = TR.reason_codes(A.to_long(wide, names, ["id"]), ["id"], 2, said)
    assert sorted(one.collect()) == sorted(two.collect())
    first = one.filter("id = 1").first().top_risk_factors
    assert [(x.feature, x.direction, x.description) for x in first] == [("b_c", "decreases_risk", "B C"), ("a", "increases_risk", "A")]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
