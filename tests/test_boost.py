"""Boosted trees against an exhaustive search, and what holds of them however the rows lie."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import boost as B

FEATURES = ["a", "b", "c"]


def table(spark, n=180, seed=1, folds=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (round(float(x), 2) for x in rng.random(3))
        y = int(a + 0.5 * b + rng.random() * 0.6 > 1.0)
        rows.append((i, y, None if i % 7 == 0 else a, b if i % 11 else float("nan"), c, i % folds))
    rows += [(n, None, 0.5, 0.5, 0.5, 0), (n + 1, None, None, None, None, 1)]          # without a label: never fitted
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double, fold int"), [r for r in rows if r[1] is not None]


def exhaustive_tree(rows, spec):
    """(value of each row) of the first tree: every cut of every leaf is tried on the raw values, best leaf first."""
    x = [[v if v is not None and not math.isnan(v) else None for v in r[2:5]] for r in rows]
    g, h = [0.5 - r[1] for r in rows], [0.25] * len(rows)

    def score(own):
        gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
        return max(abs(gs) - spec.alpha, 0) ** 2 / (hs + spec.lam)

    def cut(own):
        best = (1e-9, None)
        for f in range(3):
            for v in sorted({x[i][f] for i in own if x[i][f] is not None}):
                for missing_left in (False, True):
                    left = [i for i in own if (missing_left if x[i][f] is None else x[i][f] <= v)]
                    right = [i for i in own if i not in set(left)]
                    if min(len(left), len(right)) < max(spec.min_child_rows, 1) or min(sum(h[i] for i in s) for s in (left, right)) < spec.min_child_weight:
                        continue
                    gain = score(left) + score(right) - score(own)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        return best

    leaves = [(list(range(len(rows))), 0)]
    done = []
    while leaves and (spec.max_leaves is None or len(leaves) + len(done) < spec.max_leaves):
        found = [(cut(own) if spec.max_depth is None or d < spec.max_depth else (0, None), k) for k, (own, d) in enumerate(leaves)]
        (gain, parts), k = max(found, key=lambda r: r[0][0])
        if parts is None:
            break
        _, d = leaves.pop(k)
        leaves += [(p, d + 1) for p in parts]
    values = [0.0] * len(rows)
    for own, _ in leaves + done:
        gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
        for i in own:
            values[i] = -spec.learning_rate * math.copysign(max(abs(gs) - spec.alpha, 0), gs) / (hs + spec.lam)
    return values


@pytest.mark.parametrize("spec", [
    B.BoostSpec("depth", 1, 0.3, 3, None, lam=1.0), B.BoostSpec("leaves", 1, 0.3, None, 7, lam=0.5, alpha=0.2, min_child_rows=6),
    B.BoostSpec("weight", 1, 1.0, 4, 5, lam=2.0, min_child_weight=3.0)])
def test_one_tree_is_that_of_the_exhaustive_search(spark, spec):
    df, rows = table(spark)
    fitted = B.fit(df, spec, FEATURES, "id", "label")
    got = {r.id: r.p for r in B.score(df, [fitted], ["id"], ["p"]).collect()}
    for row, value in zip(rows, exhaustive_tree(rows, spec), strict=True):
        assert got[row[0]] == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-9)
    assert len(got) == len(rows) + 2
    tree = fitted.trees[0]
    assert tree.cover[0] == len(rows) and all(tree.cover[v] == tree.cover[tree.left[v]] + tree.cover[tree.right[v]]
                                              for v in range(len(tree.feature)) if tree.feature[v] >= 0)


def test_boosting_ends_by_the_held_out_fold(spark):
    # The label is one cut of ``a``: the first tree ranks the held-out fold without a fault, so it alone is kept.
    rows = [(i, int(i % 10 >= 5), float(i % 10), float(i % 3), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, fold int")
    spec = B.BoostSpec("known", 200, 0.1, 3, patience=7)
    oof, fitted = B.cross_validate(df, spec, ["a", "b"], "id", "label", "fold", 4)
    assert [len(m.trees) for m in fitted] == [1] * 4 and [len(m.history) for m in fitted] == [8] * 4
    assert all(m.best_auc == 1.0 for m in fitted)
    assert oof.count() == 400 and oof.filter("(prob > 0.5) = (label = 1)").count() == 400


def test_the_kept_trees_are_those_of_the_best_round(spark):
    df, rows = table(spark, 240, 5)
    spec = B.BoostSpec("noisy", 40, 0.3, 3, subsample=0.8, colsample_tree=0.7, colsample_level=0.7, patience=6)
    oof, fitted = B.cross_validate(df, spec, FEATURES, "id", "label", "fold", 3)
    for m in fitted:
        assert len(m.trees) == int(np.argmax(m.history)) + 1
        assert len(m.history) == 40 or len(m.history) == len(m.trees) + 6
    scored = B.score(df, fitted, ["id", "fold", "label"], ["p0", "p1", "p2"]).collect()
    want = {r.id: r[f"p{r.fold}"] for r in scored if r.label is not None}
    got = {r.id: r.prob for r in oof.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_models_do_not_depend_on_company_or_partitions(spark, monkeypatch):
    df, _ = table(spark, 150, 9)
    a = B.BoostSpec("a", 9, 0.3, 3, subsample=0.7, seed=3)
    b = B.BoostSpec("b", 5, 0.2, None, 6, min_child_rows=4, seed=4)
    edges = B.bin_edges(df, FEATURES)
    rows = B.binned(df.repartition(5), FEATURES, edges, "id", "label", "fold")
    together = B.fit_many(rows, FEATURES, edges, [(a, 0), (b, 1), (a, None)])
    monkeypatch.setattr(B, "REFRESH", 3)
    monkeypatch.setattr(B, "PASS_BYTES", 1)
    alone = [B.fit_many(B.binned(df.coalesce(1), FEATURES, edges, "id", "label", "fold"), FEATURES, edges, [job])[0]
             for job in [(a, 0), (b, 1), (a, None)]]
    for x, y in zip(together, alone, strict=True):
        assert len(x.trees) == len(y.trees) and x.history == pytest.approx(y.history)
        for t, u in zip(x.trees, y.trees, strict=True):
            assert (t.feature, t.cut, t.missing_left) == (u.feature, u.cut, u.missing_left) and t.value == pytest.approx(u.value)


def test_search_means_over_folds(spark):
    df, _ = table(spark, 200, 2)
    specs = [B.BoostSpec(f"t{i}", 8, 0.3, d, patience=4, seed=i) for i, d in enumerate([1, 2, 4])]
    trials, best = B.search(df, specs, FEATURES, "id", "label", "fold", 3)
    trials = trials.collect()
    assert [t.trial for t in trials] == [0, 1, 2] and all(len(t.fold_auc) == 3 and t.mean_auc == pytest.approx(sum(t.fold_auc) / 3) for t in trials)
    assert best.name == max(trials, key=lambda t: t.mean_auc).name
    assert trials[2].params["max_depth"] == "4"


def test_weights_and_json_and_importances(spark):
    df, rows = table(spark)
    edges = B.bin_edges(df, FEATURES)
    binned = B.binned(df, FEATURES, edges, "id", "label", "fold")
    pos = sum(r[1] for r in rows if r[5] != 1)
    neg = sum(1 - r[1] for r in rows if r[5] != 1)
    got = B._class_weights(binned, [(replace(B.BOOST_A), 1), (B.BOOST_B, 1)])
    assert got == [(1.0, float(neg // pos)), ((neg + pos) / (2 * neg), (neg + pos) / (2 * pos))]
    m = B.fit(df, B.BoostSpec("x", 3, 0.3, 2), FEATURES, "id", "label")
    again = B.Ensemble.from_json(m.to_json())
    one, two = ([r.p for r in B.score(df, [x], ["id"], ["p"]).orderBy("id").collect()] for x in (m, again))
    assert one == two and sum(m.importances().values()) == pytest.approx(1.0)


def test_empty_and_one_class_tables(spark):
    df, _ = table(spark)
    for rows in (df.limit(0), df.filter("label = 1"), df.withColumn("label", F.lit(None).cast("int"))):
        m = B.fit(rows, B.BoostSpec("none", 2), FEATURES, "id", "label")
        assert all(r.p >= 0.5 for r in B.score(df, [m], ["id"], ["p"]).collect())


def test_a_stage_resumes_where_it_ended(spark, tmp_path, monkeypatch):
    df, _ = table(spark, 200, 8, folds=5)
    spec = B.BoostSpec("staged", 6, 0.3, 2)
    whole, fitted = B.cross_validate(df, spec, FEATURES, "id", "label", "fold", 5)
    real, calls = B.fit_many, []

    def ends_after_two(rows, features, edges, jobs):
        calls.append([held for _, held in jobs])
        if len(calls) == 3:
            raise RuntimeError("the run ends here")
        return real(rows, features, edges, jobs)

    monkeypatch.setattr(B, "fit_many", ends_after_two)
    args = (df, spec, FEATURES, "id", "label", str(tmp_path))
    with pytest.raises(RuntimeError):
        B.cross_validate_stage(*args, at_once=1)
    oof, models, now = B.cross_validate_stage(*args)
    assert calls == [[0], [1], [2], [2, 3, 4]] and now == [2, 3, 4]
    assert sorted(map(tuple, oof.collect())) == sorted(map(tuple, whole.collect()))
    assert [m.trees for m in models] == [m.trees for m in fitted]
    assert B.cross_validate_stage(*args)[2] == []
    # Another specification, other rows, or a slice that lost a file are not taken for finished.
    assert B.cross_validate_stage(df, replace(spec, n_trees=2), *args[2:])[2] == [0, 1, 2, 3, 4]
    assert B.cross_validate_stage(df.filter("id <> 3"), *args[1:])[2] == [0, 1, 2, 3, 4]
    from riskflow.operators import stages
    kept = stages.read_manifest(spark, str(tmp_path)).filter("slice = 4").orderBy("finished").first()
    for f in __import__("glob").glob(f"{kept.path}/part-*"):
        __import__("os").truncate(f, 0)
    spark.catalog.clearCache()
    with pytest.raises(Exception):  # noqa: B017  a damaged file is an error, not an absent slice
        B.cross_validate_stage(*args)


def test_a_slice_that_is_gone_is_fitted_again(spark, tmp_path):
    from riskflow.operators import stages
    made = []

    def compute(slices):
        made.append(list(slices))
        for s in slices:
            yield s, spark.range(s + 1), f"note {s}"

    out, notes, now = stages.run_slices(spark, str(tmp_path), "x", "k" * 20, [0, 1, 2], compute, 1)
    assert (out.count(), notes[2], now) == (6, "note 2", [0, 1, 2])
    path = stages.read_manifest(spark, str(tmp_path)).filter("slice = 1").first().path
    spark.range(9).write.mode("overwrite").parquet(path)          # not the rows that the manifest says
    assert stages.run_slices(spark, str(tmp_path), "x", "k" * 20, [0, 1, 2], compute)[2] == [1]
    assert stages.run_slices(spark, str(tmp_path), "x", "other-hash-of-a-spec", [0], compute)[2] == [0]
    assert made == [[0], [1], [2], [1], [0]]
