"""Boosted models grown by a task of their own, their refit, Shapley tables and the served model."""

import re
from dataclasses import replace

import numpy as np
import pytest

from riskflow.operators import attribution as A
from riskflow.operators import boost as B
from riskflow.plans import stream_queries as Q
from riskflow.plans import train_queries as T
from tests.test_boost import FEATURES, table

SPECS = [B.BoostSpec("depth", 12, 0.3, 4, subsample=0.8, colsample_tree=0.7, colsample_level=0.7, min_child_weight=1.0, alpha=0.1, weights="scale"),
         B.BoostSpec("leaves", 12, 0.3, None, 9, subsample=0.7, min_child_rows=5, weights="balanced", seed=3),
         B.BoostSpec("stopped", 60, 0.3, 3, patience=4, seed=5), B.BoostSpec("both", 6, 0.3, 5, 11, colsample_level=0.5)]


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_rounds_cost_no_jobs(spark):
    df, _ = table(spark, 160, 4)
    edges = B.bin_edges(df, FEATURES)
    rows = B.binned(df, FEATURES, edges, "id", "label", "fold")
    few, many = (jobs_of(spark, f"{spec.name} {n}", lambda s=replace(spec, n_trees=n): B.fit_many(rows, FEATURES, edges, [(s, 0), (s, 1), (s, None)]))
                 for spec, n in ((SPECS[0], 1), (SPECS[1], 25)))
    assert few == many


def test_a_task_grows_the_trees_of_the_passes(spark, monkeypatch):
    df, _ = table(spark, 220, 11)
    edges = B.bin_edges(df, FEATURES)
    rows = B.binned(df.repartition(3), FEATURES, edges, "id", "label", "fold")
    jobs = [(s, held) for s in SPECS for held in (0, None)]
    whole = B.fit_many(rows, FEATURES, edges, jobs)
    monkeypatch.setattr(B, "WHOLE_ROWS", 0)
    passes = B.fit_many(rows, FEATURES, edges, jobs)
    for x, y in zip(whole, passes, strict=True):
        assert x.spec == y.spec and x.held_out == y.held_out and len(x.trees) == len(y.trees) and x.history == pytest.approx(y.history)
        for t, u in zip(x.trees, y.trees, strict=True):
            assert (t.feature, t.cut, t.missing_left, t.left, t.right, t.cover) == (u.feature, u.cut, u.missing_left, u.left, u.right, u.cover)
            assert t.value == pytest.approx(u.value) and t.gain == pytest.approx(u.gain)


@pytest.mark.parametrize("most", [B.WHOLE_ROWS, 0])
def test_a_fold_without_rows_ends(spark, monkeypatch, most):
    monkeypatch.setattr(B, "WHOLE_ROWS", most)
    df, _ = table(spark, 60, 3)
    _, fitted = B.cross_validate(df, B.BoostSpec("few", 3, 0.3, 2, patience=2), FEATURES, "id", "label", "fold", 4)
    assert len(fitted[3].trees) == 3 and fitted[3].history == []          # no row lies in the last fold


def test_trees_answer_as_the_walk(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 12, (500, 3)).astype(np.uint8)
    model = B._Model(0, replace(SPECS[1], n_trees=5), None, (1.0, 1.0), 3)
    B._grow(model, rng.integers(-2**62, 2**62, 500), np.zeros(500, np.int32), rng.integers(0, 2, 500).astype(float), np.ascontiguousarray(codes.T))
    assert len(model.trees) == 5
    for t in (t.arrays() for t in model.trees):
        assert (B._values(t, np.ascontiguousarray(codes.T)) == t["value"][B._walk(t, codes)]).all()


def test_the_submission_prepares_its_rows_once(spark, monkeypatch):
    calls, real = [], T.labelled
    monkeypatch.setattr(T, "labelled", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(B, "BOOST_A", replace(B.BOOST_A, n_trees=3, patience=2, min_child_weight=0.0))
    monkeypatch.setattr(B, "BOOST_B", replace(B.BOOST_B, n_trees=3, patience=2, min_child_rows=1))
    out = T.final_submission(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert out.filter("TARGET > 0 AND TARGET < 1").count() == out.count()


def test_ways_through_a_path_are_worked_out_once(spark, monkeypatch):
    df, _ = table(spark, 300, 6)
    model = B.fit(df, B.BoostSpec("m", 4, 0.3, 3), FEATURES, "id", "label")
    paths = [A.leaf_paths(t.arrays()) for t in model.trees]
    tables = [A.leaf_tables(p) for p in paths]
    assert all(t.shape == (2 ** len(s), len(s)) for p, ts in zip(paths, tables, strict=True) for (_, s), t in zip(p, ts, strict=True))
    goes_left = np.random.default_rng(1).random((1000, max(len(t.feature) for t in model.trees))) < 0.5
    direct = [A.shapley(goes_left, p, 3, [None] * len(p)) for p in paths]
    monkeypatch.setattr(A, "_shares", None)                               # not called again for these rows
    for p, t, want in zip(paths, tables, direct, strict=True):
        assert np.array_equal(A.shapley(goes_left, p, 3, t), want)


def test_long_paths_have_no_table(spark):
    steps = [(f, 0.5, [(f, True)]) for f in range(A.TABLE_STEPS + 1)]
    assert A.leaf_tables([(1.0, steps), (1.0, steps[:2])])[0] is None
    goes_left = np.random.default_rng(1).random((50, len(steps))) < 0.9
    phi = A.shapley(goes_left, [(1.0, steps)], len(steps))
    assert phi.sum(axis=1) == pytest.approx(goes_left.all(axis=1) - 0.5 ** len(steps))


def test_the_served_model_has_all_trees(spark, monkeypatch):
    asked, real = [], B.fit

    def fit(df, spec, *args):
        asked.append((spec, *args[3:]))
        return real(df, replace(spec, n_trees=2), *args[:3])

    monkeypatch.setattr(B, "fit", fit)
    model = Q.served_model(spark, "/root/testdata/sf0.001")
    assert asked == [(replace(B.BOOST_A, patience=None),)] and asked[0][0].n_trees == 1500
    assert set(model.members) == {"linear", "boosted"} and len(model.members["boosted"].trees) == 2


def test_no_text_is_shuffled(spark):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = T._labelled_documents(spark, "/root/testdata/sf0.001")
        plan = d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(shuffled) == 2 and not any(re.search(r"\btext#", x) for x in shuffled) and any("n_words#" in x for x in shuffled)
