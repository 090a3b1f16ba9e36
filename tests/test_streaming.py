"""Scoring stream with saved members and drift windows: parity, restart, one read of the source, open windows and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow.operators import boost as B
from riskflow.operators import serving as SV
from riskflow.operators import train as TR
from riskflow.operators import validate as V
from riskflow.streaming import stream as S
from tests.test_boost import FEATURES, table

RULES = [V.required("a"), V.between("c", 0.0, 0.9)]
SCHEMA = "id long, label int, a double, b double, c double, fold int"


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    df, _ = table(spark)
    known = df.filter("label IS NOT NULL")
    linear = TR.fit(SV.filled(known, FEATURES, -1.0), TR.ModelSpec("l", "logistic", {"C": 1.0, "maxIter": 20}), SV.pipeline_inputs(FEATURES), "label")
    trees = B.fit(known, B.BoostSpec("t", 4, 0.3, 3), FEATURES, "id", "label")
    third = B.fit(known, B.BoostSpec("u", 1, 0.3, 1), FEATURES, "id", "label")
    serving = SV.Serving(FEATURES, {"linear": linear, "trees": trees, "third": third}, {"linear": 0.4, "trees": 0.6, "third": 0.005},
                         {"linear": -1.0, "trees": 0.0, "third": 0.0})
    root = SV.save(spark, str(tmp_path_factory.mktemp("serving")), serving)
    return serving, SV.load(spark, root)


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_saved_members_blend_as_the_fitted_ones(spark, model):
    df, _ = table(spark, seed=4)
    one, two = ({r.id: r for r in m.score(df).collect()} for m in model)
    assert one.keys() == two.keys() and "prob_third" not in one[0].asDict()
    for k, r in one.items():
        assert r.default_probability == pytest.approx(0.4 * r.prob_linear + 0.6 * r.prob_trees)
        assert two[k].default_probability == pytest.approx(r.default_probability, abs=1e-12)
    assert set(model[0].score(df).columns) == {*df.columns, "prob_linear", "prob_trees", "default_probability"}


def test_stream_scores_as_batch_and_goes_on_after_a_restart(spark, model, tmp_path):
    df, _ = table(spark, 120, seed=6)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [df.filter(F.col("id") % 3 == k).coalesce(1) for k in range(3)]
    for p in parts[:2]:
        p.write.mode("append").parquet(source)
    args = {"rules": RULES, "root": root, "score": model[1].score, "scores": ("default_probability", "prob_linear", "prob_trees")}
    first = S.score_stream(spark, stream_of(spark, source), lambda d: d, **args)
    assert first.input_rows == sum(p.count() for p in parts[:2])          # each row read once, for both kinds of rows
    assert first.read(spark).count() == first.input_rows
    parts[2].write.mode("append").parquet(source)
    second = S.score_stream(spark, stream_of(spark, source), lambda d: d, **args)
    assert second.input_rows == parts[2].count()                           # only what had not been read
    rows = second.read(spark).collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in df.collect())
    batch = {r.id: r for r in V.with_violations(model[1].score(df), RULES).collect()}
    for r in rows:
        assert r.is_valid == batch[r.id].is_valid and r.violations == ",".join(batch[r.id].violations)
        assert (r.default_probability is None) != r.is_valid
        if r.is_valid:
            assert r.default_probability == pytest.approx(batch[r.id].default_probability, abs=1e-12)
    assert {r.id for r in second.valid(spark).collect()} | {r.id for r in second.quarantine(spark).collect()} == set(batch)
    third = S.score_stream(spark, stream_of(spark, source), lambda d: d, **args)
    assert third.input_rows == 0 and third.read(spark).count() == len(rows)


def test_windows_hold_each_row_once_open_or_late(spark, tmp_path):
    day = dt.datetime(2024, 3, 1)
    rows = [(day + dt.timedelta(hours=h), float(h % 10)) for h in range(72)]
    late = [(day + dt.timedelta(hours=1, minutes=m), 1.0) for m in range(5)] + [(day + dt.timedelta(hours=71), 2.0)]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp_ntz, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    edges = [float(x) for x in range(11)]
    band = F.when(F.col("value") < 5, "low").otherwise("high")
    S.drift_stream(spark, stream(), "value", "ts", edges, root=root, band=band)
    counts = S.window_counts(spark, root)
    totals = S.window_totals(counts, 72).first()
    assert (totals.window_rows, totals.late_rows, totals.open_windows) == (72, 0, 1)
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    S.drift_stream(spark, stream(), "value", "ts", edges, root=root, band=band)
    counts = S.window_counts(spark, root)
    totals = S.window_totals(counts, 78).first()
    assert (totals.input_rows, totals.window_rows, totals.late_rows, totals.open_windows) == (78, 73, 5, 1)
    per = {(r.window_start.day, r.band): (r.n, r.is_open) for r in S.band_counts(counts).collect()}
    assert {d for d, _ in per} == {1, 2, 3} and sum(n for n, _ in per.values()) == 73
    assert [is_open for (d, _), (_, is_open) in sorted(per.items())] == [False] * 4 + [True] * 2
    base = spark.createDataFrame(rows, schema)
    psi = S.window_psi(counts, base, "value", edges).collect()
    assert sorted(r.total for r in psi) == [24, 24, 25] and all(r.psi < 0.2 for r in psi)
