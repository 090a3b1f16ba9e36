"""Streaming query keys (T-01, T-02): run to completion with ``availableNow`` and read the sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from riskflow.operators import boost as B
from riskflow.operators import decide as D
from riskflow.operators import features as FE
from riskflow.operators import serving as SV
from riskflow.operators import train as TR
from riskflow.operators import validate as V
from riskflow.plans import analogues as an
from riskflow.plans.decision_queries import _PROB, _RULES_SQL
from riskflow.plans.registry import finish, register, rounded_all
from riskflow.session import cut_lineage, spread
from riskflow.sources.io import unique_path
from riskflow.streaming import stream as S

_VIOL = ", ".join(f"CASE WHEN coalesce({p}, false) THEN '{n}' END" for n, p in _RULES_SQL)


def _score_transform(df):
    app = df.selectExpr(*[f"{s} AS {n}" for n, s, _ in an.APPLICATION[1]]).drop("NAME_CONTRACT_TYPE")
    return D.risk_band(app.withColumn("default_probability", F.expr(_PROB)))


@register("stream_score", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION}),
v AS (SELECT *, concat_ws(',', {_VIOL}) AS violations, {_PROB} AS p FROM a)
SELECT SK_ID_CURR, p AS default_probability,
  CASE WHEN p < 0.10 THEN 'Low Risk' WHEN p < 0.25 THEN 'Medium Risk' WHEN p < 0.50 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_label,
  CAST(trunc((1 - p) * 1000) AS INT) AS risk_score,
  CASE WHEN p < 0.10 THEN 'Approve' WHEN p < 0.25 THEN 'Approve with conditions' WHEN p < 0.50 THEN 'Manual review required'
       ELSE 'Decline' END AS recommended_action
FROM v WHERE violations = ''""", ["SK_ID_CURR", "risk_label", "risk_score", "recommended_action"]))
def stream_score(spark, sf_dir):
    """T-01: file stream of applicant records -> rules -> score -> band; valid rows land in the
    scored table (batch parity with ``risk_bands``), invalid rows in quarantine with reasons."""
    src = S.file_stream(spark, sf_dir, "customer")
    scored = S.score_stream(spark, src, _score_transform, V.application_contract())
    out = scored.valid(spark).select("SK_ID_CURR", "default_probability", "risk_label", "risk_score",
                                            "recommended_action")
    return finish(out)


@register("stream_counters", f"""WITH a AS ({an.SQL_APPLICATION}),
v AS (SELECT concat_ws(',', {_VIOL}) AS violations FROM a)
SELECT count(*) AS input_rows, count(*) FILTER (WHERE violations = '') AS scored_rows,
  count(*) FILTER (WHERE violations <> '') AS quarantined_rows FROM v""")
def stream_counters(spark, sf_dir):
    """S-07: request counters of the scoring stream - rows that the source gave (by the query's own progress), rows
    scored and rows quarantined."""
    src = S.file_stream(spark, sf_dir, "customer")
    scored = S.score_stream(spark, src, _score_transform, V.application_contract())
    return scored.read(spark).agg(F.lit(scored.input_rows).cast("long").alias("input_rows"), F.count_if("is_valid").alias("scored_rows"),
                                  F.count_if(~F.col("is_valid")).alias("quarantined_rows"))


def served_model(spark, sf_dir):
    """Fit both members on the applications' own features (P-01 .. P-27), save them, and load them back. The boosted one has
    all trees as published: it is fitted on all rows, so there is no fold to stop it by."""
    train = FE.application_features(an.application(spark, sf_dir).withColumn("TARGET", F.expr("CASE WHEN EXT_SOURCE_1 IS NULL THEN 1 ELSE 0 END")))
    features = [c for c, t in train.dtypes if t in ("int", "bigint", "double") and c not in ("SK_ID_CURR", "TARGET", "EXT_SOURCE_1")]
    train = spread(cut_lineage(train.select("SK_ID_CURR", "TARGET", *features)))
    fill = TR.LOGISTIC.fill
    linear = TR.fit(SV.filled(train, features, fill), TR.LOGISTIC, SV.pipeline_inputs(features), "TARGET")
    trees = B.fit(train, replace(B.BOOST_A, patience=None), features, "SK_ID_CURR", "TARGET")
    serving = SV.Serving(features, {"linear": linear, "boosted": trees}, {"linear": 0.45, "boosted": 0.55}, {"linear": fill, "boosted": 0.0})
    return SV.load(spark, SV.save(spark, unique_path(spark, "serving"), serving))


def _request_features(df):
    return FE.application_features(df.selectExpr(*[f"{s} AS {n}" for n, s, _ in an.APPLICATION[1]]).drop("NAME_CONTRACT_TYPE", "TARGET"))


@register("stream_model_score")
def stream_model_score(spark, sf_dir):
    """T-01 / S-01: saved members applied to a stream of applications after the P-expressions: one pass that routes valid
    and invalid rows; each streamed probability stands beside that of a batch run of the same members."""
    model = served_model(spark, sf_dir)
    stream = S.score_stream(spark, S.file_stream(spark, sf_dir, "customer"), _request_features, V.application_contract(),
                            score=model.score, scores=("default_probability", "prob_linear", "prob_boosted"))
    batch = model.score(_request_features(spark.read.parquet(f"{sf_dir}/customer.parquet"))).select(
        "SK_ID_CURR", F.col("default_probability").alias("batch_probability"))
    out = D.risk_band(stream.read(spark)).join(batch, "SK_ID_CURR")
    return finish(out.select("SK_ID_CURR", "is_valid", "violations", "default_probability", "risk_label", "risk_score", "recommended_action",
                             F.when(F.col("is_valid"), F.col("batch_probability")).alias("batch_probability")))


_SPLIT = "2024-01-16 00:00:00"
_LEVELS = ", ".join(f"CAST({q!r} AS DOUBLE)" for q in [i / 10 for i in range(11)])


# Probability analogue of an event, for its risk band.
_EVENT_PROB = "value / (value + 100)"
_EVENT_BAND = (f"CASE WHEN {_EVENT_PROB} < 0.10 THEN 'Low Risk' WHEN {_EVENT_PROB} < 0.25 THEN 'Medium Risk' "
               f"WHEN {_EVENT_PROB} < 0.50 THEN 'High Risk' ELSE 'Very High Risk' END")


@register("stream_drift", rounded_all(f"""
WITH base AS (SELECT value FROM events WHERE ts < TIMESTAMP '{_SPLIT}'),
e AS (SELECT quantile_cont(value, [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]) AS edges FROM base),
bb AS (SELECT CASE WHEN value >= edges[1] AND value <= edges[11] THEN len(list_filter(edges[1:10], lambda v: v <= value)) - 1 END AS bin
       FROM base, e),
es AS (SELECT bin, count(*)::DOUBLE / (SELECT count(*) FROM bb) AS e_share FROM bb WHERE bin IS NOT NULL GROUP BY bin),
lv AS (SELECT date_trunc('day', ts) AS ws,
         CASE WHEN value >= edges[1] AND value <= edges[11] THEN len(list_filter(edges[1:10], lambda v: v <= value)) - 1 END AS bin
       FROM events, e),
t AS (SELECT ws, count(*) AS total FROM lv GROUP BY ws),
c AS (SELECT ws, bin, count(*) AS n FROM lv WHERE bin IS NOT NULL GROUP BY ws, bin),
d AS (SELECT t.ws, t.total, r.bin FROM t, range(10) AS r(bin)),
sh AS (SELECT d.ws, d.total, greatest(coalesce(c.n::DOUBLE / d.total, 0), 1e-4) AS a, greatest(coalesce(es.e_share, 0), 1e-4) AS e
       FROM d LEFT JOIN c ON c.ws = d.ws AND c.bin = d.bin LEFT JOIN es ON es.bin = d.bin),
p AS (SELECT ws, max(total) AS total, sum((e - a) * ln(e / a)) AS psi FROM sh GROUP BY ws)
SELECT strftime(ws, '%Y-%m-%d') AS window_start, psi, total,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'critical' END AS status,
  ws + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS is_open
FROM p""", ["window_start", "total", "status", "is_open"]))
def stream_drift(spark, sf_dir):
    """T-02: event stream with a 1-hour watermark, daily tumbling windows of value counts per baseline PSI bin, PSI per
    window against the first half of the month; windows still open at the end of the input are marked."""
    baseline, edges, root = _drift(spark, sf_dir)
    psi = S.window_psi(S.window_counts(spark, root), baseline, "value", edges)
    return finish(psi.select(S.utc_day("window_start").alias("window_start"), "psi", "total", "status", "is_open"))


def _drift(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    baseline = events.filter(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"))
    edges = S.baseline_edges(baseline, "value")
    return baseline, edges, S.drift_stream(spark, S.file_stream(spark, sf_dir, "events"), "value", "ts", edges, band=F.expr(_EVENT_BAND))


@register("stream_band_counts", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, {_EVENT_BAND} AS band,
  date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS is_open, count(*) AS n
FROM events GROUP BY ALL""")
def stream_band_counts(spark, sf_dir):
    """T-02: rows of each daily window by risk band, from the counts of the same stream."""
    _, _, root = _drift(spark, sf_dir)
    return S.band_counts(S.window_counts(spark, root)).select(S.utc_day("window_start").alias("window_start"), "band", "is_open", "n")


@register("stream_window_totals", """SELECT count(*) AS input_rows, count(*) AS window_rows,
  count(DISTINCT date_trunc('day', ts)) FILTER (date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
  AS open_windows, 0::BIGINT AS late_rows FROM events""")
def stream_window_totals(spark, sf_dir):
    """T-02: every input row is in one window or late: rows read, rows in windows, windows still open, late rows."""
    _, _, root = _drift(spark, sf_dir)
    return S.window_totals(S.window_counts(spark, root), spark.read.parquet(f"{sf_dir}/events.parquet").count())
