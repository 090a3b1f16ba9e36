"""Training, scoring and attribution query keys (M-02 .. M-15, S-01 .. S-05, D-12, K-01, K-02, W-05).

Rows-only keys (no SQL oracle): model fitting is iterative. Properties are
covered in tests (OOF covers every labelled row once, folds disjoint, AUC in
[0, 1], attributions sum to the margin).
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.operators import attribution as AT
from riskflow.operators import boost as B
from riskflow.operators import calibration as C
from riskflow.operators import folds as FO
from riskflow.operators import train as TR
from riskflow.operators import woe as W
from riskflow.plans.registry import finish, register
from riskflow.session import checkpoint_dir, cut_lineage, spread
from riskflow.sources.tables import read_table

K, SEED = 5, 42
CATS = ["lang", "source"]
FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "quality", "lang_WOE", "source_WOE"]

FOREST_KEY = TR.ModelSpec("forest", "forest", {"numTrees": 50, "maxDepth": 6}, -999.0)


def _text_features(df):
    t = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({
        "n_words": F.size(F.split(t, " ")).cast("double"),
        "n_lines": F.size(F.split(t, "\n")).cast("double"),
        "digit_share": F.length(F.regexp_replace(t, "[^0-9]", "")) / F.greatest(F.length(t), F.lit(1)),
    })


def _labelled_documents(spark, sf_dir):
    """The text features are taken before the join, so that no text is shuffled."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source",
                                                        F.col("n_chars").cast("double").alias("n_chars"))
    d = lab.filter("label IS NOT NULL").join(_text_features(doc).drop("text"), "doc_id", "inner")
    return d.select(*lab.columns, "lang", "source", "n_chars", "n_words", "n_lines", "digit_share")


def labelled(spark, sf_dir):
    """Labelled documents with text features, stratified folds and fold-safe WoE (E-05); rows without a label
    cannot be fitted and are left out here, not by the folds.

    Materialized once by a reliable checkpoint in the shared folder: every fold fit
    and every optimizer iteration then starts from the checkpoint, not the full plan, on all cores."""
    d = cut_lineage(_labelled_documents(spark, sf_dir))         # folds read all its columns more than once
    d = FO.stratified_folds(d, "doc_id", "label", K, SEED)
    m = W.woe_fit_oof(d, "label", CATS, "fold", K)
    out = W.woe_transform_oof(d, m, CATS, "fold").withColumn("quality", F.col("quality").cast("double"))
    return spread(cut_lineage(out))


def _oof(spark, sf_dir, spec):
    oof, _ = TR.cross_validate(labelled(spark, sf_dir), spec, FEATURES, "doc_id", "label", "fold", K)
    return finish(oof)


@register("train_logistic_oof")
def train_logistic_oof(spark, sf_dir):
    """M-02 + M-06: standardized L2 logistic regression (C = 0.1, balanced), 5-fold OOF table."""
    return _oof(spark, sf_dir, TR.LOGISTIC)


def _boosted(spark, sf_dir, spec, d=None):
    """Labelled rows, OOF table and fold models of a boosted member, as a stage in the shared folder: a key that needs a
    member which another key of the session has fitted from the same rows reads it."""
    d = labelled(spark, sf_dir) if d is None else d
    oof, models, _ = B.cross_validate_stage(d, spec, FEATURES, "doc_id", "label", f"{checkpoint_dir(spark)}/riskflow/stages", "fold", K)
    return d, oof, models


@register("train_gbt_oof")
def train_gbt_oof(spark, sf_dir):
    """M-03 + M-06: boosted trees as published (1500 x depth 6, shrinkage 0.02, row and column subsamples, positives weighed
    by the class ratio), each fold stopped by its held-out rows after 100 trees without a better AUC; OOF table."""
    return finish(_boosted(spark, sf_dir, B.BOOST_A)[1])


@register("train_leafwise_oof")
def train_leafwise_oof(spark, sf_dir):
    """M-04 + M-06: best-first trees as published (2000 x 63 leaves, 30 rows a leaf, balanced), stopped likewise; OOF table."""
    return finish(_boosted(spark, sf_dir, B.BOOST_B)[1])


@register("boosted_runs")
def boosted_runs(spark, sf_dir):
    """IO-11 / M-03: the run log of the first boosted member, a run a fold: trees kept, rounds and AUC, read back."""
    from riskflow.sources import io
    _, _, models = _boosted(spark, sf_dir, B.BOOST_A)
    path = io.unique_path(spark, "boosted-runs")
    rows = spark.createDataFrame(B.runs(models), io.RUNS_SCHEMA.rsplit(", ", 1)[0])
    io.append_runs(rows.withColumn("ts", F.current_timestamp()), path)
    log = spark.read.parquet(path)
    return finish(log.select("run_id", "name", F.col("tags")["fold"].cast("int").alias("fold"), F.col("metrics")["n_trees"].cast("int").alias("n_trees"),
                             F.col("metrics")["n_rounds"].cast("int").alias("n_rounds"), F.col("metrics")["auc_roc"].alias("auc_roc")))


@register("train_forest_oof")
def train_forest_oof(spark, sf_dir):
    """M-05 + M-06: random forest (300 trees) as the third, diverse member, OOF table."""
    return _oof(spark, sf_dir, TR.FOREST_C)


@register("fold_metrics")
def fold_metrics(spark, sf_dir):
    """V-20 / A-77: per-fold AUC, AP, Brier of the logistic member with mean and population std."""
    _, per = TR.cross_validate(labelled(spark, sf_dir), TR.LOGISTIC, FEATURES, "doc_id", "label", "fold", K)
    return finish(FO.fold_stability(per.select("model", "fold", "auc_roc", "auc_pr", "brier"), "auc_roc", groups=["model"]))


# The published ranges of the search.
SEARCH = {"n_trees": lambda r: r.randint(200, 500), "max_depth": lambda r: r.randint(4, 8),
          "learning_rate": lambda r: 10 ** r.uniform(math.log10(0.005), math.log10(0.05)),
          "subsample": lambda r: r.uniform(0.6, 1.0), "colsample_tree": lambda r: r.uniform(0.5, 1.0),
          "min_child_weight": lambda r: float(r.randint(10, 60)), "alpha": lambda r: r.uniform(0.0, 1.0), "lam": lambda r: r.uniform(0.5, 3.0)}
TRIALS, SEARCH_FOLDS, SEARCH_PATIENCE = 25, 3, 50


@register("tune_random")
def tune_random(spark, sf_dir):
    """M-07: 25 seeded draws from the published ranges, each fitted on three folds with early stopping, all 75 models side
    by side; the mean AUC over the folds decides (rank 1 is the best)."""
    d = FO.stratified_folds(labelled(spark, sf_dir).drop("fold"), "doc_id", "label", SEARCH_FOLDS, SEED)
    draws = TR.random_search(SEARCH, TRIALS, SEED)
    specs = [B.BoostSpec(f"trial_{i}", weights="scale", patience=SEARCH_PATIENCE, **p) for i, p in enumerate(draws)]
    trials, _ = B.search(d, specs, FEATURES, "doc_id", "label", "fold", SEARCH_FOLDS)
    rank = F.row_number().over(Window.orderBy(F.desc("mean_auc"), "trial"))        # a row a trial
    return finish(trials.select("trial", rank.alias("rank"), *[F.col("params")[k].cast("double").alias(k) for k in SEARCH],
                                *[F.col("fold_auc")[i].alias(f"auc_{i}") for i in range(SEARCH_FOLDS)],
                                F.aggregate("trees", F.lit(0), lambda a, x: a + x).alias("trees_kept"), "mean_auc"))


def _test_documents(spark, sf_dir, d):
    """Test rows: all documents, encoded with the map fitted on every labelled row (E-04)."""
    m = W.woe_fit(d, "label", CATS)
    test = _text_features(read_table(spark, sf_dir, "documents").withColumn("n_chars", F.col("n_chars").cast("double")))
    q = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return W.woe_transform(test, m, CATS).join(q, "doc_id", "left")


#: The stored blend of the published model (members A, B, C); members of a weight up to 0.01 are skipped.
BLEND = (0.55, 0.45, 0.0)


@register("final_submission")
def final_submission(spark, sf_dir):
    """M-10: both boosted members refitted on all labelled rows, with as many trees as their folds kept on average, and
    blended by the stored weights over every document; the submission keeps the true id. (The third member has weight 0.)"""
    d, specs = labelled(spark, sf_dir), []
    for spec in (B.BOOST_A, B.BOOST_B):
        folds = _boosted(spark, sf_dir, spec, d)[2]
        specs.append(replace(spec, patience=None, n_trees=max(1, round(sum(len(m.trees) for m in folds) / K))))
    names = [s.name for s in specs]
    scored = B.score(_test_documents(spark, sf_dir, d), B.fit_all(d, specs, FEATURES, "doc_id", "label"), ["doc_id"], names)
    return finish(scored.select("doc_id", sum(F.lit(w) * F.col(n) for w, n in zip(BLEND, names)).alias("TARGET")))


@register("importances")
def importances(spark, sf_dir):
    """M-11 / K-01: gain importances of the first boosted member, mean over its fold models, top 30."""
    models = _boosted(spark, sf_dir, B.BOOST_A)[2]
    shares = [m.importances() for m in models]
    rows = [(f, sum(s[f] for s in shares) / len(shares)) for f in FEATURES]
    return finish(spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(30))


@register("calibrate_scores")
def calibrate_scores(spark, sf_dir):
    """M-14: isotonic calibration of the logistic OOF probabilities (Spark ML isotonic regression)."""
    oof, _ = TR.cross_validate(labelled(spark, sf_dir), TR.LOGISTIC, FEATURES, "doc_id", "label", "fold", K)
    return finish(C.isotonic_calibration(oof, "label", "prob", "prob_calibrated").select("id", "label", "prob", "prob_calibrated"))


@register("calibrate_sigmoid")
def calibrate_sigmoid(spark, sf_dir):
    """M-14: sigmoid calibration of the logistic OOF scores on their log odds."""
    oof, _ = TR.cross_validate(labelled(spark, sf_dir), TR.LOGISTIC, FEATURES, "doc_id", "label", "fold", K)
    p = F.least(F.greatest("prob", F.lit(1e-15)), F.lit(1 - 1e-15))
    return finish(C.platt_scaling(oof.withColumn("margin", F.ln(p / (1 - p))), "label", "margin", "prob_calibrated").select(
        "id", "label", "prob", "prob_calibrated"))


def _linear(spark, sf_dir):
    d = labelled(spark, sf_dir)
    model = TR.fit(d, TR.LOGISTIC, FEATURES, "label")
    return TR.linear_contributions(model, d.fillna(0.0, subset=FEATURES), FEATURES, ["doc_id"])


@register("attributions")
def attributions(spark, sf_dir):
    """M-13 / K-02: mean |contribution| per feature of the linear member, top 10."""
    c = _linear(spark, sf_dir).select(F.explode("contributions").alias("c")).select("c.*")
    out = c.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return finish(out.orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(10))


@register("reason_codes")
def reason_codes(spark, sf_dir):
    """S-05 / W-05: top-5 signed contributions per document with direction and description, within the row."""
    return _linear(spark, sf_dir).select("doc_id", TR.top_reasons(F.col("contributions")).alias("top_risk_factors"))


@register("raw_baseline")
def raw_baseline(spark, sf_dir):
    """D-12: raw-feature baseline - 5-fold AUC of a forest on raw numerics, with mean and population std."""
    raw = ["n_chars", "n_words", "n_lines", "digit_share", "quality"]
    _, per = TR.cross_validate(labelled(spark, sf_dir), FOREST_KEY, raw, "doc_id", "label", "fold", K)
    return finish(FO.fold_stability(per.select("model", "fold", "auc_roc"), "auc_roc", groups=["model"]))


@register("model_persist")
def model_persist(spark, sf_dir):
    """IO-10: fit, save the pipeline to the shared folder, load it back and score with the restored model."""
    from riskflow.sources import io
    d = labelled(spark, sf_dir)
    path = TR.save_model(TR.fit(d, TR.LOGISTIC, FEATURES, "label"), io.unique_path(spark, "model"))
    return finish(TR.score(TR.load_model(path), d, TR.LOGISTIC, FEATURES, ["doc_id", "label"]))


@register("oof_resume")
def oof_resume(spark, sf_dir):
    """M-12: a stage output (OOF table) is computed once and reused on the second request."""
    from riskflow.sources import io
    path = io.unique_path(spark, "oof-resume")

    def run():
        return TR.cross_validate(labelled(spark, sf_dir), TR.LOGISTIC, FEATURES, "doc_id", "label", "fold", K)[0]
    TR.oof_or_run(spark, path, run)            # first call: runs the stage and stores it
    return finish(TR.oof_or_run(spark, path, run))  # second call: resumes from the stored table


@register("psi_oof_test")
def psi_oof_test(spark, sf_dir):
    """X-04 (like-for-like): PSI of the test-set scores against the training OOF scores of the same model."""
    from riskflow.operators import stability as ST
    d = labelled(spark, sf_dir)
    oof, _ = TR.cross_validate(d, TR.LOGISTIC, FEATURES, "doc_id", "label", "fold", K, materialize=False)
    test = TR.score(TR.fit(d, TR.LOGISTIC, FEATURES, "label"), _test_documents(spark, sf_dir, d), TR.LOGISTIC, FEATURES, ["doc_id"])
    return finish(ST.psi(oof.select("prob"), test.select("prob"), "prob"))


def _tree_attr(spark, sf_dir):
    """Shapley values of the best fold model of the first boosted member, over all labelled documents."""
    d, _, models = _boosted(spark, sf_dir, B.BOOST_A)
    return AT.shapley_attributions(d, max(models, key=lambda m: (m.best_auc, -m.held_out)), FEATURES, ["doc_id"])


@register("tree_attributions")
def tree_attributions(spark, sf_dir):
    """M-13 / K-02 (boosted member): mean |Shapley value| per feature, top 10; with the base value they add up to the margin."""
    long = AT.to_long(_tree_attr(spark, sf_dir), FEATURES, ["doc_id"])
    return finish(AT.mean_abs(long).orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(10))


@register("tree_reason_codes")
def tree_reason_codes(spark, sf_dir):
    """S-05 (boosted member): top-5 signed Shapley values per document with direction and description, within the row."""
    return _tree_attr(spark, sf_dir).select("doc_id", TR.top_reasons(AT.contributions(FEATURES)).alias("top_risk_factors"))


@register("score_responses")
def score_responses(spark, sf_dir):
    """S-01 .. S-06: response records for every labelled document - score of the fitted logistic
    member, band, score, action, top-5 reason codes and a reproducible prediction id."""
    from riskflow.operators import decide as D
    d = labelled(spark, sf_dir)
    model = TR.fit(d, TR.LOGISTIC, FEATURES, "label")
    scored = TR.score(model, d, TR.LOGISTIC, FEATURES, ["doc_id"], "default_probability")
    reasons = TR.linear_contributions(model, d.fillna(0.0, subset=FEATURES), FEATURES, ["doc_id"]).select(
        "doc_id", TR.top_reasons(F.col("contributions")).alias("top_risk_factors"))
    out = D.respond(scored.join(reasons, "doc_id", "left"), "default_probability", "top_risk_factors", "doc_id")
    return out.select("doc_id", "default_probability", "risk_label", "risk_score", "recommended_action",
                      "top_risk_factors", "model_version", "prediction_id", "is_fallback")
