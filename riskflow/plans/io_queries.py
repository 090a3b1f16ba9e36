"""Source / sink and schema query keys (IO-01 .. IO-15, K-09, SET-01 .. SET-03)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from riskflow.operators import features as FE
from riskflow.operators import folds as FO
from riskflow.operators import metrics as M
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all
from riskflow.sources import io
from riskflow.sources.tables import read_table

_TARGET = ["AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "bureau_total_loans", "cc_dpd_ever_flag", "DAYS_BIRTH"]


@register("align_columns", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT SK_ID_CURR, coalesce(AMT_CREDIT, 0) AS AMT_CREDIT, coalesce(AMT_ANNUITY, 0) AS AMT_ANNUITY,
  coalesce(EXT_SOURCE_1, 0) AS EXT_SOURCE_1, 0 AS bureau_total_loans, 0 AS cc_dpd_ever_flag, DAYS_BIRTH FROM a""",
    ["SK_ID_CURR", "bureau_total_loans", "cc_dpd_ever_flag", "DAYS_BIRTH"]))
def align_columns(spark, sf_dir):
    """IO-14 / SET-01: align to a training column list (absent -> 0, reordered), then fill missing with 0."""
    app = an.application(spark, sf_dir)
    out = FE.align_columns(app, _TARGET, fill=0, keep=["SK_ID_CURR"])
    return finish(FE.constant_fill(out, 0))


@register("narrow_types", """
WITH s AS (SELECT count(*) AS n, min(c_custkey) AS k0, max(c_custkey) AS k1, min(c_nationkey) AS n0, max(c_nationkey) AS n1,
             count(DISTINCT c_name) AS d_name, count(DISTINCT c_mktsegment) AS d_seg FROM customer)
SELECT * FROM (
  SELECT 'c_custkey' AS "column", 'bigint' AS source_type,
    CASE WHEN k0 >= -128 AND k1 <= 127 THEN 'tinyint' WHEN k0 >= -32768 AND k1 <= 32767 THEN 'smallint'
         WHEN k0 >= -2147483648 AND k1 <= 2147483647 THEN 'int' ELSE 'bigint' END AS target_type, false AS is_dictionary FROM s
  UNION ALL SELECT 'c_name', 'string', 'string', d_name::DOUBLE / n < 0.05 FROM s
  UNION ALL SELECT 'c_nationkey', 'int',
    CASE WHEN n0 >= -128 AND n1 <= 127 THEN 'tinyint' WHEN n0 >= -32768 AND n1 <= 32767 THEN 'smallint' ELSE 'int' END, false FROM s
  UNION ALL SELECT 'c_acctbal', 'double', 'float', false FROM s
  UNION ALL SELECT 'c_mktsegment', 'string', 'string', d_seg::DOUBLE / n < 0.05 FROM s) AS q""")
def narrow_types(spark, sf_dir):
    """IO-03: planned narrow type per column from one min/max/approximate-distinct pass."""
    return io.narrowing_plan(read_table(spark, sf_dir, "customer"))


@register("sample_seeded", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 5000""")
def sample_seeded(spark, sf_dir):
    """K-09: reproducible sample of min(5000, n) rows without replacement (hash order, seed 42).
    The limit is the feature; Spark plans it as a distributed top-k (TakeOrderedAndProject)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(FO.fold_hash("o_orderkey", 42)).limit(5000)


@register("union_scored", rounded_all(f"""WITH s AS ({an.SQL_SCORED})
SELECT doc_id, 'non_default' AS population, 0 AS label, m_len AS score FROM s WHERE label = 0
UNION ALL SELECT doc_id, 'default', 1, m_len FROM s WHERE label = 1""", ["doc_id", "population", "label"]))
def union_scored(spark, sf_dir):
    """SET-02: two score populations concatenated with their class labels (unionByName)."""
    s = an.scored(spark, sf_dir)
    good = s.filter("label = 0").select("doc_id", F.lit("non_default").alias("population"), F.lit(0).alias("label"),
                                        F.col("m_len").alias("score"))
    bad = s.filter("label = 1").select("doc_id", F.lit("default").alias("population"), F.lit(1).alias("label"),
                                       F.col("m_len").alias("score"))
    return finish(good.unionByName(bad))


_RT_COLS = ["SK_ID_CURR", "AGE_YEARS", "CREDIT_TO_INCOME", "EXT_SOURCE_MEAN", "TOTAL_CONTACT_FLAGS"]


@register("io_roundtrip", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT SK_ID_CURR, -DAYS_BIRTH / 365.25 AS AGE_YEARS, AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0) AS CREDIT_TO_INCOME,
  CASE WHEN (EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT > 0
       THEN (0.0 + coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0))
            / ((EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT) END AS EXT_SOURCE_MEAN,
  FLAG_MOBIL + FLAG_EMP_PHONE + FLAG_WORK_PHONE + FLAG_CONT_MOBILE + FLAG_PHONE + FLAG_EMAIL AS TOTAL_CONTACT_FLAGS
FROM a""", ["SK_ID_CURR", "TOTAL_CONTACT_FLAGS"]))
def io_roundtrip(spark, sf_dir):
    """IO-05 / IO-06 / IO-01 / IO-04: features written as Parquet and as CSV under the shared
    output folder, the CSV read back with an explicit schema (no inference) and returned."""
    feats = finish(FE.application_features(an.application(spark, sf_dir)).select(*_RT_COLS))
    pq = io.write_parquet(feats, io.unique_path(spark, "features-parquet"))
    csv = io.write_csv(io.read_parquet(spark, pq), io.unique_path(spark, "features-csv"))
    schema = "SK_ID_CURR long, AGE_YEARS double, CREDIT_TO_INCOME double, EXT_SOURCE_MEAN double, TOTAL_CONTACT_FLAGS int"
    return io.read_csv(spark, csv, schema)


@register("oof_store", rounded_all(f"""WITH sl AS ({an.SQL_SCORED_LONG}),
f AS (SELECT doc_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) - 1) % 5 AS INT) AS fold
      FROM ({an.SQL_SCORED}) AS s)
SELECT sl.doc_id AS id, label, fold, model, prob FROM sl JOIN f USING (doc_id)""", ["id", "label", "fold", "model"]))
def oof_store(spark, sf_dir):
    """IO-07: OOF table (id, label, fold, model, prob) written partitioned by model and scanned back."""
    s = FO.stratified_folds(an.scored(spark, sf_dir), "doc_id", "label", 5, 42)
    oof = s.unpivot(["doc_id", "label", "fold"], an.MODELS, "model", "prob").withColumnRenamed("doc_id", "id")
    path = io.write_parquet(oof, io.unique_path(spark, "oof"), ["model"])
    return finish(io.read_parquet(spark, path).select("id", "label", "fold", "model", "prob"))


@register("run_log")
def run_log(spark, sf_dir):
    """IO-11 / M-15: one run per model (params, metrics map, tags) appended to the run log; best run read back."""
    m = M.rank_metrics(an.scored_long(spark, sf_dir), "label", "prob", ["model"])
    runs = m.select(
        F.concat(F.lit("run-"), F.col("model")).alias("run_id"), F.col("model").alias("name"),
        F.create_map(F.lit("model_type"), F.col("model")).alias("tags"),
        F.create_map(F.lit("threshold"), F.lit("0.5")).alias("params"),
        F.create_map(F.lit("auc_roc"), F.col("auc_roc"), F.lit("auc_pr"), F.col("auc_pr"),
                     F.lit("brier"), F.col("brier")).alias("metrics"),
        F.lit(0).alias("step"), F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp").alias("ts"))
    path = io.unique_path(spark, "runs")
    io.append_runs(runs, path)
    return io.best_runs(spark, path, "auc_roc", k=1)


@register("model_registry")
def model_registry(spark, sf_dir):
    """IO-09 / IO-15: registry record (version, threshold, weights, AUC, rows, features) written as JSON
    and read back with defaults for absent fields."""
    best = (M.rank_metrics(an.scored_long(spark, sf_dir), "label", "prob", ["model"])
              .orderBy(F.col("auc_roc").desc(), "model").limit(1).collect()[0])  # one summary row
    rec = {"optimal_threshold": 0.21, "weights": {"m_len": 0.55, "m_mix": 0.45, "m_noise": 0.0},
           "auc": round(best.auc_roc, 6), "n_train_rows": int(best.n_rows), "feature_names": ["m_len", "m_mix", "m_noise"]}
    path = io.write_registry(spark, rec, io.unique_path(spark, "registry"))
    return io.read_registry(spark, path)


@register("contract_check")
def contract_check(spark, sf_dir):
    """IO-13 / SET-03: required-minus-present columns per input table (schema only, no scan)."""
    tables = {"application": an.application(spark, sf_dir), "bureau": an.bureau(spark, sf_dir),
              "previous": an.previous(spark, sf_dir)}
    required = {"application": ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED"],
                "bureau": ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"],
                "previous": ["SK_ID_CURR", "SK_ID_PREV", "NAME_CONTRACT_STATUS"]}
    # Schema check per table, next to the row count of the table it guards (the scan grows with the data).
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), F.lit(missing).alias("missing_columns"),
                                                                "n_rows")
             for (name, missing), df in zip(io.contract_report(tables, required), tables.values())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("parse_records", """SELECT event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, value
FROM events""")
def parse_records(spark, sf_dir):
    """IO-12: JSON request payloads to typed rows (``from_json`` with a fixed schema), each with its position in the input
    (the SQL takes the id, which counts the rows of this table in order)."""
    ev = io.read_sequenced(spark, f"{sf_dir}/events.parquet")
    return io.records_from_json(ev, "props", "k int", "seq", ["event_type", "value"]).select("seq", "event_type", "k", "value")


@register("argmax_risk", rounded_all(f"""WITH sl AS ({an.SQL_SCORED_LONG})
SELECT model, doc_id, prob FROM sl QUALIFY row_number() OVER (PARTITION BY model ORDER BY prob DESC, doc_id) = 1""",
    ["model", "doc_id"]))
def argmax_risk(spark, sf_dir):
    """K-10: the highest-risk row per model (ties to the lowest id), via ``max_by`` on a sortable key."""
    sl = an.scored_long(spark, sf_dir)
    best = sl.groupBy("model").agg(F.max_by(F.struct("doc_id", "prob"),
                                            F.struct(F.col("prob"), -F.col("doc_id"))).alias("b"))
    return finish(best.select("model", "b.doc_id", "b.prob"))


@register("feature_pipeline")
def feature_pipeline(spark, sf_dir):
    """E-06 / IO-05: the whole feature build - application expressions, five history blocks left-joined
    on the applicant key, WoE of the categoricals fitted on the labelled applicants, categoricals
    dropped (id kept) - written as a Parquet table and scanned back."""
    from riskflow.operators import woe as W
    from riskflow.plans.feature_queries import star_features
    feats = star_features(spark, sf_dir)
    cats = ["NAME_CONTRACT_TYPE", "CODE_GENDER"]
    m = W.woe_fit(an.application(spark, sf_dir), "TARGET", cats)      # before any join
    out = FE.drop_if_present(W.woe_transform(feats, m, cats), cats, keep=["SK_ID_CURR"])
    path = io.write_parquet(finish(out), io.unique_path(spark, "features"))
    return io.read_parquet(spark, path)
