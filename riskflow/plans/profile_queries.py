"""Profiling query keys (D-01 .. D-14, A-70 .. A-80, J-03, F-01 .. F-05, K-04, K-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import calibration as C
from riskflow.operators import profile as P
from riskflow.plans import analogues as an
from riskflow.plans.registry import finish, register, rounded_all
from riskflow.sources.tables import read_table


@register("class_balance", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT count(*) AS n_rows, count(*) FILTER (WHERE TARGET = 1) AS n_pos, count(*) FILTER (WHERE TARGET <> 1) AS n_neg,
  (count(*) FILTER (WHERE TARGET = 1))::DOUBLE / count(*) AS pos_rate,
  (count(*) FILTER (WHERE TARGET <> 1))::DOUBLE / nullif(count(*) FILTER (WHERE TARGET = 1), 0) AS imbalance_ratio,
  CAST(trunc((count(*) FILTER (WHERE TARGET <> 1))::DOUBLE / nullif(count(*) FILTER (WHERE TARGET = 1), 0)) AS INT) AS scale_pos_weight,
  {len(an.APPLICATION[1])} AS n_columns
FROM a""", ["n_rows", "n_pos", "n_neg", "scale_pos_weight", "n_columns"]))
def class_balance(spark, sf_dir):
    """A-70 / D-01 / D-13: class balance of the applicant analogue (TARGET = negative balance)."""
    return finish(P.class_balance(an.application(spark, sf_dir), "TARGET"))


_APP_COLS = [c for c, _, _ in an.APPLICATION[1]]


@register("missing_profile", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION}),
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count(*) AS n FROM a" for c in _APP_COLS)})
SELECT feature, missing_count, missing_count * 100.0 / n AS missing_pct,
  row_number() OVER (ORDER BY missing_count * 100.0 / n DESC, feature) AS missing_rank
FROM m WHERE missing_count > 0""", ["feature", "missing_count", "missing_rank"]))
def missing_profile(spark, sf_dir):
    """D-02 / K-04 / F-04: missing count and percent per column in one pass, ranked."""
    out = P.missing_profile(an.application(spark, sf_dir))
    return finish(out.withColumn("missing_pct", F.col("missing_pct").cast("double"))
                     .withColumn("missing_rank", F.col("missing_rank").cast("long")))


_MP_COLS = ["AMT_CREDIT", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
            "OBS_60_CNT_SOCIAL_CIRCLE", "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_WEEK",
            "AMT_REQ_CREDIT_BUREAU_YEAR", "FLAG_DOCUMENT_4"]


@register("missing_patterns", f"""WITH a AS ({an.SQL_APPLICATION})
SELECT concat({", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _MP_COLS)}) AS mask, count(*) AS n
FROM a GROUP BY ALL""")
def missing_patterns(spark, sf_dir):
    """D-03: missing-value co-occurrence patterns over the columns with gaps."""
    return P.missing_patterns(an.application(spark, sf_dir), _MP_COLS)


@register("sentinel_check", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT count(*) FILTER (WHERE DAYS_EMPLOYED = 365243) AS n_sentinel, count(*) AS n_rows,
  (count(*) FILTER (WHERE DAYS_EMPLOYED = 365243)) * 100.0 / count(*) AS sentinel_pct FROM a""", ["n_sentinel", "n_rows"]))
def sentinel_check(spark, sf_dir):
    """D-07: frequency of the employment sentinel."""
    return finish(P.sentinel_frequency(an.application(spark, sf_dir), "DAYS_EMPLOYED", 365243))


@register("hist_by_class", rounded_all(f"""WITH s AS ({an.SQL_SCORED}),
r AS (SELECT min(n_chars::DOUBLE) AS lo, max(n_chars::DOUBLE) AS hi FROM s),
b AS (SELECT label, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / 40)), 39) END AS INT) AS bin
      FROM s, r WHERE n_chars IS NOT NULL),
c AS (SELECT label, bin, lo, hi, count(*) AS n FROM b GROUP BY ALL)
SELECT label, bin, n, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS class_total, lo + bin * ((hi - lo) / 40) AS bin_lo,
  n / (sum(n) OVER (PARTITION BY label) * ((hi - lo) / 40)) AS density
FROM c""", ["label", "bin", "n", "class_total"]))
def hist_by_class(spark, sf_dir):
    """D-04 / V-16: 40-bin equal-width density histogram of document length by class."""
    return finish(C.density_by_class(an.scored(spark, sf_dir), "n_chars", "label", 40))


@register("box_stats", rounded_all(f"""WITH s AS ({an.SQL_SCORED}),
q AS (SELECT label, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS median,
        quantile_cont(n_chars::DOUBLE, 0.75) AS q3 FROM s GROUP BY label)
SELECT label, q1, median, q3, q3 - q1 AS iqr,
  min(n_chars::DOUBLE) FILTER (WHERE n_chars >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
  max(n_chars::DOUBLE) FILTER (WHERE n_chars <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM s JOIN q USING (label) GROUP BY label, q1, median, q3""", ["label", "n_outliers", "n"]))
def box_stats(spark, sf_dir):
    """D-05: box statistics of document length by class."""
    return finish(P.box_stats(an.scored(spark, sf_dir), "n_chars", ["label"]))


_MW_SQL = f"""WITH s AS ({an.SQL_SCORED}),
x AS (SELECT n_chars::DOUBLE AS v, CASE WHEN label = 0 THEN 1 ELSE 0 END AS f FROM s WHERE n_chars IS NOT NULL),
r AS (SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x),
k AS (SELECT sum(rk) FILTER (WHERE f = 1) AS r1, count(*) FILTER (WHERE f = 1)::DOUBLE AS n1,
        count(*) FILTER (WHERE f = 0)::DOUBLE AS n2 FROM r),
t AS (SELECT sum(c * c * c - c) AS tie_term FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v) AS g),
u AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1, n2, tie_term FROM k, t)
SELECT u1, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, tie_term, greatest(u1, n1 * n2 - u1) AS u, n1 * n2 / 2 AS mu,
  sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma,
  (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5)
    / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z
FROM u"""


@register("mann_whitney", rounded_all(_MW_SQL, ["n1", "n2"]))
def mann_whitney(spark, sf_dir):
    """D-06 / W-03: Mann-Whitney U (first sample = class 0) with tie-corrected sigma and z;
    the oracle uses the textbook mid-rank sum."""
    return finish(P.mann_whitney(an.scored(spark, sf_dir), "n_chars", "label"))


@register("mann_whitney_p")
def mann_whitney_p(spark, sf_dir):
    """D-06: two-sided p-value (normal approximation) on the single statistics row."""
    return finish(P.mann_whitney_p(P.mann_whitney(an.scored(spark, sf_dir), "n_chars", "label")))


_NUM = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED",
        "DAYS_REGISTRATION", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "CNT_CHILDREN", "CNT_FAM_MEMBERS",
        "FLAG_MOBIL"]


@register("corr_target", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION}),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN isnan(corr({c}::DOUBLE, TARGET::DOUBLE)) THEN NULL ELSE corr({c}::DOUBLE, TARGET::DOUBLE) END AS corr FROM a" for c in _NUM)})
SELECT feature, corr, abs(corr) AS abs_corr, row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS corr_rank FROM c""",
    ["feature", "corr_rank"]))
def corr_target(spark, sf_dir):
    """D-09 / K-05: Pearson correlation of each numeric with the target, ranked by |r| (constant -> NULL)."""
    out = P.corr_with_target(an.application(spark, sf_dir), _NUM, "TARGET")
    return finish(out.withColumn("corr_rank", F.col("corr_rank").cast("long")))


_CM = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "TARGET"]
_CM_PAIRS = [(a, b) for i, a in enumerate(_CM) for b in _CM[i:]]


@register("corr_matrix", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION}),
h AS ({" UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, CASE WHEN isnan(corr({x}::DOUBLE, {y}::DOUBLE)) THEN NULL ELSE corr({x}::DOUBLE, {y}::DOUBLE) END AS corr FROM a" for x, y in _CM_PAIRS)})
SELECT a, b, corr FROM h UNION ALL SELECT b AS a, a AS b, corr FROM h WHERE a <> b""", ["a", "b"]))
def corr_matrix(spark, sf_dir):
    """D-10: pairwise correlation matrix (NULL-skipping) of key columns and the target."""
    return finish(P.corr_matrix(an.application(spark, sf_dir), _CM))


@register("child_profile", rounded_all(f"""WITH b AS ({an.SQL_BUREAU}), k AS (SELECT SK_ID_CURR, count(*) AS k FROM b GROUP BY ALL)
SELECT sum(k)::BIGINT AS n_rows, count(*) AS n_keys, avg(k) AS rows_per_key_mean, min(k) AS rows_per_key_min,
  max(k) AS rows_per_key_max FROM k""", ["n_rows", "n_keys", "rows_per_key_min", "rows_per_key_max"]))
def child_profile(spark, sf_dir):
    """D-11 / A-71 / A-72: shape, distinct applicants and records per applicant of the bureau analogue."""
    return finish(P.rows_per_key(an.bureau(spark, sf_dir), "SK_ID_CURR"))


@register("rows_per_key", rounded_all("""WITH k AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT sum(k)::BIGINT AS n_rows, count(*) AS n_keys, avg(k) AS rows_per_key_mean, min(k) AS rows_per_key_min,
  max(k) AS rows_per_key_max FROM k""", ["n_rows", "n_keys", "rows_per_key_min", "rows_per_key_max"]))
def rows_per_key(spark, sf_dir):
    """A-72: rows per order in the monthly-balance analogue (lineitem)."""
    return finish(P.rows_per_key(read_table(spark, sf_dir, "lineitem"), "l_orderkey"))


@register("freq_topn", """SELECT NAME_CONTRACT_STATUS, count(*) AS n FROM (""" + an.SQL_PREVIOUS + """) AS p
GROUP BY ALL ORDER BY n DESC, NAME_CONTRACT_STATUS LIMIT 3""")
def freq_topn(spark, sf_dir):
    """A-73: top-3 most frequent previous-application statuses (ties by value)."""
    return P.frequency_top(an.previous(spark, sf_dir), "NAME_CONTRACT_STATUS", 3)


@register("freq_pivot_norm", rounded_all(f"""WITH p AS ({an.SQL_PREVIOUS}), a AS ({an.SQL_APPLICATION}),
j AS (SELECT NAME_CONTRACT_STATUS, TARGET FROM p JOIN a USING (SK_ID_CURR)),
c AS (SELECT NAME_CONTRACT_STATUS, TARGET, count(*) AS n FROM j GROUP BY ALL),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY TARGET) AS share FROM c)
SELECT NAME_CONTRACT_STATUS, max(share) FILTER (WHERE TARGET = 0) AS share_0, max(share) FILTER (WHERE TARGET = 1) AS share_1
FROM s GROUP BY NAME_CONTRACT_STATUS""", ["NAME_CONTRACT_STATUS"]))
def freq_pivot_norm(spark, sf_dir):
    """A-74 + J-03: status shares within each target class, pivoted to one column per class."""
    j = an.previous(spark, sf_dir).join(an.application(spark, sf_dir).select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", "inner")
    return finish(P.normalized_pivot(j, "NAME_CONTRACT_STATUS", "TARGET"))


@register("target_join_profile", rounded_all(f"""WITH b AS ({an.SQL_BUREAU}), a AS ({an.SQL_APPLICATION}),
j AS (SELECT b.*, TARGET FROM b JOIN a USING (SK_ID_CURR))
SELECT TARGET, count(*) AS n, avg(AMT_CREDIT_SUM_OVERDUE) AS overdue_mean,
  avg(least(greatest(AMT_CREDIT_SUM_OVERDUE, 0), 50000)) AS overdue_clipped_mean, avg(DAYS_CREDIT) AS days_credit_mean
FROM j GROUP BY TARGET""", ["TARGET", "n"]))
def target_join_profile(spark, sf_dir):
    """J-03 / F-01 / F-02: bureau records inner-joined to the applicant target, profiled per class."""
    from riskflow.functions import nullsafe as ns
    j = an.bureau(spark, sf_dir).join(an.application(spark, sf_dir).select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", "inner")
    return finish(j.groupBy("TARGET").agg(
        F.count(F.lit(1)).alias("n"), F.avg("AMT_CREDIT_SUM_OVERDUE").alias("overdue_mean"),
        F.avg(ns.clip("AMT_CREDIT_SUM_OVERDUE", 0, 50000)).alias("overdue_clipped_mean"),
        F.avg("DAYS_CREDIT").alias("days_credit_mean")))


@register("rate_by_category", rounded_all(f"""WITH s AS ({an.SQL_SCORED}),
st AS (SELECT 'lang' AS "column", lang AS category, label FROM s UNION ALL SELECT 'source', source, label FROM s)
SELECT "column", category, avg(label::DOUBLE) AS rate, count(*) AS n, avg(label::DOUBLE) * 100 AS rate_pct
FROM st WHERE category IS NOT NULL GROUP BY ALL""", ['"column"', "category", "n"]))
def rate_by_category(spark, sf_dir):
    """A-75 / D-08: toxic rate and n by language and by source in one pass."""
    return finish(P.rate_by_category(an.scored(spark, sf_dir), ["lang", "source"], "label"))


@register("late_rate_by_class", rounded_all(f"""WITH i AS ({an.SQL_INSTALMENTS}), a AS ({an.SQL_APPLICATION}),
per AS (SELECT SK_ID_CURR, avg(CAST(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0, false) AS INT)) AS r FROM i GROUP BY ALL)
SELECT TARGET, count(*) AS n_keys, avg(r) AS mean_late_rate, max(r) AS max_late_rate
FROM per JOIN a USING (SK_ID_CURR) GROUP BY TARGET""", ["TARGET", "n_keys"]))
def late_rate_by_class(spark, sf_dir):
    """A-76: per-applicant late-payment rate (paid after due), joined to the target, per class."""
    return finish(P.late_rate_by_class(an.instalments(spark, sf_dir), an.application(spark, sf_dir),
                                       "SK_ID_CURR", "TARGET"))


@register("percentiles", rounded_all("""SELECT event_type,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max
FROM events GROUP BY event_type""", ["event_type"]))
def percentiles(spark, sf_dir):
    """A-78: exact p50 / p95 / p99 / max of event values per event type."""
    return finish(P.percentiles(read_table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"]))


@register("impute_median_group", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION}),
m AS (SELECT NAME_CONTRACT_TYPE, median(EXT_SOURCE_1) AS med FROM a GROUP BY ALL)
SELECT SK_ID_CURR, coalesce(EXT_SOURCE_1, med) AS EXT_SOURCE_1_IMPUTED,
  CAST(EXT_SOURCE_1 IS NULL AS INT) AS EXT_SOURCE_1_MISSING
FROM a JOIN m USING (NAME_CONTRACT_TYPE)""", ["SK_ID_CURR", "EXT_SOURCE_1_MISSING"]))
def impute_median_group(spark, sf_dir):
    """A-79: median imputation of an external score within its segment, plus a missing flag."""
    out = P.impute_median(an.application(spark, sf_dir), "EXT_SOURCE_1", ["NAME_CONTRACT_TYPE"])
    return finish(out.select("SK_ID_CURR", "EXT_SOURCE_1_IMPUTED", "EXT_SOURCE_1_MISSING"))


@register("prediction_summary", rounded_all(f"""WITH sl AS ({an.SQL_SCORED_LONG})
SELECT model, min(prob) AS min, max(prob) AS max, avg(prob) AS mean FROM sl GROUP BY model""", ["model"]))
def prediction_summary(spark, sf_dir):
    """A-80: min / max / mean of each model's scores."""
    return finish(P.summary(an.scored_long(spark, sf_dir), "prob", ["model"]))


@register("employed_without_sentinel", rounded_all(f"""WITH a AS ({an.SQL_APPLICATION})
SELECT count(*) AS n_rows, count(DAYS_EMPLOYED) AS n_present, avg(DAYS_EMPLOYED) AS days_employed_mean,
  min(DAYS_EMPLOYED) AS days_employed_min, max(DAYS_EMPLOYED) AS days_employed_max
FROM a WHERE DAYS_EMPLOYED IS NULL OR DAYS_EMPLOYED <> 365243""", ["n_rows", "n_present", "days_employed_min", "days_employed_max"]))
def employed_without_sentinel(spark, sf_dir):
    """F-03: exclude sentinel rows but keep missing ones (as the reference's inequality filter does)."""
    a = an.application(spark, sf_dir)
    kept = a.filter(F.col("DAYS_EMPLOYED").isNull() | (F.col("DAYS_EMPLOYED") != 365243))
    return finish(kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count("DAYS_EMPLOYED").alias("n_present"),
                           F.avg("DAYS_EMPLOYED").alias("days_employed_mean"),
                           F.min("DAYS_EMPLOYED").alias("days_employed_min"),
                           F.max("DAYS_EMPLOYED").alias("days_employed_max")))
