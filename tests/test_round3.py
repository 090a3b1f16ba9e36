"""What round 3 found: divisions by zero, tasks that order whole files, trees walked again in every pass, few tasks."""

from pyspark.sql import functions as F

from riskflow.operators import boost as B
from riskflow.operators import decide as D
from riskflow.plans import ORACLES, QUERIES
from riskflow.session import TASK_ROWS, cut_lineage, spread
from riskflow.sources import io


def test_advice_of_an_income_of_minus_one(spark, tmp_path):
    import duckdb
    rows = [(i, income, nation, segment) for i, (income, nation, segment) in enumerate(
        (x, n, s) for x in (-1.0, 0.0, 5000.0, None) for n in (0, 9, None) for s in ("MACHINERY", "BUILDING", None))]
    spark.createDataFrame([(i, f"c{i}", n, x, s) for i, x, n, s in rows], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for key in ("advice_rules", "advice_range"):
        want = db.execute(ORACLES[key]).fetchall()
        got = [tuple(r) for r in QUERIES[key](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_advice_of_no_ratio(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 0.0), (-1.0, -5.0, -5.0), (-1.0, 5.0, 5.0)], "AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double").withColumns({
        "DAYS_BIRTH": F.lit(-14000), "DAYS_EMPLOYED": F.lit(-1000), "default_probability": F.lit(0.5), **{f"EXT_SOURCE_{i}": F.lit(0.9) for i in (1, 2, 3)}})
    assert [r.n_high for r in D.advice(df).collect()] == [2, 0, 2]


def test_positions_of_a_file_need_no_ordering_of_its_rows(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = io.read_sequenced(spark, str(tmp_path / "p"))
    assert "row_number" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.seq, r.id) for r in rows.collect()) == [(i, i) for i in range(100)]


def _rows(spark, n):
    return spark.range(n).select("id", (F.xxhash64("id") % 2 == 0).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"),
                                 (F.xxhash64("id", F.lit(1)) % 100).cast("double").alias("a"), (F.xxhash64("id", F.lit(2)) % 9).cast("double").alias("b"))


def test_a_tree_is_added_to_the_scores_once(spark, monkeypatch):
    walked, state = [], B._Model.state
    monkeypatch.setattr(B._Model, "state", lambda m: walked.append(len(m.pending)) or state(m))
    monkeypatch.setattr(B, "LINEAGE", 2)
    B.cross_validate(_rows(spark, 300), B.BoostSpec("t", 6, 0.3, 2), ["a", "b"], "id", "label", "fold", 3)
    assert max(walked) <= 2


def test_blocks_and_groups_of_models_give_the_same_trees(spark, monkeypatch):
    df, specs = _rows(spark, 400), [B.BoostSpec("t", 3, 0.3, 3, subsample=0.8, seed=s) for s in (1, 2, 3)]
    edges = B.bin_edges(df, ["a", "b"])
    rows = B.binned(df, ["a", "b"], edges, "id", "label", "fold")
    one = B.fit_many(rows, ["a", "b"], edges, [(s, 0) for s in specs])
    monkeypatch.setattr(B, "BLOCK_ROWS", 90)
    many = B.fit_many(rows, ["a", "b"], edges, [(s, 0) for s in specs])
    for x, y in zip(one, many, strict=True):
        assert [(t.feature, t.cut) for t in x.trees] == [(t.feature, t.cut) for t in y.trees] and x.trees


def test_training_rows_are_spread_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = cut_lineage(spark.range(100).coalesce(1)), cut_lineage(spark.range(3 * TASK_ROWS).coalesce(1))
    assert spread(few) is few
    for df in (many, cut_lineage(spark.range(3 * TASK_ROWS).repartition(40))):
        got = spread(df)
        assert got.rdd.getNumPartitions() == min(cores, 3) and got.count() == 3 * TASK_ROWS
