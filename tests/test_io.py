"""Sources and sinks: explicit-schema CSV (empty -> NULL), type-narrowing plan, registry defaults."""

from riskflow.sources import io


def test_csv_roundtrip_empty_is_null(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.5, None)], "id long, x double, s string")
    path = io.write_csv(df, io.unique_path(spark, "t-csv"))
    back = {r.id: r for r in io.read_csv(spark, path, "id long, x double, s string").collect()}
    assert back[1].x is None and back[2].x == 2.5 and back[2].s is None


def test_narrowing_plan(spark):
    df = spark.createDataFrame([(i, i * 1000, float(i), "seg" if i % 2 else "other", f"name{i}") for i in range(100)],
                               "a long, b long, c double, d string, e string")
    plan = {r.column: (r.target_type, r.is_dictionary) for r in io.narrowing_plan(df).collect()}
    assert plan["a"] == ("tinyint", False) and plan["b"] == ("int", False) and plan["c"] == ("float", False)
    assert plan["d"] == ("string", True) and plan["e"] == ("string", False)


def test_registry_defaults(spark):
    path = io.write_registry(spark, {"auc": 0.7}, io.unique_path(spark, "t-reg"))
    r = io.read_registry(spark, path).collect()[0]
    assert r.model_version == "1.0.0" and r.optimal_threshold == 0.21 and r.auc == 0.7


def test_sequences_follow_the_files(spark, tmp_path):
    """Several files, several splits, several partitions: the position is that of the input."""
    lines = [f'{{"k": {i}}}' if i % 10 else ("" if i % 20 else "no record") for i in range(400)]
    (tmp_path / "j").mkdir()
    for f in range(4):
        (tmp_path / "j" / f"part-{f}.json").write_text("\n".join(lines[f * 100:(f + 1) * 100]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = io.read_json_records(spark, str(tmp_path / "j"), "k int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.seq, r.k) for r in got) == [(i, i if i % 10 else None) for i in range(400)]
    for f in range(3):
        spark.range(f * 50, f * 50 + 50).selectExpr("id", "'{\"k\": ' || id || '}' AS j").coalesce(1).write.parquet(str(tmp_path / "p" / f"d={f}"))
    rows = io.read_sequenced(spark, str(tmp_path / "p")).repartition(7)
    assert sorted((r.seq, r.id) for r in rows.collect()) == [(i, i) for i in range(150)]
    assert sorted((r.seq, r.k) for r in io.records_from_json(rows, "j", "k int").collect()) == [(i, i) for i in range(150)]


def test_malformed_values_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,c\n1,x,2\n,3,oops\n4.5,5,6\n")
    got = {r["column"]: r.n_malformed for r in io.malformed_counts(spark, str(tmp_path / "t.csv"), "a int, b int, c double").collect()}
    assert got == {"a": 1, "b": 1, "c": 1}
