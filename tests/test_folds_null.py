"""Folds keep every row: NULL labels are a class, NULL ids come last in theirs."""

from collections import Counter

import duckdb

from riskflow.operators import folds

SCHEMA = "id long, label int, x string"
ROWS = [(i, (0, 1, None)[i % 3] if i % 5 else 0, f"r{i}") for i in range(400)] + [(None, (0, 1, None)[i % 3], f"n{i}") for i in range(60)]


def test_folds_keep_rows_without_label_or_id(spark):
    got = folds.stratified_folds(spark.createDataFrame(ROWS, SCHEMA), "id", "label", k=5, seed=42)
    assert got.columns == ["label", "id", "x", "fold"]
    rows = got.collect()
    assert Counter((r.id, r.label, r.x) for r in rows) == Counter(ROWS)
    sizes = Counter((r.label, r.fold) for r in rows)
    for label in (0, 1, None):
        of = [sizes[(label, f)] for f in range(5)]
        assert max(of) - min(of) <= 1 and min(of) > 0
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, label INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", ROWS)
    want = con.sql("SELECT id, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || ':42')) - 1) % 5 "
                   "FROM t QUALIFY id IS NOT NULL").fetchall()
    assert sorted(want) == sorted((r.id, r.fold) for r in rows if r.id is not None)


def test_one_class_without_labels(spark):
    got = folds.stratified_folds(spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, None, "b")], SCHEMA), "id", "label", k=2)
    assert sorted(r.fold for r in got.collect()) == [0, 0, 1]
