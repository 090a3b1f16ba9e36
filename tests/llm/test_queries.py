"""The registered keys against their SQL, and the pipeline against brute force, on the smallest tables."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.llm import mixing
from riskflow.llm import queries as Q
from riskflow.llm.store import read_docs
from tests.llm.test_operators import expected_components, expected_exact, expected_hits, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_oracle(spark, key):
    df = Q.QUERIES[key](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    rel = con.sql(Q.ORACLES[key])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())


def test_keys():
    found = entry.queries()
    for n in range(1, 14):
        assert len([k for k in found if k.startswith(f"op{n}_")]) == 1
    assert found["pipeline"] is corpus_pipeline.run


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:len(docs.columns)] == docs.columns
    # Every stage by itself, on what its predecessor kept.
    stage = docs
    for name, run in corpus_pipeline.STAGES:
        after = run(spark, stage, SMALL).cache()
        before, kept = rows_of(stage), {r.doc_id for r in after.collect()}
        if name == "language ID":
            assert {d for d, t in before if any(c.isalpha() for c in t or "")} - kept == set()
        elif name == "exact dedup":
            assert kept == {d for d, _, _, keep, _ in expected_exact(before) if keep}
        elif name == "n-gram Jaccard join":
            assert kept == {d for d, _, comp in expected_components(before, percent=80, size=5) if d == comp}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert kept == {d for d, *_, hit in expected_hits(before, items) if not hit}
        else:                               # each document as often as its rate says
            copies = Counter((r.doc_id, r.mix_copies) for r in after.collect())
            assert kept <= {d for d, _ in before} and all(n == times >= 1 for (_, times), n in copies.items())
            rated = mixing.apply(stage, mixing.fit(stage, Q.domains(read_docs(spark, SMALL, "labels")), Q.TARGETS))
            assert copies == Counter({(r.doc_id, r.mix_copies): r.mix_copies for r in rated.collect() if r.mix_copies})
        stage = after
    columns = [*docs.columns, "mix_tokens", "mix_copies", "mix_domain"]
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, stage.select(columns).collect()))


def test_library_stands_without_the_package():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('riskflow.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert not [k for k in e.queries() if k.startswith('op')] and len(e.oracle_sql()) > 50\n")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_stages_take_any_column_name(spark):
    """Awkward names, null ids, repeated rows and empty tables pass through every stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60")
    odd = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["my col", "a.b", "_kept_id", "_mix_words", "row", "id", "tick`s", "Score"])],
                      F.struct(F.lit(1).alias("my field"), F.lit("x").alias("c.d")).alias("nested struct"))
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for name, run in corpus_pipeline.STAGES:
        after = run(spark, odd, SMALL)
        assert after.columns[:len(odd.columns)] == odd.columns and after.count() > 0, name
        assert run(spark, odd.limit(0), SMALL).count() == 0, name


def test_near_copies_are_told_by_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    texts = [(1, base), (2, [*base[:52], "x", *base[53:]]), (3, [*base[:20], "x", *base[21:60], "y", *base[61:]]), (4, base[:60])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()}
    # 100 shingles; one word changes five of them (95 of 105), two words ten (90 of 110); a part of 56 is no near copy.
    assert kept == {1, 4}
