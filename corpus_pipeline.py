"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame with the columns
of ``documents``; the last adds the mixing columns. ``run`` writes each stage as Parquet and reads it again.
Filtering stages keep whole rows as they are. Where an operator reads each document by itself, the row is
passed through it as the id, so no join is needed to filter.

All stages: further columns pass through, whatever their names; repeated rows are rows of their own unless a stage
drops copies; an empty table gives an empty result; null texts count as empty. A row whose doc_id is null is told
from others by its text: it is a copy of rows with an equal or similar text like any other row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import decontaminate, exact, jaccard, language, mixing
from riskflow.llm.queries import TARGETS, domains
from riskflow.llm.store import fold, free_name, materialize, read_docs

#: Least language score: below it, no language holds a clear part of the text.
LEAST_SCORE = 0.3
#: Near copies: shingles of so many words, and the percentage of them that two texts share at least.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[_col(c) for c in docs.columns]).alias("row"), "text")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``kept``; a null id matches a null id."""
    name = free_name(docs, "_kept_id")
    ids = kept.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of which no language holds a clear part, go. Repeated rows and rows
    without an id are read each for itself; a null text has no letter."""
    model = language.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = language.identify(_rows(docs), model, id_col="row")
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), the row of the smallest doc_id stays; rows that repeat that id all stay."""
    return _only(docs, exact.exact_dedup(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (80 % of their shingles of five words in common), the row of the smallest
    doc_id stays; texts without words are near copies of nothing and stay."""
    found = jaccard.jaccard_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    return _only(docs, found.filter("doc_id <=> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window in them go: the coverage limit of this corpus is 0. Rows are read each for itself."""
    found = decontaminate.decontaminate(_rows(docs), read_docs(spark, sf_dir, "benchmark"), id_col="row")
    return found.filter(F.size("hits") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document ``mix_copies`` times (0: not at all), numbered by ``mix_copy`` from 1, with the rate at which it
    was drawn, so the tokens of the rows are in the proportions of the target weights."""
    model = mixing.fit(docs, domains(read_docs(spark, sf_dir, "labels")), TARGETS)
    rated = mixing.apply(docs, model)
    # Filtered after the copies are made: a filter on the rate would be moved below it and rate each text twice.
    copies = F.explode_outer(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return rated.withColumn("mix_copy", copies).filter("mix_copy IS NOT NULL")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix),
]

#: Language ID and the mixing rates are learned models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-stage{k}")
    return docs
