"""Mixing sources to target weights with soft domain membership (DataFrame functions only).

1. A naive Bayes classifier learns the domains of a labelled table from about ``per_domain``
   documents each (chosen by a hash of the id, so their ids are a broadcast of that bound): of all
   words and symbol runs, the ``VOCABULARY`` whose presence tells domains apart most. It gives each
   document posteriors p over the domains.
2. Nonnegative document rates r are fitted by projected-gradient least squares, so that the expected
   tokens of domain k, the sum of r * tokens * p[k], meet target[k]. The gradient of a document is p
   times the residual, scaled by the small matrix of token-weighted products of posteriors (the step
   that would close the residual if no rate were cut at 0). Each step is one aggregate over all
   documents; the driver holds one residual and one matrix, domains by domains. Rates start at 1, and a
   rate is a function of the posteriors and the list of steps, so no table is rewritten between steps.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import free_name, materialize

PER_DOMAIN = 2000
VOCABULARY = 64
LEAST_DOCS = 5          # of the sample, that hold a word of the vocabulary
MOST_DOMAINS = 64
STEPS = 40
CLOSE = 1e-7            # residual, relative to all tokens, that ends the steps
PATIENCE = 5            # steps without a tenth less residual that end them


class Mixture(NamedTuple):
    domains: list[str]
    weights: dict[str, list[float]]      # word -> log odds of its presence by domain
    bias: list[float]
    steps: list[list[float]]             # scaled residuals, domains long
    residual: float                      # left at the end, relative to all tokens


def words(text: Column) -> Column:
    """Lower-case words of a text in an array: runs of a-z and of all signs beyond ASCII. It may begin or end with ''."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x60\x7B-\x7F]+")


def signs(text: Column) -> Column:
    """Runs of ASCII punctuation in an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[!-/:-@\[-`{-~]+"), F.lit(0))


def n_tokens(found: Column) -> Column:
    """Number of words in an array of ``words``."""
    ends = F.when(F.element_at(found, 1) == "", 1).otherwise(0) + F.when(
        (F.size(found) > 1) & (F.element_at(found, -1) == ""), 1).otherwise(0)
    return (F.size(found) - ends).cast("long")


def _doubles(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")" if len(values) else "CAST(array() AS array<double>)"


def _posterior(model: Mixture, present: Column) -> Column:
    """Posteriors, in the order of the domains, from the listed words that are present."""
    k = len(model.domains)
    if model.weights:
        table = F.create_map(*[x for w, v in model.weights.items() for x in (F.lit(w), F.expr(_doubles(v)))])
        total = F.aggregate(present, F.expr(_doubles(model.bias)),
                            lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    else:
        total = F.expr(_doubles(model.bias))
    # exp(x - log-sum-exp), each part bound once
    return F.transform(F.array(total), lambda t: F.transform(
        F.array(F.transform(t, lambda x: F.exp(x - F.array_max(t)))),
        lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0])[0] if k else total


def posterior(model: Mixture, found: Column, text: Column) -> Column:
    """``found``: the ``words`` of the text."""
    listed = F.array(*[F.lit(w) for w in model.weights]) if model.weights else F.expr("CAST(array() AS array<string>)")
    return _posterior(model, F.array_intersect(F.concat(found, signs(text)), listed))


def rate(model: Mixture, post: Column) -> Column:
    """Rate of a document from its posteriors: all steps from 1 on, cut at 0 after each."""
    steps = "array(" + ", ".join(_doubles(s) for s in model.steps) + ")" if model.steps else "CAST(array() AS array<array<double>>)"
    return F.aggregate(F.expr(steps), F.lit(1.0), lambda r, g: F.greatest(
        F.lit(0.0), r + F.aggregate(F.zip_with(post, g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)))


def _classifier(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, per_domain: int) -> Mixture:
    """``labelled``: (id, domain), one row per id."""
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "domain").limit(MOST_DOMAINS + 1).collect()}
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = sorted(sizes)
    if not domains:
        return Mixture([], {}, [], [], 0.0)
    share = F.element_at(F.create_map(*[F.lit(x) for k in domains for x in (k, min(1.0, per_domain / sizes[k]))]),
                         F.col("domain"))
    picked = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = materialize(sample.select("domain", F.array_distinct(F.concat(words(F.col("text")), signs(F.col("text")))).alias("ws")), "op10-sample")
    seen = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([seen.get(k, 0) for k in domains], float)
    counts = (sample.select("domain", F.explode("ws").alias("w")).filter("w <> ''").groupBy("w")
              .agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("domain") == k).alias(f"d{i}") for i, k in enumerate(domains)])
              .filter(F.col("all") >= LEAST_DOCS))
    # How far the shares of documents with the word lie apart between domains, in standard errors.
    shares = [(F.col(f"d{i}") + 0.5) / (n[i] + 1.0) for i in range(len(domains))]
    pooled = (F.col("all") + 0.5) / (float(n.sum()) + 1.0)
    spread = sum((s - pooled) ** 2 * float(n[i]) for i, s in enumerate(shares)) / (pooled * (1.0 - pooled) + 1e-6)
    top = counts.withColumn("spread", spread).orderBy(F.desc("spread"), "w").limit(VOCABULARY).collect()
    total = np.array([sizes[k] for k in domains], float)
    bias, weights = np.log(total / total.sum()), {}
    for r in top:
        p = (np.array([r[f"d{i}"] for i in range(len(domains))]) + 0.5) / (n + 1.0)
        weights[r["w"]] = (np.log(p) - np.log1p(-p)).tolist()
        bias = bias + np.log1p(-p)
    return Mixture(domains, weights, bias.tolist(), [], 0.0)


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain", per_domain: int = PER_DOMAIN) -> Mixture:
    """Classifier and rates. ``targets`` are weights of all tokens by domain (0 where absent), scaled to sum to 1.

    Labelled rows with a null id or domain are not used; of several for an id the first domain in order counts."""
    known = labelled.filter(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    model = _classifier(docs, known, id_col, text_col, per_domain)
    k = len(model.domains)
    if not k:
        return model
    text = F.col(text_col)
    rows = docs.select(text.alias("text"), words(text).alias("ws")).select(
        n_tokens(F.col("ws")).cast("double").alias("t"), posterior(model, F.col("ws"), F.col("text")).alias("p"))
    # Documents of equal posteriors get equal rates: they are one row of the fit.
    rows = materialize(rows.groupBy(*[F.col("p")[i].alias(f"p{i}") for i in range(k)]).agg(F.sum("t").alias("t")).select(
        F.array(*[f"p{i}" for i in range(k)]).alias("p"), "t"), "op10-posteriors")
    weight = np.array([max(0.0, float(targets.get(x, 0.0))) for x in model.domains])
    tokens = rows.agg(F.sum("t")).first()[0] or 0.0
    if not tokens or not weight.sum():
        return model
    goal = weight / weight.sum()
    p = [F.col("p")[i] for i in range(k)]
    best, history = model._replace(residual=float("inf")), []
    for _ in range(STEPS + 1):
        at = rows.withColumn("r", rate(model, F.col("p")))
        sums = at.agg(*[F.sum(F.col("r") * F.col("t") * p[i]).alias(f"s{i}") for i in range(k)],
                      *[F.sum(F.when(F.col("r") > 0, F.col("t") * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}")
                        for i in range(k) for j in range(i, k)]).first()
        residual = goal - np.array([sums[f"s{i}"] for i in range(k)]) / tokens
        left = float(np.abs(residual).max())
        if left < best.residual:
            best = model._replace(residual=left)
        history.append(left)
        stalled = len(history) > PATIENCE and min(history[-PATIENCE:]) > 0.9 * min(history[:-PATIENCE])
        if left < CLOSE or len(model.steps) >= STEPS or stalled:
            break
        matrix = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / tokens
        step = np.linalg.solve(matrix + 1e-9 * np.eye(k), residual)
        model = model._replace(steps=[*model.steps, np.clip(step, -1e6, 1e6).tolist()])
    return best


def apply(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and mix_domain (likeliest), mix_posterior, mix_tokens, mix_rate and mix_copies
    (the rate rounded up or down by a hash of the id, in proportion). Existing columns of these names give way.

    Null and empty texts have no tokens; their posteriors are those of a text without any listed word. Repeated rows
    are rated each for itself; without domains or targets every rate is 1 (and domain null)."""
    names = F.expr("array(" + ", ".join("'" + d.replace("\\", "\\\\").replace("'", "\\'") + "'" for d in model.domains) + ")")
    held = free_name(docs, "_mix_words")
    found = F.col(held)
    out = docs.withColumn(held, words(F.col(text_col))).withColumns(
        {"mix_posterior": posterior(model, found, F.col(text_col)), "mix_tokens": n_tokens(found)}).drop(held)
    out = out.withColumn("mix_rate", rate(model, F.col("mix_posterior")))
    top = F.element_at(names, F.array_position("mix_posterior", F.array_max("mix_posterior")).cast("int")) if model.domains \
        else F.lit(None).cast("string")
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return out.withColumn("mix_domain", top).withColumn("mix_copies", F.floor(F.col("mix_rate") + part).cast("long"))
