"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models, of toxic and of ordinary documents, share their backoff. Their counts are
continuation counts: a bigram counts once for each word before it, a word once for each word before
it, so a passage that is copied a thousand times weighs as much as one copy. Below the class bigrams
and class words stand the continuation counts of both classes together, and below
these the word counts of the whole corpus. A rare expression therefore is as likely in either class
and moves no score; one that a class really uses does.

A document's log-likelihoods are length-normalised; a logistic curve, fitted on labelled documents
that the counts have not seen, turns their difference into a probability.

* Class counts: from a sample of labelled rows, about ``per_class`` documents of each label (chosen
  by a hash of the id; a rarer class gives all). Their ids are a broadcast of that bound, so no
  text is shuffled. Bigrams that no class holds more often than the discount, and words held
  once, are not listed: they weigh nothing, and the model is bounded by the sample.
* Corpus counts: every word of every document, summed into 2**18 buckets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize
from riskflow.llm.tokens import LETTERS, Words, mix, slices

PER_CLASS = 5_000
DISCOUNT = 0.75         # of continuation counts
CLASS_DISCOUNT = 2.0    # of the counts of a class: what it holds fewer times is left to the shared counts
CORPUS_BITS = 18
STRONGEST = 3           # words whose mean difference is the second feature of the curve
MOST = 8.0              # nats that a single word can weigh
CLEAR = 3.0             # nats from which a word's difference counts for the third
_START = 0              # context of a document's first word


def _contexts(words: Words) -> np.ndarray:
    """Fingerprint of the word before each word."""
    v = np.concatenate([[np.uint64(_START)], words.hash[:-1]])[:len(words.hash)]
    v[words.first[:-1][words.counts > 0]] = _START
    return v


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _bucket(w: np.ndarray) -> np.ndarray:
    return (w >> np.uint64(64 - CORPUS_BITS)).astype(np.int64)


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << CORPUS_BITS, np.int64)
    for batch in slices(batches):
        table += np.bincount(_bucket(Words(batch["text"], LETTERS, lower=True).hash), minlength=len(table))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["w", "n"])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, w, n0, n1) of a slice: its trigrams, and whether they are in ordinary and in toxic documents."""
    for batch in slices(batches, limit=1 << 22):
        words = Words(batch["text"], LETTERS, lower=True)
        v, w = _contexts(words), words.hash
        u = np.concatenate([[np.uint64(_START)], v[:-1]])[:len(w)]
        u[words.first[:-1][words.counts > 0]] = _START
        label = batch["label"].to_numpy(zero_copy_only=False)[words.doc()]
        _, at, which = np.unique(_pair(_pair(u, v), w), return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x[at].view(np.int64)) for x in (u, v, w)],
             *[pa.array((np.bincount(which[label == c], minlength=len(at)) > 0).astype(np.int32)) for c in (0, 1)]],
            names=["u", "v", "w", "n0", "n1"])


class Model(NamedTuple):
    """Axis 0 of the tables: ordinary, toxic. The last column of words and contexts is for those not listed."""

    corpus: np.ndarray       # [2**CORPUS_BITS] word probabilities in the whole corpus
    lowest: np.ndarray       # [2] weight of the corpus level for a word not listed
    listed: np.ndarray       # sorted fingerprints
    words: np.ndarray        # [2, listed] word probabilities
    contexts: np.ndarray     # [2, listed + 1] counts as a context
    backoff: np.ndarray      # [2, listed + 1] weight of the word level after a context
    pairs: np.ndarray        # sorted bigram fingerprints
    seen: np.ndarray         # [2, pairs] discounted counts
    curve: np.ndarray        # weights of (1, mean, strongest words, clear words)
    base: float              # probability if there is nothing to learn or to score


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x, or len(sorted_) where it is absent."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, len(sorted_))


def likelihoods(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word in the ordinary and in the toxic model."""
    w = words.hash
    place = _find(model.listed, w)
    context = np.concatenate([[0], place[:-1]])[:len(w)]
    context[words.first[:-1][words.counts > 0]] = _find(model.listed, np.zeros(1, np.uint64))[0]
    both = np.flatnonzero((place < len(model.listed)) & (context < len(model.listed)))
    pair = _find(model.pairs, _pair(_contexts(words)[both], w[both]))
    both, pair = both[pair < len(model.pairs)], pair[pair < len(model.pairs)]
    corpus, out = model.corpus[_bucket(w)], []
    for c in (0, 1):
        p = np.where(place < len(model.listed), np.append(model.words[c], 0)[place], model.lowest[c] * corpus)
        p *= model.backoff[c][context]
        n = model.contexts[c][context[both]]
        p[both] += np.divide(model.seen[c][pair], n, out=np.zeros(len(n)), where=n > 0)
        out.append(np.log(p))
    return out[0], out[1]


def document_features(words: Words, model: Model) -> np.ndarray:
    """[document, 4]: 1, and of the words' log-likelihood differences (toxic less ordinary) the mean, the mean of the
    strongest, and what exceeds ``CLEAR``, by the root of the length."""
    plain, toxic = likelihoods(words, model)
    n, gap = words.counts, (toxic - plain).astype(np.float64)
    size = np.maximum(n, 1)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    gap = np.clip(gap, -MOST, MOST)
    strong = np.zeros(len(n))
    for d in np.flatnonzero(n):
        x = gap[words.first[d]:words.first[d + 1]]
        k = min(STRONGEST, len(x))
        strong[d] = np.partition(x, len(x) - k)[len(x) - k:].sum() / STRONGEST
    return np.stack([np.ones(len(n)), total(gap) / size, strong, total(np.maximum(gap - CLEAR, 0)) / np.sqrt(size)], 1)


def _unlearned(base: float) -> Model:
    one = np.ones((2, 1))
    none = np.zeros(0, np.uint64)
    return Model(np.full(1 << CORPUS_BITS, 2.0 ** -CORPUS_BITS), np.ones(2), none, np.zeros((2, 0)), 0 * one, one, none,
                 np.zeros((2, 0)), np.zeros(4), base)


def _estimate(bigrams: DataFrame, corpus: np.ndarray, base: float) -> Model:
    """Kneser-Ney tables from the class continuation counts of bigrams (v, w, n0, n1) and the corpus word counts."""
    by_word = bigrams.groupBy("w").agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")).withColumn(
        "kinds", F.least("n0", F.lit(CLASS_DISCOUNT)) + F.least("n1", F.lit(CLASS_DISCOUNT)))
    by_context = bigrams.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"),
                                          F.sum(F.least("n0", F.lit(CLASS_DISCOUNT))).alias("k0"),
                                          F.sum(F.least("n1", F.lit(CLASS_DISCOUNT))).alias("k1"))
    counts = materialize(by_word.join(by_context, F.col("w") == F.col("v"), "full").select(
        F.coalesce("w", "v").alias("w"), *[F.coalesce(x, F.lit(0)).alias(x) for x in
                                           ("n0", "n1", "kinds", "c0", "c1", "k0", "k1")]), "op3-words")
    sums = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("kinds").alias("kinds"),
                      F.sum(F.least("n0", F.lit(CLASS_DISCOUNT))).alias("t0"), F.sum(F.least("n1", F.lit(CLASS_DISCOUNT))).alias("t1"),
                      F.count_if(F.col("kinds") > 0).alias("t")).first()
    t = counts.filter("n0 + n1 > 1 OR c0 + c1 > 1").toArrow()
    get = {k: t[k].to_numpy() for k in t.column_names}
    listed = get["w"].view(np.uint64)
    order = np.argsort(listed)
    listed, get = listed[order], {k: x[order].astype(np.float64) for k, x in get.items()}
    corpus = (corpus + 1.0) / (corpus.sum() + len(corpus))
    spread = DISCOUNT * sums["t"] / sums["kinds"]          # weight of the corpus below the shared continuation counts
    shared = np.maximum(get["kinds"] - DISCOUNT, 0) / sums["kinds"] + spread * corpus[_bucket(listed)]
    words, contexts, backoff, lowest = [], [], [], []
    for c in "01":
        weight = sums[f"t{c}"] / sums[f"n{c}"]
        words.append(np.maximum(get[f"n{c}"] - CLASS_DISCOUNT, 0) / sums[f"n{c}"] + weight * shared)
        lowest.append(weight * spread)
        n = np.append(get[f"c{c}"], 0)
        contexts.append(n)
        backoff.append(np.divide(np.append(get[f"k{c}"], 0), n, out=np.ones(len(n)), where=n > 0))
    t = bigrams.filter(f"greatest(n0, n1) > {CLASS_DISCOUNT}").toArrow()
    pairs = _pair(t["v"].to_numpy().view(np.uint64), t["w"].to_numpy().view(np.uint64))
    order = np.argsort(pairs)
    seen = np.stack([np.maximum(t[k].to_numpy()[order] - CLASS_DISCOUNT, 0) for k in ("n0", "n1")])
    return Model(corpus.astype(np.float32), np.array(lowest), listed, np.stack(words).astype(np.float32),
                 np.stack(contexts).astype(np.float32), np.stack(backoff).astype(np.float32), pairs[order],
                 seen.astype(np.float32), np.zeros(4), base)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; columns are scaled for the steps."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)]) * weight.sum() / len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b / scale


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from the labels (0 or 1) of rows where ``learn``, an expression over the id column, holds."""
    spark = docs.sparkSession
    known = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return _unlearned(float(1 in sizes))
    shares = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]) * (1 << 20)
    # Every fourth document fits the curve, the others give the counts.
    picked = known.filter(chosen).withColumn("apart", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(4)) == 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    corpus_rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_corpus_counts, "w int, n long").groupBy("w").agg(
        F.sum("n").alias("n")).toArrow()
    corpus = np.zeros(1 << CORPUS_BITS)
    corpus[corpus_rows["w"].to_numpy()] = corpus_rows["n"].to_numpy()
    base = sizes[1] / (sizes[0] + sizes[1])
    bigrams = materialize(
        texts.filter("NOT apart").select("text", "label").mapInArrow(
            _class_counts, "u long, v long, w long, n0 int, n1 int")
        .groupBy("u", "v", "w").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
        .groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "op3-bigrams")
    have = bigrams.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not (have["n0"] and have["n1"]):
        return _unlearned(base)
    model = _estimate(bigrams, corpus, base)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def score(batches):
        tables = pickle.loads(sent.value)
        for batch in slices(batches):
            x = document_features(Words(batch["text"], LETTERS, lower=True), tables)
            yield pa.RecordBatch.from_arrays([batch["label"], *[pa.array(x[:, i]) for i in (1, 2, 3)]],
                                             names=["label", "a", "b", "c"])

    held = texts.filter("apart").select("text", "label").mapInArrow(score, "label int, a double, b double, c double").toArrow()
    y = held["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([np.ones(len(y)), *[held[k].to_numpy() for k in "abc"]], 1)
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    return model._replace(curve=_logistic(x, y, weight))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (probability of the toxic label) and mean_difference (nats a word).

    Null, empty and wordless texts get the rate of toxic labels as their score, as does everything if only one class could
    be learned. Repeated rows are scored each for itself; an empty table gives an empty result; other columns are
    not read."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pickle.loads(sent.value)
        for batch in slices(batches):
            words = Words(batch["text"], LETTERS, lower=True)
            x = document_features(words, tables)
            p = 1 / (1 + np.exp(-np.clip(x @ tables.curve, -30, 30)))
            p[(words.counts == 0) | (not tables.curve.any())] = tables.base
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(p), pa.array(x[:, 1])],
                                             names=["id", "score", "mean_difference"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, score double, mean_difference double").withColumnRenamed("id", id_col)
