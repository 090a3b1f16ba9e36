"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, byte trigrams score the word for the
candidates, and a Viterbi path over the words, with a penalty for each switch, labels spans.
The document's language is the label with most text.

Learning: byte-trigram and script counts per language, from a sample of labelled rows of about
``per_language`` documents each (chosen by a hash of id and text; a language with fewer gives all).
The model is one float table of languages x 2**15 buckets, so its broadcast is bounded.
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

from riskflow.llm.store import id_schema
from riskflow.llm.tokens import LETTERS, Words, slices

PER_LANGUAGE = 5000
BUCKETS = 1 << 15
SWITCH = 12.0           # nats against a change of language between two words
SCRIPT_LEAST = 1e-4     # share of a language's words from which it counts as written in a script
MOST_LANGUAGES = 512
UNKNOWN = "und"

# Scripts by UTF-8 lead byte. Each lead byte stands for one range of code points.
SCRIPTS = {"latin": (0x41, 0x5B, 0x61, 0x7B, 0xC2, 0xCA), "ipa": (0xCA, 0xCE), "greek": (0xCE, 0xD0),
           "cyrillic": (0xD0, 0xD5), "armenian-hebrew": (0xD5, 0xD8), "arabic": (0xD8, 0xDD), "syriac-nko": (0xDD, 0xE0),
           "indic": (0xE0, 0xE1), "georgian-ethiopic": (0xE1, 0xE2), "symbols": (0xE2, 0xE3), "kana": (0xE3, 0xE4),
           "han": (0xE4, 0xEA), "hangul": (0xEA, 0xEE), "forms": (0xEE, 0xF0), "supplementary": (0xF0, 0xF8)}
_SCRIPT = np.zeros(256, np.uint8)
for _i, _ends in enumerate(SCRIPTS.values(), 1):
    for _lo, _hi in zip(_ends[::2], _ends[1::2]):
        _SCRIPT[_lo:_hi] = _i
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[~LETTERS] = 32


class Features(NamedTuple):
    """Words of a batch, the trigram bucket around each byte, and the script of each word."""

    words: Words
    bucket: np.ndarray
    script: np.ndarray


def features(column: pa.Array) -> Features:
    words = Words(column, LETTERS, lower=True, fingerprints=False)
    n = len(words.data)
    padded = np.full(n + 2, 32, np.uint32)
    padded[1:-1] = _FOLD[words.data]
    before, after = padded[:-2].copy(), padded[2:].copy()
    edge = words.offsets[(words.offsets > 0) & (words.offsets < n)]
    before[edge] = 32
    after[edge - 1] = 32
    code = (before << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | after
    bucket = (code * np.uint32(2654435769)) >> np.uint32(32 - 15)
    script = np.zeros(0, np.uint8)
    if len(words.start):
        # Largest script number of a word: beyond Latin if any of its letters is.
        script = np.maximum.reduceat(np.append(_SCRIPT[words.data] * LETTERS[words.data], 0).astype(np.uint8),
                                     np.stack([words.start, words.end], 1).ravel())[::2]
    return Features(words, bucket, script)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task: trigram counts, then word counts by script from BUCKETS on."""
    tables: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        f = features(batch["text"])
        langs = np.array(batch["lang"].to_pylist(), object)
        inside = np.repeat(np.arange(len(f.words.start)), f.words.end - f.words.start)
        at = np.arange(len(inside)) - np.repeat(np.cumsum(f.words.end - f.words.start) - (f.words.end - f.words.start),
                                                f.words.end - f.words.start) + f.words.start[inside]
        doc = f.words.doc()
        for lang in set(langs.tolist()):
            table = tables.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
            mine = (langs == lang)[doc]
            table[:BUCKETS] += np.bincount(f.bucket[at[mine[inside]]], minlength=BUCKETS)
            table[BUCKETS:] += np.bincount(f.script[mine], minlength=len(SCRIPTS) + 1)
    for lang, table in tables.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(table[at])], names=["lang", "bucket", "n"])


class Model(NamedTuple):
    languages: list[str]
    trigrams: np.ndarray     # [bucket, language]: log probability
    scripts: np.ndarray      # [script, language]: 0 if it is written so, else a large loss
    prior: np.ndarray        # [language]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows where ``learn`` holds and text and language are not null."""
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.xxhash64(id_col, text_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))]),
                         F.col("lang"))
    picked = rows.filter(F.pmod("k", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    table = picked.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    number = {k: i for i, k in enumerate(languages)}
    counts[table["bucket"].to_numpy(), [number[k] for k in table["lang"].to_pylist()]] = table["n"].to_numpy()
    tri, script = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    written = script / np.maximum(script.sum(axis=0), 1) >= SCRIPT_LEAST
    written[~written.any(axis=1)] = True       # a script that no language is written in excludes none
    total = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(tri / tri.sum(axis=0)).astype(np.float32), np.where(written, 0.0, -50.0),
                 np.log((total + 1) / (total + 1).sum()))


def word_scores(f: Features, model: Model) -> np.ndarray:
    """[word, language]: log posterior of the word among its candidates."""
    out = np.empty((len(f.words.start), len(model.languages)))
    for k in range(len(model.languages)):
        sums = np.zeros(len(f.bucket) + 1)
        np.cumsum(model.trigrams[:, k][f.bucket], out=sums[1:])
        out[:, k] = sums[f.words.end] - sums[f.words.start]
    out += model.scripts[f.script]
    out -= out.max(axis=1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    return np.maximum(out, -20.0)


def viterbi(scores: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of one document's words."""
    n, size = scores.shape
    back = np.zeros((n, size), np.int32)
    best = scores[0] + prior
    every = np.arange(size)
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[t] = np.where(stay, every, top)
        best = np.where(stay, best, best[top] - switch) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(f: Features, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """(label of each word, margin of each document's best single language over the next).

    A document where no run of words gains more than half the penalty over its best single language has that
    language throughout: each switch of a path costs the penalty and a run gains less. Only the others are
    walked word by word."""
    scores = word_scores(f, model)
    first, counts = f.words.first, f.words.counts
    docs = np.flatnonzero(counts)
    path = np.zeros(len(scores), np.int64)
    margin = np.zeros(len(counts))
    if not len(docs):
        return path, margin
    begin = first[:-1][docs]
    totals = np.add.reduceat(scores, begin, axis=0) + model.prior
    main = totals.argmax(axis=1)
    path[:] = np.repeat(main, counts[docs])
    if len(model.languages) < 2:
        margin[docs] = np.inf
        return path, margin
    ranked = np.sort(totals, axis=1)
    margin[docs] = ranked[:, -1] - ranked[:, -2]
    own = np.take_along_axis(scores, path[:, None], 1)[:, 0]
    mixed = np.zeros(len(docs), bool)
    number = np.repeat(np.arange(len(docs)), counts[docs])
    for k in range(len(model.languages)):
        gain = np.cumsum(scores[:, k] - own)
        before = np.concatenate([[0.0], gain[:-1]])
        shift = number * (2.0 * np.abs(gain).max() + 1.0)     # lower for each next document: its minimum starts anew
        least = np.minimum.accumulate(before - shift) + shift
        start = model.prior[k] - model.prior[main]
        mixed |= np.maximum.reduceat(gain - least, begin) + np.maximum(start, 0) > switch / 2
    for i in np.flatnonzero(mixed):
        s, e = begin[i], begin[i] + counts[docs[i]]
        path[s:e] = viterbi(scores[s:e], model.prior, switch)
    return path, margin


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _predict(batches: Iterator[pa.RecordBatch], model: Model, switch: float) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    for batch in slices(batches):
        f = features(batch["text"])
        path, margin = label(f, model, switch) if len(names) else (np.zeros(0, np.int64), np.zeros(batch.num_rows))
        letters = np.array(batch["letters"].to_pylist(), bool)
        pred, score, spans = [], [], []
        for d in range(batch.num_rows):
            s, e = f.words.first[d], f.words.first[d + 1]
            if s == e or not letters[d] or not len(names):
                pred.append(UNKNOWN)
                score.append(0.0)
                spans.append([])
                continue
            mine = path[s:e]
            sizes = np.bincount(mine, (f.words.end - f.words.start)[s:e], len(names))
            top = int(sizes.argmax())
            cut = np.flatnonzero(np.diff(mine, prepend=-1, append=-1))
            pred.append(names[top])
            score.append(float(sizes[top] / sizes.sum() * (1.0 - 0.5 * np.exp(-margin[d]))))
            spans.append([{"lang": names[mine[a]], "start": int(a), "end": int(b)} for a, b in zip(cut, cut[1:])])
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                          pa.array(spans, _SPANS)], names=["id", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             switch: float = SWITCH) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1: share of text so labelled, less where the best two
    languages are near) and spans (lang, first and end word; words are runs of letters).

    ``und``, score 0 and no spans if the text is null, has no letter, or the model knows no language. Repeated
    rows are labelled each for itself; an empty table gives an empty result; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        return _predict(batches, pickle.loads(sent.value), switch)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(
        run, id_schema(docs, id_col, "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")
    ).withColumnRenamed("id", id_col)
