"""Operators against brute force, on the smallest tables and on rows made to be awkward."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskflow.llm import decontaminate, exact, jaccard, language, licenses, lines, mixing, secrets, substrings, toxicity
from riskflow.llm import queries as Q
from riskflow.llm.tokens import ALNUM, SPACED, Words

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id string, k long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3), (4, "one", "en", "s", 3),
    (5, "One  two\n", "en", "s", 9), (6, LONG, "en", "s", len(LONG)), (7, LONG, None, "s", 1), (7, LONG, None, "s", 1),
    (8, LONG + " tail", "en", "s", 1), (None, "null id text here", "en", "s", 1), (None, None, None, None, None),
    (9, "\U0001f600 été 中文 Δα", "fr", "s", 1), (10, "12 34 !?", "en", "s", 1),
]


def text_words(t, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    t = t or ""
    if lower:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall(pattern, t)


def lower_words(t):
    return text_words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, True, 1.0, "x", 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def table(request):
    return request.param, request.getfixturevalue(request.param)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def test_words_match_the_patterns():
    texts = [None, "", "  ", "a b", "éÉ  x\x0b\x0cy z", "A1-b_2 中|\x7f\x60\u0080", LONG]
    for table, pattern, lower in ((SPACED, r"[^\x20\x09-\x0D]+", False), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        got = Words(pa.array(texts, pa.string()), table, lower)
        for d, t in enumerate(texts):
            words = [got.data[got.start[i]:got.end[i]].tobytes().decode() for i in range(got.first[d], got.first[d + 1])]
            words = ["".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in w) for w in words]
            assert words == text_words(t, pattern, lower)
    a = Words(pa.array(["x y z x y z w", "Q x y z"]), SPACED, False)
    h = a.window_hash(3)
    assert h[0] == h[3] == h[8] and len(set(h.tolist())) == len(h) - 2


def expected_exact(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    group = {}
    for d, t in norm:
        group.setdefault(t, []).append(d)
    least = {t: min([d for d in v if d is not None], default=None) for t, v in group.items()}
    return Counter((d, least[t], len(group[t]), d == least[t], sha(t)) for d, t in norm)


@pytest.mark.parametrize("block, bits", [(4096, 64), (16, 64), (64, 3)])
def test_exact(table, block, bits):
    name, df = table
    if name == "small" and bits == 3:
        df = df.limit(40)
    got = exact.exact_dedup(df, block=block, hash_bits=bits).collect()
    assert as_counter(got) == expected_exact(rows_of(df))


def expected_lines(rows):
    places = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        for i, two in enumerate(zip(ls, ls[1:])):
            if re.search(r"[^\x09-\x0D\x20]", "".join(two)):
                places.setdefault(two, []).append((d is not None, d or 0, i))
    out = Counter()
    for d, t in rows:
        ls = (t or "").split("\n")
        gone = set()
        for i, two in enumerate(zip(ls, ls[1:])):
            if two in places and min(places[two]) != (d is not None, d or 0, i):
                gone |= {i, i + 1}
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out[(d, len(ls), len([i for i in gone if i - 1 not in gone]), len(gone), kept)] += 1
    return out


@pytest.mark.parametrize("bits", [64, 4])
def test_lines(spark, table, bits):
    name, df = table
    if name == "odd":
        block = "\n".join(f"shared line {i}" for i in range(40))
        df = df.unionByName(spark.createDataFrame(
            [(20 + i, f"head {i}\n{block}\ntail {i}", None, None, None, True, 1.0, "", 1) for i in range(3)], SCHEMA))
    expected = expected_lines(rows_of(df))
    assert as_counter(lines.line_dedup(df, hash_bits=bits).collect()) == expected
    if name == "odd":
        assert sum(k[3] for k in expected) > 40


def test_short_repeated_passages_go_whole(spark):
    """Passages of two lines or more that stand again anywhere, whatever is around them; single lines and blanks stay."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passages = [[f"{word()} {word()}" for _ in range(2 + k % 4)] for k in range(60)]
    rows, planted = [], {}
    for i in range(300):
        own = [[f"own {i} {word()}" for _ in range(rng.integers(1, 4))] for _ in range(2)]
        put = passages[i % 60]
        planted[i] = put if i >= 60 else []
        rows.append((i, "\n".join([*own[0], *put, "", "", *own[1], passages[(i + 1) % 60][0]])))
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in out.collect():
        kept = r.kept_text.split("\n")
        assert not set(planted[r.doc_id]) & set(kept[:-1]) and f"own {r.doc_id} " in r.kept_text
        assert r.n_removed_lines <= len(planted[r.doc_id]) + 1


def expected_substrings(rows, length):
    words = [(d, text_words(t)) for d, t in rows]
    count = Counter(tuple(w[i:i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = Counter()
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    return out


@pytest.mark.parametrize("length", [35, 5])
def test_substrings(table, length):
    _, df = table
    got = substrings.substring_dedup(df, length=length).collect()
    assert as_counter(got) == expected_substrings(rows_of(df), length)


def expected_hits(rows, items, window=10, coverage=1.0):
    places = {}
    for i, t in items:
        w = lower_words(t)
        n = min(window, max(1, math.ceil(coverage * len(w))))
        for j in range(len(w) - n + 1) if w else ():
            places.setdefault(tuple(w[j:j + n]), set()).add(str(i))
    out = Counter()
    for d, t in rows:
        w, hit, found = lower_words(t), set(), set()
        for n in {len(k) for k in places}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j:j + n])) in places:
                    hit.update(range(j, j + n))
                    found |= places[k]
        out[(d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))] += 1
    return out


@pytest.mark.parametrize("shard", [1_000_000, 100])
def test_decontaminate(spark, table, shard):
    name, df = table
    if name == "small":
        bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    else:
        bench = spark.createDataFrame(
            [(1, "one"), (1, "ONE"), (2, "w5x5 w6x6 w7x7"), (3, None), (4, ""), (5, "id text here"), (6, LONG[:300]), (7, LONG[20:200]),
             (8, "a b c d e f g h i j k a b c d e f g h i j k")], "item_id long, text string")
    if name == "empty":
        df = df.unionByName(spark.createDataFrame([(1, "a b c d e f g h i j. K!", *[None] * 7), (2, "a b c", *[None] * 7)], SCHEMA))
    result = decontaminate.decontaminate(df, bench, shard_words=shard)
    got = decontaminate.digest(result).drop("longest").collect()
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert as_counter(got) == expected_hits(rows_of(df), items)
    for r in result.join(df.select("doc_id", "text"), "doc_id").filter("size(hits) > 0").collect():
        n = sum(h.end - h.start for h in r.hits)
        assert len(lower_words(r.clean_text)) == len(lower_words(r.text)) - n


@pytest.mark.parametrize("coverage", [0.5, 0.25, 0.1])
@pytest.mark.parametrize("shard", [1_000_000, 60])
def test_coverage_limits(spark, coverage, shard):
    rng = np.random.default_rng(9)
    def text(n):
        return " ".join(rng.choice(list("abcde"), n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 8, 9, 12, 13, 16, 19, 20, 24, 30, 45, 60, 14, 15])]
    rows = [(i, f"{text(9)} . {items[i % 17][1][:22]} {text(7)}") for i in range(120)]
    bench, docs = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((items, "item_id"), (rows, "doc_id")))
    result = decontaminate.decontaminate(docs, bench, shard_words=shard, coverage=coverage, most_covered=0.9)
    assert as_counter(decontaminate.digest(result).drop("longest").collect()) == expected_hits(rows, items, coverage=coverage)
    for r in result.collect():
        n = sum(h.end - h.start for h in r.hits)
        assert r.covered == pytest.approx(n / r.n_words) and (r.clean_text is None) == (r.covered > 0.9)


def test_decontaminate_without_items(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.decontaminate(odd, bench)).filter("contaminated").isEmpty()


def expected_components(rows, percent=90, size=3):
    sets = []
    for d, t in rows:
        w = text_words(t, lower=True)
        sets.append((d, frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("block", [20_000, 20])
def test_jaccard(spark, table, block):
    name, df = table
    if name == "empty":     # chains and a large group of near copies
        rng = np.random.default_rng(5)
        base = [f"t{x}" for x in rng.integers(0, 5000, 150)]
        texts = []
        for _ in range(90):
            w = list(base)
            for x in rng.integers(0, 150, rng.integers(0, 4)):
                w[x] = f"u{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
        for i in range(12):
            base = base[2:] + [f"v{i}", f"x{i}"]
            texts.append(" ".join(base))
        texts += [" ".join(base[:n]) for n in range(1, 40)]
        df = spark.createDataFrame([(100 - i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)
    got = jaccard.jaccard_components(df, block=block).collect()
    assert as_counter(got) == expected_components(rows_of(df))


@pytest.mark.parametrize("percent,size", [(80, 5), (60, 3), (84, 4)])
@pytest.mark.parametrize("frequent", [64, 4])
def test_lower_thresholds(spark, small, monkeypatch, percent, size, frequent):
    """Cells of single elements, with passages that many documents share: no link is lost and none is added."""
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    rng = np.random.default_rng(6)
    passage = [f"p{x}" for x in range(60)]
    texts = [t for _, t in rows_of(small)[:80]] + [None, "", "a b", "a b c d e f"]
    for k in range(60):
        own = [f"t{x}" for x in rng.integers(0, 900, rng.integers(20, 120))]
        texts.append(" ".join(own[:10] + passage[:rng.integers(20, 61)] + own[10:]))
        for _ in range(2):
            w = texts[-1].split()
            for x in rng.integers(0, len(w), rng.integers(0, 5)):
                w[x] = f"u{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate(texts)], SCHEMA)
    got = jaccard.jaccard_components(df, size=size, percent=percent).collect()
    expected = expected_components(rows_of(df), percent, size)
    assert as_counter(got) == expected and len({comp for _, _, comp in expected}) < len(texts) - 40


def test_jaccard_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def test_secrets(spark, table):
    name, df = table
    if name == "odd":
        b64 = "cGFzc3dvcmQ9aHVudGVyMmh1bnRlcjI="                 # password=hunter2hunter2
        df = df.unionByName(spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate([
            "TOKEN = 'abcdefghijkl' api_key:short apikey=0123456789abcdef0", "é AKIAABCDEFGHIJKLMN AKIASHORT",
            "secret=token=abcdefghijklm", f"x {b64} y", "%70assword%3Dhunter2hunter2 z",
            "\\u0070assword=hunter2hunter2", "ſecret=abcdefghijklmnop"], 50)], SCHEMA))
    expected = Counter()
    for d, t in rows_of(df):
        t = t or ""
        spans = [("assign", 0, m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        spans += [("access", 1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", 2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        spans.sort(key=lambda x: (x[2], x[1]))
        expected[(d, *[sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(f"{k}:{s}:{e}" for k, _, s, e in spans)))] += 1
    out = secrets.digest(secrets.secret_scan(df))
    assert as_counter(out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == expected
    if name == "odd":
        spans = {r.doc_id: r.spans for r in out.collect()}
        assert spans[53] == "base64.assign:2:34" and "url.assign:0:27" in spans[54] and "unicode.assign:0:" in spans[55]


def test_secret_layers_end():
    import base64
    import gzip
    text = "token=abcdefghijklmnop"
    for _ in range(4):
        text = base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
    found = secrets.scan(f"go {text} end")
    assert [(k.count("gzip"), s, e) for k, s, e, _ in found if k.endswith("assign")] == [(4, 3, 3 + len(text))]
    bomb = base64.b64encode(gzip.compress(b"a" * (secrets.MOST_INFLATED + 10))).decode()
    assert [k for k, *_ in secrets.scan(bomb) if "bomb" in k] == ["base64.bomb"]


def test_licenses(spark, table):
    name, df = table
    if name == "odd":
        df = df.unionByName(spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate([
            "The MIT-License, mit license; GNU General\nPublic  LICENSE", "cc by cc by-nc",
            "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT y",
            "SPDX-License-Identifier: GPL-3.0 AND MIT", "gnu lesser general public license"], 60)], SCHEMA))
    expected = Counter()
    for d, t in rows_of(df):
        w = lower_words(t)
        places = [(j, v) for k, v in licenses.PHRASES.items() for p in [k.split()]
                  for j in range(len(w) - len(p) + 1) if w[j:j + len(p)] == p]
        at = [p[0] for p in places]
        expected[(d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places})))] += 1
    out = licenses.digest(licenses.license_scan(df))
    assert as_counter(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == expected
    assert out.filter("score < 0 OR score > 1").isEmpty()
    if name == "odd":
        labels = {r.doc_id: r.labels for r in out.collect()}
        assert "expr:allowed" in labels[62] and "expr:restricted" in labels[63] and "spdx:MIT" in labels[62]


def test_expressions():
    order, names = licenses.postfix("MIT OR (GPL-2.0 AND Zlib) WITH foo trailing words")
    assert order == ["MIT", "GPL-2.0", "Zlib", "AND", "foo", "WITH", "OR"] or [x.lower() for x in order] == [
        "mit", "gpl-2.0", "zlib", "and", "foo", "with", "or"]
    assert names[0] == "MIT" and licenses.allowed(order, frozenset({"mit"}))
    assert licenses.postfix(") MIT") == ([], []) and licenses.postfix("") == ([], [])
    assert licenses.postfix("(MIT") == ([], [])


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Q.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    model = language.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 10)) and got[6].lang_pred != "und"
    assert language.identify(empty, model).count() == 0
    unlearned = language.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, unlearned).collect()} == {"und"}
    parts = {k: docs.filter((F.col("lang") == k) & (F.length("text") > 900)).select("text").first()[0][:800] for k in ("en", "de")}
    mixed = spark.createDataFrame([(1, parts["en"] + " " + parts["de"])], "doc_id long, text string")
    assert [s.lang for s in language.identify(mixed, model).first().spans] == ["en", "de"]


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores = np.log(rng.dirichlet(np.ones(3) * 0.5, 40))
        path = language.viterbi(scores, np.zeros(3), 2.0)

        def value(p):
            return scores[np.arange(len(p)), p].sum() - 2.0 * (np.diff(p) != 0).sum()
        best = np.full(3, 0.0)
        best = scores[0].copy()
        for t in range(1, 40):
            best = np.array([max(best[j] - 2.0 * (j != k) for j in range(3)) for k in range(3)]) + scores[t]
        assert abs(value(path) - best.max()) < 1e-9


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    common = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [common[j] for j in rng.integers(0, 300, 60)]
        bad = i % 5 == 0
        for j in rng.integers(0, 60, 4) if bad else ():
            w[j] = ("scoundrel", "rotter", "cad")[rng.integers(0, 3)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = {r.doc_id: r.score for r in toxicity.toxicity(d, model).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    good = sum((out[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert good / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, model).collect())
    assert toxicity.toxicity(empty, model).count() == 0
    none = toxicity.fit(d, lab.filter("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.toxicity(d, none).collect()} == {0.0}


def mix_words(t):
    return re.findall(r"[^\x00-\x60\x7B-\x7F]+", (t or "").lower())


def expected_rates(p, t, goal, steps):
    r = np.ones(len(t))
    for g in steps:
        r = np.maximum(0, r + p @ np.array(g))
    return r


def test_mixture(spark, small, odd, empty):
    labels = Q.domains(spark.read.parquet(f"{SMALL}/labels.parquet"))
    model = mixing.fit(small, labels, Q.TARGETS)
    out = mixing.apply(small, model).collect()
    p, t = np.array([r.mix_posterior for r in out]), np.array([r.mix_tokens for r in out], float)
    assert np.allclose(p.sum(axis=1), 1) and all(r.mix_tokens == len(mix_words(r.text)) for r in out)
    rate = np.array([r.mix_rate for r in out])
    assert (rate >= 0).all() and np.allclose(rate, expected_rates(p, t, None, model.steps))
    goal = np.array([Q.TARGETS[k] for k in model.domains])
    assert np.abs((rate * t) @ p / t.sum() - goal / goal.sum()).max() == pytest.approx(model.residual, abs=1e-6)
    assert model.residual < 1e-3
    assert all(abs(r.mix_copies - r.mix_rate) < 1 for r in out)
    # Posteriors by hand, from presence of the listed words.
    for r in out[:40]:
        have = set(mix_words(r.text)) | set(re.findall(r"[!-/:-@\[-`{-~]+", r.text or ""))
        score = np.array(model.bias) + sum((np.array(v) for w, v in model.weights.items() if w in have), np.zeros(len(p[0])))
        e = np.exp(score - score.max())
        assert np.allclose(e / e.sum(), r.mix_posterior, atol=1e-9)
    assert mixing.apply(odd, model).count() == len(ROWS) and mixing.apply(empty, model).count() == 0
    assert mixing.apply(odd, model).columns[:9] == odd.columns
    unlearned = mixing.fit(empty, labels.limit(0), Q.TARGETS)
    assert {r.mix_rate for r in mixing.apply(odd, unlearned).collect()} == {1.0}
    assert mixing.fit(empty, labels, Q.TARGETS) is not None


def test_mixture_cuts_rates_at_zero(spark):
    docs = spark.createDataFrame([(i, ("apple pear " if i % 4 else "nail bolt ") * 5) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "fruit" if i % 4 else "iron") for i in range(100)], "doc_id long, domain string")
    model = mixing.fit(docs, labels, {"iron": 1.0})
    out = mixing.apply(docs, model).collect()
    assert min(r.mix_rate for r in out) == 0 or model.residual < 1e-3
    assert all(r.mix_rate >= 0 for r in out)
    assert sum(r.mix_rate * r.mix_tokens for r in out if r.doc_id % 4 == 0) > 0.95 * sum(r.mix_rate * r.mix_tokens for r in out)


def test_jaccard_forests():
    x, y = np.array([7, 7, 5, 7, 3]), np.array([5, 5, 3, 3, 9])        # best edges first; 7-5 twice
    assert jaccard._forests(x, y, 1).tolist() == [True, False, True, False, True]
    assert jaccard._forests(x, y, 2).tolist() == [True, True, True, True, True]
    assert jaccard._forests(x[:0], y[:0], 8).tolist() == []


def test_jaccard_forest_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.integers(-20, 20, (2, 60))
        keep = jaccard._forest(x, y)

        def labels(places):
            label = {n: n for n in np.concatenate([x, y]).tolist()}
            for p in places:
                a, b = label[int(x[p])], label[int(y[p])]
                label = {n: a if v == b else v for n, v in label.items()}
            return label
        full, part = labels(range(len(x))), labels(keep)
        assert len(set(full.values())) == len(set(part.values()))
        assert len(keep) == len(full) - len(set(full.values()))          # no edge too many


@pytest.mark.parametrize("comps,pairs", [([-5, -5], 0), ([-5, 3], 1), ([4, 4], 0)])
def test_jaccard_search_leaves_out_pairs_within_a_component(comps, pairs):
    point = jaccard.point(np.arange(40, dtype=np.uint64) << np.uint64(56)).astype(np.int32)
    bucket = pa.table({"key": [1, 1], "i": [0, 0], "j": [0, 0], "block": [0, 0], "m": [11, -12], "n": [40, 40],
                       "comp": comps, "point": [point, point]})
    for forests, most in ((1, 0), (0, 2)):
        assert jaccard._search(90, forests, most)(bucket).num_rows == pairs
