"""Lexical search, spelling variants and personal data against brute force, on small tables and on awkward rows."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import pii, search, spelling
from tests.llm.test_operators import SMALL, ROWS, SCHEMA, rows_of, sha

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, True, 1.0, "x", 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# Ranked lexical search.

def expected_ranks(docs, items, k=10):
    bags = [(d, Counter(TERMS.findall(ascii_lower(t or "")))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (d, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for t in set(TERMS.findall(ascii_lower(text or ""))):
                if bag[t]:
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block,seeds,shard_terms", [(1024, 4, 2_000_000), (3, 1, 150), (2, 0, 2_000_000)])
def test_search(spark, small, block, seeds, shard_terms):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = search.search(small, items, block=block, seeds=seeds, shard_terms=shard_terms)
    expected = expected_ranks(rows_of(small), [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, got.collect())) == expected


def test_search_of_awkward_rows(spark, odd, empty):
    asked = [(1, "one two"), (1, "w0x0 w1x1 tail TAIL"), (2, None), (None, "null id text"), (3, " .,"), (4, "absent"), (5, "été 中文")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    got = search.search(odd, items, block=2)
    assert Counter(map(tuple, got.collect())) == expected_ranks(rows_of(odd), asked)
    assert search.search(empty, items).count() == 0 and search.search(odd, items.limit(0)).count() == 0
    assert search.search(odd, items.filter("item_id = 4")).count() == 0


def test_search_keeps_ties_in_the_order_of_ids(spark):
    docs = spark.createDataFrame([(i % 400, "same words here") for i in range(900)] + [(1000 + i, f"other {i}") for i in range(900)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(0, "words")], "item_id long, text string")
    got = [(r["rank"], r.doc_id) for r in search.search(docs, items, k=7, block=50).orderBy("rank").collect()]
    assert got == list(enumerate([0, 0, 0, 1, 1, 1, 2], 1))


def test_blocks_hold_one_normaliser_each(spark):
    rows = spark.createDataFrame([(i, (i * i) % 5, [i % 3, 5], [1 + i % 2, 1]) for i in range(300)],
                                 "id long, m long, terms array<int>, tfs array<int>")
    blocks = search.index_blocks(rows, block=16).collect()
    assert max(len(b.docs) for b in blocks) <= 16 and sorted(d for b in blocks for d in b.docs) == list(range(300))
    for b in blocks:
        assert {(d * d) % 5 for d in b.docs} == {b.m} and b.docs == sorted(b.docs)
        groups = list(zip(b.group_term, b.group_tf, strict=True))
        assert groups == sorted(set(groups)) and sum(b.group_size) == len(b.places) == 2 * len(b.docs)


# Spelling variants.

def expected_words(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def expected_variants(docs):
    n = expected_words(docs)
    letters = sorted({c for w in n for c in w})
    out, form = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in edits - {w} if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, n[w], out[w], form[w], form[w] and n[form[w]], root(w)) for w in n}


def variants(docs, **more):
    return {tuple(r) for r in spelling.spelling_variants(docs, **more).select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("shard_words,pass_bytes", [(1 << 16, 1 << 27), (50, 1 << 10)])
def test_variants(small, monkeypatch, shard_words, pass_bytes):
    monkeypatch.setattr(spelling, "PASS_BYTES", pass_bytes)
    expected = expected_variants(rows_of(small))
    assert any(form for _, _, _, form, _, _ in expected) and variants(small, shard_words=shard_words) == expected


def test_variants_of_awkward_rows(spark, odd, empty):
    assert variants(odd) == expected_variants(rows_of(odd)) and variants(empty) == set()
    words = ["abcdefgh"] * 3000 + ["abcdefg"] * 250 + ["abcdefgx"] * 22 + ["bbcdefgx"] * 2 + ["aaaaaaaa"] * 5 + ["aaaaaaaaa"] * 4 + ["ÉÉcoleÿÿ"] * 60
    words += ["éÉcoleÿÿ"] * 3 + ["ÀÖØ×÷ÿöx"] * 2 + ["z" * 3000] * 2 + ["z" * 2999 + "y"] * 2
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, f"{w} 1{w.upper() if w.isascii() else w}-{w}ā") for i, w in enumerate(words)],
                                 "doc_id long, text string")
    expected = expected_variants(rows_of(docs))
    assert variants(docs) == expected
    assert {r for w, *_, r in expected if w == "bbcdefgx"} == {"abcdefgh"}


def test_crc_and_words_of_a_batch():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 7, 47, 48, 49, 200, 5000, 7]]
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    first = np.r_[0, np.cumsum([len(w) for w in words])]
    got = spelling._crcs(prefix, np.frombuffer(b"".join(words), np.uint8), first)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_bloom_has_every_key_and_few_others():
    rng = np.random.default_rng(2)
    keys, others = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (50_000, 400_000))
    blocks = spelling.bloom(keys)
    filters = {8: (blocks, np.array([0]), np.array([len(blocks)]))}
    assert len(spelling._probe(filters, 8, keys)) == len(keys)
    assert len(spelling._probe(filters, 8, others)) < 0.005 * len(others)


# Personal data.

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def expected_base(t):
    found = [("email", m) for m in EMAIL.finditer(t)] + [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda x: (x[1], pii.KINDS.index(x[0])))


ODD_TEXTS = [
    None, "", "a@b.c", "a@b", "x a@b.c%d@e.f@g.h", "..@a.b-.c.", "\U0001f600é me@host.example.com. é", "a.b@c..d", "%@-.-", "@a.b", "é@é.com é.x@y.zé",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "001.002.003.004", "9999999.1.1.1", "v1.2.3", "1.2.3.4\n5.6.7.8",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000000000000000", "12 34 56 78 90 12 34", "1", "1-", "-1 2-3 4",
    "+1 (487) 555-7209", "+1", "+1 2", "+49.30.1234567-", "++4930123456 +", "+1 " + " " * 50, "+12345678901234567890", "+1234567 8 9 (0).",
    "call tel +1 (487) 555-7209 or me@x.org, 10.0.0.1", "key 4111111111111111 4111111111111111,4111111111111111",
    "Phone: (487) 555-7209", "me (at) host (dot) com", "ssn 123-45-6789", "GB82 WEST 1234 5698 7654 32", "2001:0db8:0000:0000:0000:ff00:0042:8329",
]


def spans_of(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in df.collect()}


def test_base_spans(spark, small, odd, empty):
    for docs in (small, spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")):
        expected = {d: expected_base(t or "") for d, t in rows_of(docs)}
        found = spans_of(pii.personal_data(docs))
        assert {d: [s for s in spans if s[0] in pii.KINDS] for d, spans in found.items()} == expected
        digested = {r.doc_id: r for r in pii.digest(pii.personal_data(docs)).collect()}
        for d, spans in expected.items():
            r = digested[d]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
            assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    assert Counter(d for d, in pii.personal_data(odd).select("doc_id").collect()) == Counter(d for d, _ in rows_of(odd))
    assert pii.personal_data(empty).count() == 0


def test_long_texts_take_one_pass(spark):
    n = 1_000_000
    texts = ["a" * n, "a" * n + "@b.c1", "1" * n, "1." * (n // 2), "1 2-" * (n // 4), "a.b@c" + ".d" * (n // 2), "+1" + " " * n, "me@x.org 1.2.3.4 " * 3000, "A" * n + " dot "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = spans_of(pii.personal_data(docs))
    assert time.time() - began < 90
    assert found[7] == expected_base(texts[7]) and found[5] == expected_base(texts[5]) and found[0] == []


def test_labelers_and_classifier_tell_candidates_apart(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        a, b, c = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999)
        rows.append((3 * i, f"please call ({a}) {b}-{c} or mail u{i}@host{i % 9}.example.com today"))
        rows.append((3 * i + 1, f"part order ref {a}.{b}.{c}/x and text"))
        rows.append((3 * i + 2, "nothing of that kind stands here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spans_of(pii.personal_data(docs))
    calls = [any(k == "phone_local" for k, _, _ in found[3 * i]) for i in range(600)]
    parts = [bool(found[3 * i + 1]) for i in range(600)]
    assert np.mean(calls) > 0.95 and np.mean(parts) < 0.05 and not any(found[3 * i + 2] for i in range(600))


def test_expectation_maximisation_against_numpy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(
        [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    counts = pii.patterns(pii.labelled(docs))
    rows = [(r.kind, r.votes, r.c) for r in counts.collect()]
    kinds, votes = dict.fromkeys((*pii.KINDS, *pii.EXTRA), 0.0), np.array([[0, -1, 1.0]] * len(pii.LABELERS))
    for _ in range(pii.ROUNDS):
        p = [1 / (1 + math.exp(-(kinds[k] + sum(votes[j, v] for j, v in enumerate(vs))))) for k, vs, _ in rows]
        masses = []
        for sign, prior in ((1, (1, 2, 8)), (0, (1, 8, 2))):
            mass = np.array([prior] * len(pii.LABELERS), float)
            for (_, vs, c), q in zip(rows, p, strict=True):
                for j, v in enumerate(vs):
                    mass[j, v] += c * (q if sign else 1 - q)
            masses.append(np.log(mass / mass.sum(axis=1, keepdims=True)))
        votes = masses[0] - masses[1]
        kinds = {k: math.log(1 + sum(c * q for (x, _, c), q in zip(rows, p, strict=True) if x == k))
                 - math.log(1 + sum(c * (1 - q) for (x, _, c), q in zip(rows, p, strict=True) if x == k)) for k in kinds}
    got = pii.reliabilities(counts)
    assert np.allclose(got.votes, votes) and all(math.isclose(got.kinds[k], kinds[k], abs_tol=1e-9) for k in kinds)


def test_no_python_in_the_plan_of_personal_data(spark, small):
    df = pii.digest(pii.personal_data(small))
    plan = df._jdf.queryExecution().toString() + pii.labelled(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_extra_columns_and_struct_ids(spark, small):
    docs = small.select(F.struct(F.col("doc_id").alias("my col"), F.col("lang").alias("a.b")).alias("row"), "text")
    assert pii.personal_data(docs, id_col="row").select("row.*").columns == ["my col", "a.b"]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert search.search(docs, items, id_col="row").select("row.*").columns == ["my col", "a.b"]
