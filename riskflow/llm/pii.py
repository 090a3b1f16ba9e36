"""Personal data by weak supervision (DataFrame functions only).

1. Patterns give candidate spans: the base kinds, which always stay once their check holds, and looser kinds.
2. Six labelers vote on each candidate (yes, no, or nothing): its form, the signs at its edges, a gazetteer
   (top-level domains, calling codes, card ranges, reserved networks), cue words before it, personal data close
   by, and whether it overlaps another.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and with that
   the probability that a candidate is personal data.
4. These probabilities train the final classifier, which sees other things than the votes: length, neighbouring
   signs, the word before, shape and first sign. It is log-linear with one weight a feature value, fitted in one
   aggregate. A candidate of a looser kind becomes a span where it gives 0.5 or more.

Only ids and candidates are written, never texts. The tables that reach the driver have a row for a vote pattern
or a feature value, whatever the size of the corpus. Places come from the lengths of the pieces between the matches,
summed by doubling, so a text of very many matches takes n log n. Patterns use possessive quantifiers and start
where no match can run into them from the left, so a text is read once for each pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize

# Base kinds in their order, with their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser kinds.
EXTRA = ("email_spelled", "phone_local", "ssn", "iban", "ipv6", "card_unchecked")
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?", r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?"
SPELLED = rf"(?i)(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++{_AT}[A-Z0-9-]++(?:{_DOT}[A-Z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+().-])(?<![0-9+)][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
# The gazetteer.
TLDS = ("com org net edu gov mil int info biz io co me app dev uk de fr es it nl eu us ca au nz jp cn in br mx ar ru ua ch at be "
        "se no dk fi pl pt cz sk hu ro gr ie il tr za kr sg hk").split()
CALLING = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
           "90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 "
           "852 855 886 960 961 962 963 964 965 966 971 972 973 974").split()
RESERVED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CARD_RANGES = r"^(?:4|5[0-9]|2[2-7]|3[04-8]|6[0-9])"
CUES = (r"(?i)\b(?:e-?mail|mail|contact|write|reach|call|tel|phone|telephone|mobile|cell|fax|whatsapp|ring|card|credit|visa|"
        r"mastercard|amex|cc|ip|address|ssn|social|security|iban|account|konto|kontakt|telefon|courriel|adresse|correo|"
        r"tel[eé]fono|carte|tarjeta|karte)\b[^A-Za-z]*$")
COUNTER_CUES = r"(?i)\b(?:version|ver|release|order|invoice|ref|reference|id|isbn|issn|sku|serial|part|total|price|sum|build|page|section)\b[^A-Za-z]*$"

LABELERS = ("form", "edges", "gazetteer", "cue", "close", "alone")
ABSTAINS, NO, YES = 0, 1, 2
_CONTEXT, _AFTER, _CLOSE = 40, 8, 200
ROUNDS = 12
#: Features of the final classifier, each with this many values.
FEATURES, VALUES = ("length", "left", "right", "word", "shape", "first"), 64


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Running totals of an array, by doubling."""
    steps = F.when(F.size(sizes) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, sizes, lambda sums, k: _let(F.pow(F.lit(2), k).cast("int"), lambda d: F.transform(
        sums, lambda x, i: x + F.when(i >= d, F.get(sums, i - d)).otherwise(0))))


def _found(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """array<kind, start, end, m, left, right> of the matches; left and right: what stands beside it, short."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,m:string,left:string,right:string>>")

    def spans(pieces: Column, ms: Column) -> Column:
        ends = _running(F.transform(ms, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long")))
        return _let(ends, lambda e: F.transform(ms, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("m"),
            F.right(F.get(pieces, i), F.lit(_CONTEXT)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(_AFTER)).alias("right"))))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, _let(matches, lambda ms: F.when(F.size(ms) > 0, _let(F.split(text, pattern, -1), lambda ps: spans(ps, ms)))
                              .otherwise(none))).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: _let(
        F.substr(F.reverse(d), i, F.lit(1)).cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    """Whether the check digits of an IBAN hold."""
    bare = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    numbers = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: _let(
        F.ascii(F.substr(turned, i, F.lit(1))), lambda c: F.when(c < 65, c - 48).otherwise(c - 55)))
    return F.aggregate(numbers, F.lit(0), lambda a, x: (F.when(x > 9, a * 100 + x).otherwise(a * 10 + x)) % 97) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def candidates(text: Column) -> Column:
    """array<kind, start, end, m, left, right> of a text, by start, then kind; matches of a base kind that fail its
    check are left out, but cards of a right length stay as ``card_unchecked``."""
    number = text.rlike("[0-9]")
    size = F.length  # of the matches below, in code points
    email = _found(text, "email", EMAIL, text.contains("@"))
    ip = F.filter(_found(text, "ip", IP, number), lambda x: x["m"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    card = F.filter(_found(text, "card", CARD, number), lambda x: (size(x["m"]) >= 12) & (size(x["m"]) <= 37)
                    & size(digits(x["m"])).between(12, 19))
    card = F.transform(card, lambda x: x.withField("kind", F.when(luhn(digits(x["m"])), "card").otherwise("card_unchecked")))
    phone = F.filter(_found(text, "phone", PHONE, text.contains("+")), lambda x: size(digits(x["m"])).between(9, 15))
    loose = [_found(text, "email_spelled", SPELLED, text.rlike("(?i)[^a-z]dot[^a-z]")),
             _found(text, "phone_local", LOCAL_PHONE, number), _found(text, "ssn", SSN, number & text.contains("-")),
             _found(text, "iban", IBAN, number), _found(text, "ipv6", IPV6, text.contains(":"))]
    order = F.array(*[F.lit(k) for k in (*KINDS, *EXTRA)])
    listed = F.transform(F.concat(email, ip, card, phone, *loose), lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).cast("int").alias("rank"), x["end"].alias("end"),
        x["kind"].alias("kind"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    return F.array_sort(listed)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAINS)


def _votes(x: Column, before: Column, after: Column) -> Column:
    kind, m, d = x["kind"], x["m"], digits(x["m"])
    is_a = lambda *ks: kind.isin(*ks)
    sound = (F.when(is_a("email"), m.rlike(r"^[A-Za-z0-9](?!.*\.\.).*\.[A-Za-z]{2,}$"))
             .when(is_a("ip"), ~m.rlike(r"(?:^|\.)0[0-9]")).when(is_a("card", "card_unchecked"), luhn(d) & ~d.rlike(r"^([0-9])\1+$"))
             .when(is_a("phone", "phone_local"), F.length(d).between(10, 13)).when(is_a("ssn"), ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
             .when(is_a("iban"), _mod97(m)).otherwise(F.lit(True)))
    glued = x["left"].rlike(r"[A-Za-z0-9_/=#]$") | x["right"].rlike(r"^(?:[A-Za-z0-9_/=]|\.[0-9])")
    tld = F.lower(F.regexp_extract(F.right(m, F.lit(_CONTEXT)), r"([A-Za-z]+)\W*$", 1))
    listed = (F.when(is_a("email", "email_spelled"), tld.isin(*TLDS)).when(is_a("ip"), ~m.rlike(RESERVED))
              .when(is_a("card", "card_unchecked"), d.rlike(CARD_RANGES))
              .when(is_a("phone"), F.left(d, F.lit(1)).isin(*CALLING) | F.left(d, F.lit(2)).isin(*CALLING) | F.left(d, F.lit(3)).isin(*CALLING)))
    near = lambda y, gap: F.coalesce((y["kind"] != kind) & gap.between(0, _CLOSE), F.lit(False))
    close = near(before, x["start"] - before["end"]) | near(after, after["start"] - x["end"])
    over = F.coalesce(before["end"] > x["start"], F.lit(False)) | F.coalesce(after["start"] < x["end"], F.lit(False))
    return F.array(_vote(sound, ~sound), _vote(F.lit(False), glued), _vote(listed, ~listed),
                   _vote(x["left"].rlike(CUES), x["left"].rlike(COUNTER_CUES)), _vote(close, F.lit(False)), _vote(F.lit(False), over))


def _class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike("^[a-z]$"), 3)
            .when(c.rlike("^[A-Z]$"), 4).when(c.rlike(r"^[\x21-\x7E]$"), F.ascii(c) % 50 + 5).otherwise(60))


def _features(x: Column) -> Column:
    """A value below ``VALUES`` of each feature."""
    word = F.lower(F.regexp_extract(x["left"], r"([A-Za-zÀ-ɏ]+)[^A-Za-zÀ-ɏ]*$", 1))
    shape = F.regexp_replace(F.regexp_replace(x["m"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(VALUES)).cast("int")
    return F.array(F.least(F.length(x["m"]), F.lit(VALUES - 1)), _class(F.right(x["left"], F.lit(1))),
                   _class(F.left(x["right"], F.lit(1))), bucket(word), bucket(shape), _class(F.left(x["m"], F.lit(1))))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cands): each row's candidates as array<kind, start, end, votes, features>, written to the shared folder."""
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", candidates(F.col("t")).alias("found"))
    cands = F.transform("found", lambda x, i: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        _votes(x, F.get("found", i - 1), F.get("found", i + 1)).alias("votes"), _features(x).alias("features")))
    return materialize(found.select("id", F.when(F.size("found") > 0, cands).otherwise(F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,features:array<int>>>")).alias("cands")), "op13-candidates")


@dataclass
class Reliability:
    """Log-odds that EM ends with: of each kind, and of each vote (abstention, no, yes) of each labeler."""
    kinds: dict[str, float]
    votes: list[list[float]]

    def log_odds(self, kind: Column, votes: Column) -> Column:
        prior = F.create_map(*[F.lit(v) for pair in self.kinds.items() for v in pair])
        table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in self.votes])
        return sum((F.get(F.get(table, F.lit(k)), F.get(votes, F.lit(k))) for k in range(len(self.votes))), F.element_at(prior, kind))


def patterns(rows: DataFrame) -> DataFrame:
    """(kind, votes, c): how many candidates got each pattern of votes; at most 3 ** labelers rows a kind."""
    one = rows.select(F.explode("cands").alias("x")).select("x.kind", "x.votes")
    return materialize(one.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("c")), "op13-patterns")


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over (kind, votes, c): candidates are personal data or not, labelers vote independently.

    The first expectation is the balance of the votes. Pseudo-counts hold the two classes apart: a labeler is taken
    to be right four times of five until the votes say otherwise."""
    kinds = (*KINDS, *EXTRA)
    model = Reliability(dict.fromkeys(kinds, 0.0), [[0.0, -1.0, 1.0] for _ in LABELERS])
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.log_odds(F.col("kind"), F.col("votes"))))
        rows = counts.select("kind", "votes", (p * F.col("c")).alias("y"), ((1 - p) * F.col("c")).alias("n"))
        parts = [F.coalesce(F.sum(F.when(cond, F.col(side))), F.lit(0.0)) for cond in
                 [*(F.get("votes", F.lit(k)) == v for k in range(len(LABELERS)) for v in (ABSTAINS, NO, YES)), *(F.col("kind") == k for k in kinds)]
                 for side in ("y", "n")]
        got = list(rows.agg(*[e.alias(f"s{i}") for i, e in enumerate(parts)]).first())
        for k in range(len(LABELERS)):
            y, n = got[6 * k:6 * k + 6:2], got[6 * k + 1:6 * k + 6:2]
            y, n = [a + b for a, b in zip(y, (1.0, 2.0, 8.0), strict=True)], [a + b for a, b in zip(n, (1.0, 8.0, 2.0), strict=True)]
            model.votes[k] = [log(a / sum(y)) - log(b / sum(n)) for a, b in zip(y, n, strict=True)]
        at = 6 * len(LABELERS)
        model.kinds = {k: log(got[at + 2 * i] + 1) - log(got[at + 2 * i + 1] + 1) for i, k in enumerate(kinds)}
    return model


@dataclass
class Classifier:
    """Log-odds of each kind and of each value of each feature."""
    kinds: dict[str, float]
    weights: list[float]

    def probability(self, x: Column) -> Column:
        prior = F.create_map(*[F.lit(v) for pair in self.kinds.items() for v in pair])
        table = F.array(*[F.lit(v) for v in self.weights])
        total = F.aggregate(F.transform(x["features"], lambda v, i: F.get(table, i * VALUES + v)), F.element_at(prior, x["kind"]), lambda a, w: a + w)
        return 1 / (1 + F.exp(-total))


def train(rows: DataFrame, model: Reliability) -> Classifier:
    """The final classifier, from all candidates weighted by the probabilities of ``model``; one aggregate."""
    soft = rows.select(F.explode("cands").alias("x")).select(
        "x.kind", "x.features", (1 / (1 + F.exp(-model.log_odds(F.col("x.kind"), F.col("x.votes"))))).alias("p"))
    seen = soft.select("kind", "p", F.posexplode(F.concat("features", F.array(F.lit(-1)))).alias("f", "v"))
    sums = seen.groupBy(F.when(F.col("v") < 0, F.col("kind")).alias("kind"), F.when(F.col("v") >= 0, F.col("f") * VALUES + F.col("v")).alias("at")).agg(
        F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n")).collect()       # a row a kind and a feature value
    kinds = {k: 0.0 for k in (*KINDS, *EXTRA)} | {r.kind: log(r.y + 1) - log(r.n + 1) for r in sums if r.kind is not None}
    yes, no = (sum(getattr(r, s) for r in sums if r.kind is not None) + VALUES for s in "yn")
    weights = [0.0] * (len(FEATURES) * VALUES)
    for r in sums:
        if r.kind is None:
            weights[r.at] = log((r.y + 1) / yes) - log((r.n + 1) / no)
    return Classifier(kinds, weights)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (array<kind, start, end, probability>) by start, then kind.

    Null counts as empty and has no spans; repeated rows are read each for itself, and each counts in the estimates; an
    empty table gives an empty result; further columns are not read. Base spans stay whatever their probability."""
    rows = labelled(docs, id_col, text_col)
    final = train(rows, reliabilities(patterns(rows)))
    scored = F.transform("cands", lambda x: F.struct(x["kind"], x["start"], x["end"], final.probability(x).alias("probability")))
    kept = F.filter(scored, lambda s: s["kind"].isin(*KINDS) | (s["probability"] >= 0.5))
    return rows.select(F.col("id").alias(id_col), kept.alias("spans"))


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (joined), n_added (spans of looser kinds)."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return result.select(id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(of(*KINDS)), 256).alias("base_sha256"),
                         joined("spans").alias("spans"), F.size(of(*EXTRA)).cast("long").alias("n_added"))
