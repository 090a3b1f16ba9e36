"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in the whole
text, and a shunting-yard parser evaluates the licence expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further phrases of this operator, and the tag that precedes a licence expression.
MORE_PHRASES = {"mozilla public license": "mpl", "gnu lesser general public license": "lgpl", "bsd license": "bsd",
                "all rights reserved": "reserved", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
                "gnu affero general public license": "agpl", "public domain": "public-domain", "cc0": "cc0"}
TAG = "spdx license identifier"
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "CC0-1.0", "CC-BY-4.0", "Unlicense")

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_TAG_TEXT = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def postfix(text: str) -> tuple[list[str], list[str]]:
    """Shunting-yard: the longest leading licence expression of ``text`` in postfix order, and its identifiers.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; all are left-associative and any case.
    Reading ends where an operand is missing or two operands meet, or at an unmatched bracket."""
    out: list[str] = []
    stack: list[str] = []
    good: tuple[list[str], list[str]] = ([], [])
    at, operand, depth = 0, True, 0
    while m := _TOKEN.match(text, at):
        token, word = m[1], m[1].lower()
        if operand:
            if token == "(":
                stack.append(token)
                depth += 1
            elif token == ")" or word in _PRECEDENCE:
                break
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
        at = m.end()
        if not operand and not depth:
            good = (out + stack[::-1], [x for x in out if x not in _PRECEDENCE])
    return good


def allowed(order: list[str], accept: frozenset[str]) -> bool:
    """Evaluate a postfix expression: an identifier holds if accepted; an exception (``with``) keeps its licence."""
    stack: list[bool] = []
    for token in order:
        if token in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a and b if token == "and" else a or b)
        else:
            stack.append(token.lower() in accept)
    return stack[-1]


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        found.add_word(f" {phrase} ", (label, len(phrase) + 1))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton, accept: frozenset[str]) -> tuple:
    """(n_words, matches [(label, first word, words)], expressions [(identifiers, allowed)]) of one text.

    The text is lower-cased (A-Z), every byte that is no word byte becomes a space; UTF-8 bytes are matched as
    Latin-1 characters, one each, so that no word is changed."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    plain = f" {b' '.join(words).decode('latin-1')} "
    matches, tagged, at, word = [], False, 0, 0
    for end, (label, size) in machine.iter(plain):
        start = end - size
        if label == TAG:
            tagged = True
            continue
        # Matches come by their end, so a longer one may start before the last: count from the text then.
        word = word + plain.count(" ", at, start) if start >= at else plain.count(" ", 0, start)
        at = start
        matches.append((label, word, plain.count(" ", start + 1, end + 1)))
    expressions = []
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            order, names = postfix(m[1])
            if order:
                expressions.append((names, allowed(order, accept)))
    return len(words), matches, expressions


_SCHEMA = ("id {}, n_words long, matches array<struct<label:string,word:long,words:long,base:boolean>>, "
           "expressions array<struct<ids:array<string>,allowed:boolean>>")
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("base", pa.bool_())]))
_EXPRESSIONS = pa.list_(pa.struct([("ids", pa.list_(pa.string())), ("allowed", pa.bool_())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
                 more: dict[str, str] | None = None, accept: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """One row per input row: id, n_words, matches (label, first word, words, base) by position, expressions.

    ``base`` marks the places of ``phrases``; ``more`` are further notices. Null counts as empty: no words, no
    matches. Repeated rows are scanned each for itself; an empty table gives an empty result."""
    base, more = PHRASES if phrases is None else phrases, MORE_PHRASES if more is None else more
    accepted = frozenset(x.lower() for x in accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton({**{p: (label, False) for p, label in more.items()},
                             **{p: (label, True) for p, label in base.items()}, TAG: TAG})
        for batch in batches:
            rows = [scan(t.as_py(), machine, accepted) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"label": lab, "word": w, "words": n, "base": b} for (lab, b), w, n in
                           sorted(r[1], key=lambda x: (x[1], x[2]))] for r in rows], _MATCHES),
                pa.array([[{"ids": i, "allowed": a} for i, a in r[2]] for r in rows], _EXPRESSIONS),
            ], names=["id", "n_words", "matches", "expressions"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA.format(id_type))
    return out.withColumnRenamed("id", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels of expressions are ``spdx:<identifier>`` and ``expr:allowed`` or ``expr:restricted``. The score is
    n / (n + 1) over all places and expressions: 0 without any, rising to 1."""
    base = F.filter("matches", lambda m: m["base"])
    spdx = F.flatten(F.transform("expressions", lambda e: F.array_append(
        F.transform(e["ids"], lambda i: F.concat(F.lit("spdx:"), i)),
        F.when(e["allowed"], "expr:allowed").otherwise("expr:restricted"))))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("matches", lambda m: m["label"]), spdx)))
    n = F.size("matches") + F.size("expressions")
    return result.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["word"])).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"])))).alias("base_labels"),
        F.concat_ws(",", every).alias("labels"), (n / (n + 1)).alias("score"))
