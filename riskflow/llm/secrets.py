"""Secret scans with a recursive decoding worklist.

Every layer, the text itself first, is scanned for secrets and for encoded runs: percent escapes,
Unicode and hex escapes, base64 (both alphabets, also wrapped into lines) and compressed bytes (gzip,
zlib) inside any of them. Each run that decodes goes to the worklist as a new layer with the span of
the outermost run it came from. A layer is decoded once a document, and what it holds counts at every
outermost run that leads to it; below one run it is opened by its first chain of codings only, so the
list empties. Spans always are code points of the original text.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")       # maximal runs, so the same as runs of one or more kept from 16 on
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Maximal runs of plain signs and escapes, each read once; runs without an escape are passed over by ``_escaped``.
PERCENT = re.compile(r"(?:[A-Za-z0-9_.~*+/=:-]++|%[0-9A-Fa-f]{2})++")
ESCAPE = re.compile(r"(?:[A-Za-z0-9_.~*+/=:-]++|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})++")
#: Runs of one alphabet each.
BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: The same over several lines, the first of 16 signs or more.
WRAPPED = tuple(re.compile(rf"(?<![{c}])[{c}]{{16,}}+(?:\r?\n[\x20\t]*[{c}]++)+={{0,2}}") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: A compressed layer is opened up to this many bytes (a guard against bombs); a larger one is reported as kind ``bomb``.
MOST_INFLATED = 1 << 24


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) of one text, leftmost and non-overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _readable(data: bytes, cut: bool = False) -> str | None:
    """Text of the bytes if it is mostly printable; of ``cut`` bytes the last sign may be incomplete."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(data, not cut)
    except UnicodeDecodeError:
        return None
    plain = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and plain >= 0.95 * len(text) else None


def _inflate(data: bytes) -> tuple[str, bytes] | None:
    """('gzip' or 'zlib', bytes), with '-cut' if the stream ends early; ('bomb', b'') beyond the guard; None if it is
    not compressed. Gzip members that follow each other count as one."""
    kind, bits = ("gzip", 31) if data[:2] == b"\x1f\x8b" else ("zlib", 15)
    if kind == "zlib" and (len(data) < 6 or data[0] & 15 != 8 or (data[0] * 256 + data[1]) % 31):
        return None
    out = b""
    while True:
        machine = zlib.decompressobj(bits)
        try:
            out += machine.decompress(data, MOST_INFLATED - len(out) + 1)
        except zlib.error:
            return (f"{kind}-cut", out) if out else None
        if len(out) > MOST_INFLATED:
            return "bomb", b""
        if not machine.eof:
            return f"{kind}-cut", out
        data = machine.unused_data
        if kind != "gzip" or data[:2] != b"\x1f\x8b":
            return kind, out


def _open(raw: bytes, coding: str) -> tuple[str, str | None] | None:
    """(coding, text) of decoded bytes, through compressed layers nested without text between; text None is a bomb."""
    cut, seen = False, set()
    while raw not in seen:                  # a stream may unpack to itself
        seen.add(raw)
        if not (opened := _inflate(raw)) or opened[0].endswith("-cut") and _readable(raw):
            break
        coding, raw, cut = f"{coding}.{opened[0]}", opened[1], cut or opened[0].endswith("-cut")
        if opened[0] == "bomb":
            return coding, None
    text = _readable(raw, cut)
    return None if text is None else (coding, text)


def _percent(run: str) -> tuple[str, str | None] | None:
    parts = re.split("%([0-9A-Fa-f]{2})", run)
    raw = b"".join(bytes([int(p, 16)]) if i % 2 else p.encode("utf-8", "surrogatepass") for i, p in enumerate(parts))
    return _open(raw, "url")


def _escapes(run: str) -> tuple[str, str | None]:
    text = _ONE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), run)
    try:
        if (raw := text.encode("latin-1"))[:1] > b"\x07" and _inflate(raw) and (got := _open(raw, "unicode")):
            return got
    except UnicodeEncodeError:
        pass
    return "unicode", text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _base64(run: str) -> tuple[str, str | None] | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return _open(raw, "base64")


def _wrapped(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    """Base64 over lines of one length and a last line of at most that length, which may not belong to it."""
    for pattern in WRAPPED:
        for block in pattern.finditer(text):
            lines = [(m.start(), m.end()) for m in _LINE.finditer(text, block.start(), block.end())]
            i = 0
            while i + 1 < len(lines):
                size, j = lines[i][1] - lines[i][0], i + 1
                while j < len(lines) and lines[j][1] - lines[j][0] == size:
                    j += 1
                ends = [j + 1, j] if j < len(lines) and len(text[slice(*lines[j])].rstrip("=")) < size else [j]
                if size < 16:
                    ends = []
                for end in ends:
                    if end > i + 1 and (got := _base64("".join(text[s:e] for s, e in lines[i:end]))):
                        yield got[0], lines[i][0], lines[end - 1][1], got[1]
                        j = end
                        break
                i = j


def _escaped(text: str, pattern: re.Pattern, mark: str) -> Iterator[re.Match]:
    """The runs of ``pattern`` that hold an escape, whose first sign is ``mark``."""
    return (m for m in pattern.finditer(text) if text.find(mark, m.start(), m.end()) >= 0)


def layers(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(coding, start, end, decoded text) of the encoded runs of one layer; decoded None is an unopened bomb."""
    if "%" in text:
        for m in _escaped(text, PERCENT, "%"):
            if got := _percent(m[0]):
                yield got[0], m.start(), m.end(), got[1]
    if "\\u" in text or "\\x" in text:
        for m in _escaped(text, ESCAPE, "\\"):
            got = _escapes(m[0])
            yield got[0], m.start(), m.end(), got[1]
    joined = sorted(_wrapped(text), key=lambda x: x[1:3]) if "\n" in text else []
    yield from joined
    starts, reach = [x[1] for x in joined], list(accumulate((x[2] for x in joined), max))
    for pattern in BASE64:
        for m in pattern.finditer(text):
            if pattern is BASE64[1] and "-" not in m[0] and "_" not in m[0]:
                continue                    # the same run as of the other alphabet, or a part of it
            at = bisect_right(starts, m.start())
            if (not at or reach[at - 1] < m.end()) and (got := _base64(m[0])):
                yield got[0], m.start(), m.end(), got[1]


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """All spans (kind, start, end, value) of a text; kinds of inner layers are ``coding.kind``, outermost coding first."""
    found = {(k, s, e): text[s:e] for k, s, e in base_spans(text)}
    opened, done = {text: ([], list(layers(text)))}, set()      # decoded layers with what they hold; (outermost run, layer)
    work = [("", None, text)]
    while work:
        path, where, layer = work.pop()
        for coding, s, e, inner in opened[layer][1]:
            place = where or (s, e)
            here = f"{path}.{coding}" if path else coding
            if inner is None or "-cut" in coding:
                found.setdefault((here, *place), "")
            if inner is None or inner in (layer, text):
                continue
            if inner not in opened:
                opened[inner] = [(k, inner[a:b]) for k, a, b in base_spans(inner)], list(layers(inner))
            for k, value in opened[inner][0]:
                found.setdefault((f"{here}.{k}", *place), value)
            if (place, inner) not in done:
                done.add((place, inner))
                work.append((here, place, inner))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*key, value) for key, value in sorted(found.items(), key=lambda x: (x[0][1], order.get(x[0][0], len(order)), x[0]))]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in scan(t.as_py() or "")]
                for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, _SPANS)], names=["id", "spans"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (kind, start, end, value) by start, then kind as listed, then name.

    Null and empty texts have no spans. Repeated rows are scanned each for itself; an empty table gives an empty
    result; further columns of ``docs`` are not read."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _run, f"id {id_type}, spans array<struct<kind:string,start:long,end:long,value:string>>")
    return out.withColumnRenamed("id", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (joined), n_inner (spans found in inner layers)."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return result.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"),
                         (F.size("spans") - F.size(base)).cast("long").alias("n_inner"))
