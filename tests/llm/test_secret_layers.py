"""Inner layers of the secret scan: every place, both base64 alphabets, wrapped lines, escaped and cut streams."""

import base64
import gzip
import re
import time
import urllib.parse
import zlib

import numpy as np

from riskflow.llm import secrets

SECRET = "password=hunter2hunter2"


def found(text, kind="assign"):
    return [(k, s, e) for k, s, e, _ in secrets.scan(text) if k.endswith(f".{kind}")]


def noise(n, seed=7):
    return "".join(np.random.default_rng(seed).choice(list("bcdfghjklm npqrstvwxz"), n))


def test_layers_count_at_every_place():
    twice = base64.b64encode(base64.b64encode(SECRET.encode())).decode()
    text = f"one {twice} two {twice} three"
    n = len(twice)
    assert found(text) == [("base64.base64.assign", 4, 4 + n), ("base64.base64.assign", 9 + n, 9 + 2 * n)]


def test_url_safe_runs_are_whole():
    for seed in range(200):
        run = base64.urlsafe_b64encode(zlib.compress(f"{noise(40, seed)} {SECRET}".encode())).decode()
        assert ("base64.zlib.assign", 3, 3 + len(run)) in found(f"go {run} end")


def test_wrapped_lines_are_joined():
    body = f"{noise(3000)} {SECRET}"
    for data in (body.encode(), zlib.compress(body.encode()), gzip.compress(body.encode(), mtime=0)):
        for size in (64, 76):
            for encode in (base64.b64encode, base64.urlsafe_b64encode):
                run = encode(data).decode()
                for end in ("\n", "\r\n", "\n  "):
                    lines = end.join(run[i:i + size] for i in range(0, len(run), size))
                    assert any(s == 2 and e == 2 + len(lines) for _, s, e in found(f"x {lines}\nword after"))
    full = base64.b64encode(SECRET.encode() + b" " * (57 * 2 - len(SECRET))).decode()
    assert [x[1] for x in found(f"{full[:76]}\n{full[76:]}\nit is the end of it")] == [0]


def test_escaped_streams_are_opened():
    data = zlib.compress(f"{SECRET} and more".encode())
    percent, escaped = "".join(f"%{b:02X}" for b in data), "".join(f"\\x{b:02x}" for b in data)
    assert found(f"a {percent} b") == [("url.zlib.assign", 2, 2 + len(percent))]
    assert found(f"a {urllib.parse.quote(data)} b")[0][0] == "url.zlib.assign"
    assert found(f"a {escaped} b") == [("unicode.zlib.assign", 2, 2 + len(escaped))]


def test_cut_streams_are_told():
    data = zlib.compress(f"{SECRET} {noise(4000)}".encode())
    run = base64.b64encode(data[:len(data) // 2 // 3 * 3]).decode()
    kinds = {k for k, *_ in secrets.scan(run)}
    assert {"base64.zlib-cut", "base64.zlib-cut.assign"} <= kinds
    two = gzip.compress(b"first ", mtime=0) + gzip.compress(SECRET.encode(), mtime=0)
    assert [x[0] for x in found(base64.b64encode(two).decode())] == ["base64.gzip.assign"]


def test_long_unbroken_runs_take_linear_time():
    rng = np.random.default_rng(11)
    run = "".join(rng.choice(list("ghijklmnopqrstuvwxyzGHIJ"), 1_000_000))
    encoded = base64.b64encode(rng.bytes(750_000)).decode()
    for text in (f"%41 {run}", f"{run}%41", f"\\x41 {run}", f"\\u0041 {run}", f"{run}\\x41", f"%41 {encoded}", "%4" * 500_000, "\\x4" * 300_000,
                 f"%41{run} {SECRET}", "a%" * 500_000 + "%41"):
        began = time.perf_counter()
        spans = secrets.scan(text)
        assert time.perf_counter() - began < 2
        assert [(k, s, e) for k, s, e, _ in spans if "." not in k] == secrets.base_spans(text)
    text = f"%70assword%3Dhunter2hunter2{run}"
    assert found(text)[0] == ("url.assign", 0, len(text))


def test_escaped_runs_are_those_of_the_plain_rule():
    plain = r"[A-Za-z0-9_.~*+/=:-]"
    percent = re.compile(rf"{plain}*(?:%[0-9A-Fa-f]{{2}}{plain}*)+")
    one = r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})"
    escape = re.compile(rf"(?:{one}|{plain})*{one}(?:{one}|{plain})*")
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(["%", "%4", "%41", "a", "zz", " ", "\\", "\\x", "\\x4", "\\x41", "\\u00e9", "\\u00", "=", "4", "1"], 12))
        assert [m.span() for m in secrets._escaped(text, secrets.PERCENT, "%")] == [m.span() for m in percent.finditer(text)]
        assert [m.span() for m in secrets._escaped(text, secrets.ESCAPE, "\\")] == [m.span() for m in escape.finditer(text)]
