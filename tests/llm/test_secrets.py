"""Secret scans against the plain rules, and through nested encodings."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pytest

from parlance.llm import secrets

SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def base_spans(text):
    """The rules, tried one after the other at full length."""
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def found(text, base=None):
    return [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in secrets.scan(text)["spans"]
            if base is None or s["base"] == base]


def test_base_equals_the_rules():
    rng = random.Random(2)
    parts = ["password", "token", '="', ":", " ", "=", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "SECRET",
             "api_key", "0" * 31, "f", "\n", "'", "%41", "\\u0041"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert found(text, base=True) == base_spans(text), repr(text)


def encodings():
    b64 = lambda b: base64.b64encode(b).decode()
    raw = SECRET.encode()
    return {
        "url": urllib.parse.quote(SECRET, safe=""), "url twice": urllib.parse.quote(urllib.parse.quote(SECRET)),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET), "entities": "".join(f"&#{ord(c)};" for c in SECRET),
        "base64": b64(raw), "urlsafe": base64.urlsafe_b64encode(raw).decode(), "gzip": b64(gzip.compress(raw)),
        "zlib": b64(zlib.compress(raw)), "bz2": b64(bz2.compress(raw)), "gzip twice": b64(gzip.compress(gzip.compress(raw))),
        "base64 in url in base64": b64(urllib.parse.quote(b64(gzip.compress(raw)), safe="").encode()),
    }


@pytest.mark.parametrize("name", encodings())
def test_nested_layers_are_found_and_mapped(name):
    code = encodings()[name]
    text = f"abc é {code} def"
    spans = found(text, base=False)
    assert {k for _, k, _ in spans} >= {0, 2}
    assert all(6 <= s < e <= 6 + len(code) for s, _, e in spans)
    assert any(s == 6 for s, _, _ in spans)


def test_every_place_of_one_layer_is_reported():
    code = base64.b64encode(SECRET.encode()).decode()
    spans = found(f"{code} and {code}", base=False)
    assert {s for s, _, _ in spans} == {0, len(code) + 5}


def test_cycles_and_bombs_end():
    # A stream whose content is its own base64 text cannot be written down
    # here; an escape that stays the same and a large stream can.
    assert secrets.scan("%25" * 50)["spans"] == []
    bomb = base64.b64encode(gzip.compress(b"0" * (secrets.LAYER_BYTES + 10))).decode()
    assert secrets.scan(bomb)["n_cut"] == 1


@pytest.mark.parametrize("beside", ["\u00a0", "\u3000", "\u200d", "\ufeff", "\f", "\x1b", "\u2028"])
def test_layers_with_other_characters_are_scanned(beside):
    code = base64.b64encode(f"mot de passe{beside}: {SECRET}".encode()).decode()
    assert {(0, 0, len(code)), (0, 2, len(code))} <= set(found(code, base=False))


@pytest.mark.parametrize("width", [19, 64, 76])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_wrapped_base64_is_one_layer(width, line_end):
    rng = random.Random(width)
    filler = " ".join(f"{rng.random()}" for _ in range(40))
    for raw in (f"{filler} {SECRET} {filler}".encode(), gzip.compress(f"{filler} {SECRET}".encode()),
                *(f"{SECRET}{'x' * k}".encode() for k in range(4))):
        code = base64.b64encode(raw).decode()
        code = line_end.join(code[k:k + width] for k in range(0, len(code), width))
        for tail in ("", f"{line_end}", f"{line_end}{line_end}next", f"{line_end}-----END-----", " end"):
            assert (4, 0, 4 + len(code)) in found(f"abc {code}{tail}", base=False) or (
                tail == f"{line_end}-----END-----" and any(s == 4 and k == 0 for s, k, _ in found(f"abc {code}{tail}")))
    # Lines that are no single run are still read one by one.
    line = base64.b64encode(SECRET.encode()).decode().rstrip("=")
    other = "_" * len(line)
    assert (0, 0, len(line)) in found(f"{line}\n{other}", base=False)


def test_long_texts_keep_their_layers(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 50_000)
    code = base64.b64encode(urllib.parse.quote(SECRET, safe="").encode()).decode()
    text = "some words, " * 6000 + f"%41 and, {code}, {urllib.parse.quote(SECRET)}"
    got = secrets.scan(text)
    assert got["n_cut"] == 0
    assert {(s["start"], s["kind"]) for s in got["spans"]} >= {(text.index(code), "assign"), (text.index("token"), "assign")}


def test_streams_are_scanned_to_their_end(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 50_000)
    monkeypatch.setattr(secrets, "OVERLAP", 2_000)
    inner = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    raw = ("some words, " * 9000 + SECRET + ", " + "other words, " * 9000 + inner).encode()
    for code in (gzip.compress(raw), bz2.compress(raw), zlib.compress(raw), gzip.compress(gzip.compress(raw))):
        code = base64.b64encode(code).decode()
        got = secrets.scan(code)
        assert got["n_cut"] == 0 and {s["kind"] for s in got["spans"] if not s["base"]} >= {"assign", "hex"}
    only = base64.b64encode(gzip.compress(("other words, " * 9000 + inner).encode())).decode()
    assert (0, 0, len(only)) in found(only, base=False)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress])
def test_every_member_of_a_stream_is_scanned(pack):
    code = base64.b64encode(pack(b"nothing here, ") + pack(SECRET.encode())).decode()
    assert (0, 0, len(code)) in found(code, base=False)
    # A whole stream ends with its line, whatever the next line begins with.
    line = base64.b64encode(pack(SECRET.encode())).decode().rstrip("=")
    assert (0, 0, len(line)) in found(f"{line}\nnext words", base=False)


def test_a_refused_layer_costs_nothing(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    monkeypatch.setattr(secrets, "SHARE", 0)
    large = base64.b64encode(("some words, " * 90).encode()).decode()
    small = base64.b64encode(SECRET.encode()).decode()
    got = secrets.scan(f"{large}, {small}")
    assert got["n_cut"] == 1 and any(s["start"] == len(large) + 2 for s in got["spans"])


LEAK = "password=hunter2hunter2"
PACKED = base64.b64encode(LEAK.encode()).decode()


@pytest.mark.parametrize("text", [
    "x %FF" + "".join(f"%{ord(c):02x}" for c in LEAK) + " y",
    "x " + "".join(f"%{ord(c):02x}" for c in LEAK) + "%FF%C3 y",
    "x \\ud800" + "".join(f"\\u{ord(c):04x}" for c in LEAK) + " y",
    "x \\udc00\\ud83d\\ude42" + "".join(f"\\u{ord(c):04x}" for c in LEAK) + "\\ud800 y",
    "x " + base64.b64encode(b"caf\xe9 " + LEAK.encode() + b" \xff").decode() + " y",
    *(f"x {front}{PACKED} y" for front in ("cfg/", "conf/", "a-b_", "https://h/p/abc/", "key_1-", "a/b/c/d/e/")),
    *(f"x {front}{base64.b64encode(gzip.compress(LEAK.encode())).decode()} y" for front in ("cfg/", "conf/", "a-b_")),
    f"x conf/{base64.b64encode(base64.b64encode(LEAK.encode())).decode()} y"])
def test_layers_behind_or_beside_other_bytes(text):
    found = secrets.scan(text)
    assert any(s["kind"] == "assign" for s in found["spans"]) and found["n_cut"] == 0
    assert "unter2" not in secrets.redacted(text, "[]") and secrets.redacted(text, "[]").startswith("x ")


def test_many_false_beginnings_take_linear_time():
    import time

    begin = time.perf_counter()
    secrets.scan("x " + "/H4sIAAAAAAAAAAAA" * 60_000 + " y")
    assert time.perf_counter() - begin < 30


def test_words_and_names_hold_no_layers():
    text = " ".join(["Donaudampfschifffahrtsgesellschaft", "some/long/path/to/a_file-name_here", "0123456789abcdef" * 2] * 50)
    assert {s["kind"] for s in secrets.scan(text)["spans"]} == {"hex"}


def test_redaction():
    text = f"x {SECRET} y {base64.b64encode(SECRET.encode()).decode()} z"
    masked = secrets.redacted(text, "[SECRET]")
    assert masked.startswith("x [SECRET]") and masked.endswith(" y [SECRET] z")
    assert secrets.scan(masked)["spans"] == []
    assert secrets.redacted("nothing here", "[SECRET]") == "nothing here"


def test_tables(documents, odd, empty):
    rows = secrets.digests(secrets.scan_secrets(documents)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    got = secrets.digests(secrets.scan_secrets(odd)).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got)
    assert secrets.scan_secrets(empty).count() == 0
    same = secrets.redact_secrets(odd)
    assert same.columns == odd.columns
    assert sorted(same.collect(), key=str) == sorted(odd.collect(), key=str)
