"""Secrets against plain regular expressions, and below layers of encoding against the places they were put at."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard

from quireworks.llm import queries, secrets

BASE = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]
LEAST = {"assign": 6, "access": 20, "hex": 24}
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
CODES = {
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "address": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "wrapped": lambda s: base64.encodebytes((s + " " + "x" * 90).encode()).decode().strip(),
    "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "quote": urllib.parse.quote,
    "u": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "x": lambda s: "".join(f"\\x{b:02x}" for b in s.encode()),
    "decimal": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "hexadecimal": lambda s: "".join(f"&#x{ord(c):X};" for c in s),
    "16-bit": lambda s: base64.b64encode(s.encode("utf-16-le")).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    "bzip2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    "xz": lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    "zstd": lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(),
    "gzip in an address": lambda s: urllib.parse.quote(gzip.compress(s.encode())),
}


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


@pytest.mark.parametrize("inner", CODES)
def test_two_layers(inner):
    for outer in CODES:
        coded = CODES[outer](CODES[inner](SECRET))
        text = f"été 日本 🦄 prose, {coded} (more prose).\nAnd more."
        a = text.index(coded)
        got = [x for x in secrets.search(text) if x[0] == "assign" and x[3]]
        assert any(a <= s < e <= a + len(coded) for _, s, e, _ in got), (outer, inner, got)
        assert [x[:3] for x in secrets.search(text) if not x[3]] == base(text)


def test_spans_are_exact():
    for name in ("percent", "u", "x", "decimal", "hexadecimal"):
        coded = CODES[name](SECRET)
        assert ("assign", 5, 5 + len(coded) - len(CODES[name]('"')), "escapes") in secrets.search(f"say, {coded} done")
    text = base64.b64encode(b"--- " + SECRET.encode() + b" ---").decode()
    (kind, a, b, how), _ = secrets.search(text)
    assert (kind, how) == ("assign", "base64")
    assert a == 4 * 8 // 6 and b == -(-(4 + len(SECRET) - 1) * 8 // 6)
    # a secret that is only in part encoded has all of its own span, and what stands there as it is stays
    assert secrets.search("token=abcdef%41bc end") == [("assign", 0, 12, ""), ("assign", 0, 17, "escapes")]
    assert secrets.search("to%6ben=abcdefgh") == [("assign", 0, 16, "escapes")]
    assert secrets.search("https://x.y/?q=a%20b") == [] and secrets.search("100%25 of %zz \\q &amp; é") == []


def test_fixpoint_cycles_and_long_texts():
    began = time.time()
    assert secrets.search("%" + "25" * 100_000 + "41 ")[0][0] == "hex"
    assert secrets.search("%2" * 100_000 + "35") == []
    assert secrets.search("\\u005c" * 50_000 + "u0041") == []
    deep = SECRET
    for _ in range(14):
        deep = CODES["base64"](deep)
    assert {x[0] for x in secrets.search(deep)} >= {"assign", "hex"}
    assert secrets.search(base64.b64encode(random.Random(1).randbytes(1_000_000)).decode()) == []
    assert secrets.search(" " * 1_000_000 + "token" + " " * 1_000_000 + "=") == []
    bomb = CODES["base64"]("x") + " " + base64.b64encode(gzip.compress(b"\n" * 40_000_000 + SECRET.encode())).decode()
    assert {x[0] for x in secrets.search(bomb)} == {"assign", "hex"}
    assert time.time() - began < 30
    layer = base64.b64encode(gzip.compress(b"\x1f\x8b\x08" + b"junk" * 9)).decode()
    assert secrets.search(layer) == [] and secrets.search("H4sIAAAA" * 9) == []


def test_a_stream_that_holds_itself(monkeypatch):
    loop = b"\x1f\x8b\x08" + b"itself" * 4
    monkeypatch.setattr(secrets, "_pieces", lambda data: iter([data]))
    assert secrets.search(base64.b64encode(loop).decode()) == []


def test_base_against_plain_patterns():
    rng = random.Random(3)
    parts = ["token", "TOKEN", "toKen", "password", "passwd", "secret", "api_key", "apikey", "API_KEY", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "abc", "-", "%3D", "\n", "ſecret", "日", "\\u003d", "."]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert [x[:3] for x in secrets.search(text) if not x[3]] == base(text), text


def test_query(spark):
    data = "/root/testdata/sf0.01"  # the smallest folder has no secret
    rows = {r.doc_id: r for r in queries.QUERIES["op13_secret_scans"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 0
    for d in docs:
        found = base(d.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        got = rows[d.doc_id]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == x for k, *_ in found) for x in ("assign", "access", "hex"))
        assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got.spans == text


def test_odd_rows(spark):
    schema = "found string, doc_id long, text string, kind int"
    rows = [("x", None, None, 1), ("x", 1, "", 2), ("x", 1, SECRET, 3), ("x", 1, SECRET, 4), (None, 2, CODES["gzip"](SECRET), None)]
    got = secrets.digests(secrets.find_secrets(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_hex, len(r.found)) for r in got) == [(0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 1, 2), (1, 1, 1, 2), (2, 0, 0, 2)]
    assert {r.base_sha256 for r in got if not r.n_assign} == {hashlib.sha256(b"").hexdigest()}
    size = len(rows[4][2].rstrip("="))
    assert [(r.spans, r.found[0].layers) for r in got if r.doc_id == 2] == [(f"assign:0:{size},hex:0:{size}", "base64>gzip")]
    assert secrets.digests(secrets.find_secrets(spark.createDataFrame([], schema))).count() == 0


def test_layers_in_pairs_keep_clean_texts_clean(spark, data):
    clean = [t for (t,) in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if t and not base(t)][:60]
    assert all(secrets.search(t) == [] for t in clean)
    for a, b in itertools.pairwise(clean[:20]):
        assert secrets.search(CODES["gzip"](a[:500]) + " " + CODES["percent"](b[:200])) == []
