"""Secret scans: base findings against a plain scan, decoded ones against planted nestings."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard

from inkspan.llm import secrets
from inkspan.llm.queries import QUERIES
from inkspan.llm.secrets import find_secrets, joined, scan_secrets

SECRET = "password: hunter2hunter2"
PATTERNS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, a, z) for a, _, k, z in sorted(out)]


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    out = QUERIES["op4_secret_scan"](spark, tiny).collect()
    assert len(out) == len(docs)
    for r in out:
        base = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in base) for k in PATTERNS)
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


LAYERS = {
    "percent": lambda s: quote(s, safe=""),
    "all percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "entity": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested(outer, inner):
    hidden = LAYERS[outer](LAYERS[inner](f"été {SECRET} ok"))
    text = f"some \U0001f600 words {hidden} and more"
    found = find_secrets(text)
    at = text.index(hidden)
    ours = [(a, z) for k, a, z in found["spans"] if k == "assign" and (k, a, z) not in found["base"]]
    assert ours and all(at <= a < z <= at + len(hidden) for a, z in ours)


def test_spans_are_exact_in_plain_layers():
    text = f"x {quote('key = ' + SECRET, safe='')} y"
    (k, a, z), = find_secrets(text)["spans"]
    assert k == "assign" and text[a:z] == quote(SECRET, safe="")
    text = "b " + base64.b64encode(b"12" + SECRET.encode() + b"\n").decode() + " e"
    (k, a, z), = find_secrets(text)["spans"]
    assert SECRET in base64.b64decode(text[2 : 2 + len(text[2:-2]) ]).decode() and a >= 2 and z <= len(text) - 2 and z - a < 40


@pytest.mark.parametrize("text", [r"{\u0022password\u0022: \u0022hunter2hunter2\u0022}", "password%3A hunter2hunter2", "token&#61; abcdefgh12"])
def test_findings_cross_blanks_between_encoded_parts(text):
    found = find_secrets(f"x {text} y")
    assert not found["base"] and [k for k, _, _ in found["spans"]] == ["assign"]


@pytest.mark.parametrize("before", ["\u00a0", "\u3000", "\u200b", "\ufeff", "\f", "\0"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_decoded_bytes_need_not_be_printable(before, pack):
    for raw in (f"ab{before} {SECRET} c".encode(), f"ab{before} {SECRET} c".encode() + b"\xff\xfe\x80", f"ab{before} {SECRET} c".encode("utf-16"), f"ab{before} {SECRET} c".encode("utf-16-be")):
        hidden = base64.b64encode(pack(raw)).decode()
        (k, a, z), = {x for x in find_secrets(f"x {hidden} y")["spans"]}
        assert k == "assign" and 2 <= a < z <= 2 + len(hidden)
        if pack is bytes and len(raw) < 50:
            at = raw.index(b"password")
            assert a == 2 + at * 8 // 6 and z == 2 + -(-(at + len(SECRET)) * 8 // 6)


NOISE = "".join(hashlib.sha256(str(i).encode()).hexdigest()[:20] + " " for i in range(20))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n> ", "\\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, lambda b: gzip.compress(b)[:-12], lambda b: gzip.compress(NOISE.encode()) + gzip.compress(b)])
def test_wrapped_and_glued_base64(end, pack):
    hidden = base64.b64encode(pack(f"{NOISE} {SECRET} {NOISE}".encode())).decode()
    wrapped = end.join(hidden[i : i + 76] for i in range(0, len(hidden), 76))
    for text in (f"x\n{wrapped}\n", f"/cfg/{hidden}", f"id_{hidden} y", f"a-{hidden}"):
        assert "assign" in {k for k, _, _ in find_secrets(text)["spans"]}


def added(text):
    found = find_secrets(text)
    return set(found["spans"]) - set(found["base"])


def test_cycles_end():
    assert find_secrets("%2541" * 50)["spans"] == []
    assert not find_secrets("token=abcdefgh")["cut"]
    for chain in ("%" + "25" * 100_000 + "41", "\\" + "u005c" * 50_000 + "u0041", "&" + "amp;" * 50_000 + "#65;"):
        assert not added(chain)
        assert added(f"password={chain}bcdefghi") == {("assign", 0, len(chain) + 17)}


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("packer", PACKERS)
def test_bombs_end_at_the_stop(packer, monkeypatch):
    """Also those that come after the first one that is cut: nothing more is unpacked."""
    made = []
    of = secrets._stream
    monkeypatch.setattr(secrets, "_stream", lambda raw: (made.append(len(x)) or x if isinstance(x, bytes) else x for x in of(raw)))
    one = lambda p, c: base64.b64encode(PACKERS[p](c * 3_000_000)).decode()
    text = " ".join([one(packer, b"a"), *(one(p, c) for p in PACKERS for c in (b"b", b"c"))])
    assert find_secrets(text, most_bytes=100_000)["cut"]
    assert sum(made) < 3_100_000


@pytest.mark.parametrize("packer", PACKERS)
def test_long_streams_are_read_to_their_end_in_parts(packer, monkeypatch):
    monkeypatch.setattr(secrets, "PART", 1 << 20)
    body = b"lorem ipsum " * 250_000
    text = "x " + base64.b64encode(PACKERS[packer](body + SECRET.encode())).decode() + " y"
    assert find_secrets(text)["cut"] and {k for k, *_ in added(text)} == {"assign"}


@pytest.mark.parametrize("text, end", [
    ("password = %68%75%6e%74%65%72%32%32", 35),
    ('{"password": "\\u0068unter22abc"}', 30),
    ('{\\"password\\": \\"hunter22abc\\"}', 28),
    ("password&quot;: &quot;hunter22abc", 33),
    ("password%253D%2568unter22abc", 28),
    ("token\\x3dabcdefgh12", 19),
])
def test_escapes_beside_plain_parts(text, end):
    (k, a, z), = set(find_secrets(text)["spans"]) - set(find_secrets(text)["base"])
    assert k == "assign" and z == end and text[a:].startswith(("password", "token"))


@pytest.mark.parametrize("packer", PACKERS)
def test_packed_bytes_in_escapes(packer):
    raw = PACKERS[packer](f"{NOISE} {SECRET}".encode())
    for hidden in (quote(raw, safe=""), quote(raw), "".join(f"%{b:02x}" for b in raw), "".join(f"\\x{b:02x}" for b in raw), "".join(f"\\u{b:04x}" for b in raw)):
        text = f"some words {hidden} more"
        (k, a, z), = find_secrets(text)["spans"]
        assert k == "assign" and text[a:z] == hidden


@pytest.mark.parametrize("packer", PACKERS)
def test_further_members_and_cut_streams(packer):
    kinds = lambda raw: {k for k, *_ in find_secrets("x " + base64.b64encode(raw).decode() + " y")["spans"]}
    assert kinds(PACKERS[packer](NOISE.encode()) + PACKERS[packer](SECRET.encode())) == {"assign"}
    if packer not in ("bz2", "zstd"):  # these hold a short text in one block, which a cut leaves unreadable
        assert kinds(PACKERS[packer](f"{SECRET} {NOISE}".encode())[:-8]) == {"assign"}


def test_words_alike_in_other_alphabets_do_not_match():
    assert find_secrets("paſſword=abcdefgh Key apiKey=abcdefgh")["spans"] == []


def test_odd(odd, empty):
    out = scan_secrets(odd).collect()
    assert len(out) == odd.count() and all(not r.cut for r in out)
    assert scan_secrets(empty).count() == 0
