"""Secret scans with a recursive decoding worklist.

The text is layer 0. Each layer is scanned for secrets, and each encoded part
of it - percent, Unicode and JSON escapes and entities over the whole layer,
base64 runs, compressed bytes inside these - is decoded into a new layer that
goes on the worklist, until no layer gives a new one. A layer carries, for each of its characters, the range of the
original text that it came from, so what is found in it maps back to a span of
the original. A layer (its content and where it came from) is taken once, which
ends cycles.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import quoted

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a shorter one fails as a whole
_ESCAPE = re.compile(
    r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(amp|quot|apos|lt|gt|colon|equals);|\\([\"'/]|\\(?![uUx]))"
)
_NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "colon": ":", "equals": "="}
_LONGEST_ESCAPE = 10
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# a run that goes on over line ends, also escaped ones, with blanks or quote marks before its lines
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>#*|]*+[A-Za-z0-9+/_-]++)++={0,2}")
_SYMBOLS = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t>#*|]*")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78][\0-\xff]", re.S)
#: Characters up to U+00FF in UTF-16, either byte order; 14 are the shortest finding.
_UTF16 = re.compile(rb"(?:[^\0]\0){13,}[^\0]\0?|(?:\0[^\0]){14,}")
#: An unpacked stream is read in parts of so many bytes, each with the end of the one before it.
PART, OVERLAP = 16 << 20, 1 << 16
#: Bytes that one document's decoding may make in all, maps included: a stop for decompression bombs; a document beyond it is marked.
MOST_BYTES = 4 << 30


def scan(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of each base finding: by start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@dataclass
class Layer:
    """A text and where it came from: each character's first and end place in the original, or one range for all.

    ``None`` is the original itself.
    """

    text: str
    first: np.ndarray | int | None = None
    last: np.ndarray | int | None = None

    @property
    def held(self) -> int:
        """Bytes that it takes."""
        return len(self.text) * (1 if self.text.isascii() else 4) + (self.first.nbytes + self.last.nbytes if isinstance(self.first, np.ndarray) else 0)

    def span(self, a: int, z: int) -> tuple[int, int]:
        """Range of the original that the characters from ``a`` to ``z`` came from."""
        if self.first is None:
            return a, z
        if isinstance(self.first, int):
            return self.first, self.last
        return int(self.first[a:z].min()), int(self.last[a:z].max())

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray] | tuple[int, int]:
        """The same, of characters that came from ``first`` to ``last`` (the end not counted) here."""
        if self.first is None:
            return first.astype(np.int32), last.astype(np.int32)
        if isinstance(self.first, int):
            return self.first, self.last
        return self.first[first], self.last[last - 1]


def _texts(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Text, first byte and bytes a character (0: as UTF-8 has it) of what ``raw`` may be.

    All of it as UTF-8, a byte that isn't standing for itself, and runs of
    UTF-16 that hold characters up to U+00FF.
    """
    yield raw.decode("utf-8", "surrogateescape"), 0, 0
    if b"\0" in raw:
        for m in _UTF16.finditer(raw):
            at = m.start() + (raw[m.start()] == 0)
            yield raw[at : m.end() : 2].decode("latin-1"), at, 2


def _starts(text: str) -> np.ndarray:
    """Byte at which each character of a text from ``_texts`` starts."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code > 0x7F).astype(np.int8) + ((code > 0x7FF) & ((code < 0xDC80) | (code > 0xDCFF))) - ((code >= 0xDC80) & (code <= 0xDCFF)) + (code > 0xFFFF)
    return np.cumsum(width, dtype=np.int32) - width


def _escapes(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """start, end, value of each escape, and whether it is a byte. What one gives may begin another: that is followed at once."""
    at = 0
    while m := _ESCAPE.search(text, at):
        start, end = m.span()
        value, byte = _value(m)
        while value in (37, 38, 92) and (m := _ESCAPE.match(chr(value) + text[end : end + _LONGEST_ESCAPE])):
            end += m.end() - 1
            value, byte = _value(m)
        if value is not None:
            yield start, end, value, byte
        at = end


def may_escape(text: str) -> bool:
    return "%" in text or "\\" in text or "&" in text


def _value(m: re.Match) -> tuple[int | None, bool]:
    kind = m.lastindex
    if kind <= 2:
        return int(m[kind], 16), True
    if kind >= 8:
        return ord(_NAMED[m[8]] if kind == 8 else m[9]), False
    code = int(m[kind], 10 if kind == 7 else 16)
    return (code, False) if code < 0x110000 and not 0xD800 <= code < 0xE000 else (None, False)


def _unescaped(layer: Layer) -> Iterator:
    """The whole text with all its escapes decoded (bytes side by side as UTF-8 where they are), and what is packed in bytes so written."""
    text, out, firsts, lasts, at = layer.text, [], [], [], 0
    mapped = not isinstance(layer.first, int)
    odd: list[int] = []  # escapes of bytes that no text holds
    run: list[tuple[int, int, int]] = []

    def add(s: str, start: int, end: int) -> None:
        out.append(s)
        if mapped:
            firsts.append(np.full(len(s), start, np.int32)), lasts.append(np.full(len(s), end, np.int32))

    def close() -> None:
        if not run:
            return
        raw = bytes(v for _, _, v in run)
        try:
            i = 0
            for c in raw.decode():
                n = len(c.encode())
                add(c, run[i][0], run[i + n - 1][1])
                i += n
        except UnicodeDecodeError:
            for a, z, v in run:
                add(chr(v), a, z)
        run.clear()

    for start, end, value, byte in _escapes(text):
        if start > at:
            close()
            out.append(text[at:start])
            if mapped:
                firsts.append(np.arange(at, start, dtype=np.int32)), lasts.append(np.arange(at + 1, start + 1, dtype=np.int32))
        if value < 256 and (byte or value > 127 or value < 9):
            run.append((start, end, value))
            if value < 9 or 13 < value < 32 or value > 126:
                odd.append(start)
        else:
            close()
            add(chr(value), start, end)
        at = end
    close()
    if not out:
        return
    out.append(text[at:])
    if mapped:
        firsts.append(np.arange(at, len(text), dtype=np.int32)), lasts.append(np.arange(at + 1, len(text) + 1, dtype=np.int32))
        yield Layer("".join(out), *layer.places(np.concatenate(firsts), np.concatenate(lasts)))
    else:
        yield Layer("".join(out), layer.first, layer.last)
    end = -1
    for start in odd:
        if start < end:
            continue
        begin = max((m.end() for m in re.finditer(r"\s", text[max(0, start - 4096) : start])), default=0) + max(0, start - 4096)
        end = m.start() if (m := re.compile(r"\s").search(text, start)) else len(text)
        raw, at = bytearray(), begin
        for a, z, v, _ in _escapes(text[begin:end]):
            raw += text[at : begin + a].encode("utf-8", "surrogatepass") + (bytes([v]) if v < 256 else chr(v).encode())
            at = begin + z
        raw += text[at:end].encode("utf-8", "surrogatepass")
        yield from _unpacked(bytes(raw), *layer.span(begin, end))


def _stream(raw: memoryview) -> Iterator[bytes | int]:
    """What the compressed stream that ``raw`` starts with holds, as far as it can be read, by and by; last its length in ``raw`` (0: it has no end)."""
    if raw[:3] == b"\x1f\x8b\x08":
        d = zlib.decompressobj(31)
    elif raw[:3] == b"BZh":
        d = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\0":
        d = lzma.LZMADecompressor()
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        d = zstandard.ZstdDecompressor().decompressobj()
    elif len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
        d = zlib.decompressobj()
    else:
        yield 0
        return
    at = 0
    try:
        while at < len(raw):
            part = raw[at : at + 256]
            at += len(part)
            yield d.decompress(part)
            if getattr(d, "eof", False):
                yield at - len(d.unused_data)
                return
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
        pass
    yield 0


def _pieces(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """What the compressed streams in ``raw`` hold, in parts, and whether a part goes on; streams that follow at once are one."""
    at, end, held, view = 0, -1, b"", memoryview(raw)
    while m := _PACKED.search(raw, at):
        if held and raw[end : m.start()].strip(b"\0"):
            yield held, False
            held = b""
        got, gone, n, parts = 0, 0, 0, []
        for x in _stream(view[m.start() :]):
            if isinstance(x, int):
                n = x
                break
            got += len(x)
            parts.append(x)
            if len(held) + got - gone >= PART:
                held, parts, gone = held + b"".join(parts), [], got
                yield held, True
                held = held[-OVERLAP:]
        if got >= 8:
            held += b"".join(parts)
            end = m.start() + n
            if not n:
                yield held, False
                held = b""
        at = m.start() + (n or 1)
    if held:
        yield held, False


def _unpacked(raw: bytes, first: int, last: int) -> Iterator:
    """Layers of what is packed in ``raw``; the bytes themselves, as more may be packed in them; true wherever a stream goes on in a further part."""
    for held, more in _pieces(raw):
        if more:
            yield True
        for text, _, _ in _texts(held):
            yield Layer(text, first, last)
        yield held, first, last


def _base64(layer: Layer) -> Iterator:
    """Of each run, on one line and over wrapped ones, all four phases; of each the bytes and what is packed in them."""
    text = layer.text
    mapped = not isinstance(layer.first, int)
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            spans = [(m.start(), m.start() + len(m[0].rstrip("=")))]
            if pattern is _WRAPPED:
                spans, at = [], m.start()
                for x in _BREAK.finditer(text, m.start(), m.end()):
                    spans.append((at, x.start()))
                    at = x.end()
                spans = [_SYMBOLS.match(text, a, z).span() for a, z in [*spans, (at, m.end())]]
            run = "".join(text[a:z] for a, z in spans).replace("-", "+").replace("_", "/")
            if len(run) < 16:
                continue
            place = np.concatenate([np.arange(a, z, dtype=np.int32) for a, z in spans]) if mapped else None
            for phase in range(4):
                body = run[phase:]
                if len(body) % 4 == 1:
                    body = body[:-1]
                raw = base64.b64decode(body + "=" * (-len(body) % 4))
                for decoded, begin, step in _texts(raw):
                    if not mapped:
                        yield Layer(decoded, layer.first, layer.last)
                        continue
                    of = place[phase:]
                    at = np.arange(begin, begin + 2 * len(decoded), 2) if step else _starts(decoded)
                    stop = np.r_[at[1:], min(len(raw), at[-1] + 4)]
                    yield Layer(decoded, *layer.places(of[at.astype(np.int64) * 8 // 6], of[np.minimum(-(-stop.astype(np.int64) * 8 // 6), len(body)) - 1] + 1))
                yield from _unpacked(raw, *layer.span(m.start(), m.end()))


def decoded_layers(layer: Layer) -> Iterator:
    """The layers one decoding step below ``layer``, and true wherever a stream is read in parts."""
    if may_escape(layer.text):
        yield from _unescaped(layer)
    yield from _base64(layer)


def find_secrets(text: str | None, *, most_bytes: int = MOST_BYTES) -> dict:
    """base: findings in the text as it is; spans: these and those of decoded layers, each once; layers, cut.

    A span is (kind, start, end) in code points of the original, end exclusive;
    a decoded finding spans all that its characters were decoded from. Null is
    empty. Layers are decoded one at a time, depth first, and an unpacked stream
    is read to its end in parts, so what is held at once are the layers on the
    way down to one of them. ``cut`` tells that a stream was read in parts (what
    is found in a part is given; an encoded run that crosses from one part into
    the next by more than ``OVERLAP`` bytes may be missed) or that decoding
    stopped after making ``most_bytes``.
    """
    text = text or ""
    base = scan(text)
    spans, seen, layers, made, cut = set(base), set(), 0, 0, False
    work: list[Iterator] = []
    if _BASE64.search(text) or _WRAPPED.search(text) or may_escape(text) and _ESCAPE.search(text):
        work.append(decoded_layers(Layer(text)))
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer is True:
            cut = True
            continue
        if isinstance(layer, tuple):  # bytes to look for packed streams in
            name = hashlib.sha256(layer[0]).digest()
            if name not in seen:
                seen.add(name)
                work.append(_unpacked(*layer))
            continue
        if not layer.text:
            continue
        made += layer.held
        if made > most_bytes:
            cut = True
            break
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        spans |= {(k, *layer.span(a, z)) for k, a, z in scan(layer.text)}
        work.append(decoded_layers(layer))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return {"base": base, "spans": sorted(spans, key=order), "layers": layers, "cut": cut}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end), layers, cut of each row of ``docs``; rows never move.

    A null or empty text has no spans. Whole texts are read however long. Rows
    that repeat an id or a text are scanned as rows of their own and alike;
    spans that start together stand in the order of the kinds, then by end. An
    empty table gives an empty one. Other columns, whatever their names, play no
    part.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_secrets(t.as_py()) for t in b["text"]]
            as_rows = lambda key: pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in f[key]] for f in found], span)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b["doc_id"], as_rows("base"), as_rows("spans"), pa.array([f["layers"] for f in found], pa.int32()), pa.array([f["cut"] for f in found], pa.bool_())], names=["doc_id", "base", "spans", "layers", "cut"])

    return rows.mapInArrow(run, f"doc_id {kind}, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>, layers int, cut boolean")
