"""Picture codings in numpy: fax (group 4) for masks, JPEG for backgrounds, and an sRGB colour profile.

The writers are for Python workers, which have no imaging library; what they
write is read by any decoder (tests use the JVM's).
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# fixed values: run-length codes of the fax standard; lengths 0 to 63, then multiples of 64 up to 1728
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
# fixed values: of both colours, 1792 to 2560
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# fixed values: pass, horizontal, and vertical by how far the change lies right of the one above
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {-3: "0000010", -2: "000010", -1: "010", 0: "1", 1: "011", 2: "000011", 3: "0000011"}
END = "000000000001" * 2


def _run(length: int, black: int) -> str:
    out, codes = [], BLACK if black else WHITE
    while length >= 2560:
        out.append(LONG[-1])
        length -= 2560
    if length >= 64:
        many = length // 64
        out.append(LONG[many - 28] if many >= 28 else codes[63 + many])
    return "".join(out) + codes[length % 64]


def fax_encode(black: np.ndarray) -> bytes:
    """Group 4 coding of (height, width) of truth values, true being black."""
    height, width = black.shape
    bits, above = [], [width] * 4
    for row in black.astype(np.int8):
        here = np.flatnonzero(np.diff(row, prepend=0)).tolist() + [width] * 4
        a0, i, j, colour = -1, 0, 0, 0
        while a0 < width:
            while j and above[j - 1] > a0:
                j -= 1
            while above[j] < width and (above[j] <= a0 or j % 2 != colour):
                j += 1
            a1, b1, b2 = here[i], above[j], above[min(j + 1, len(above) - 1)]
            if b2 < a1:
                bits.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                bits.append(VERTICAL[a1 - b1])
                a0, i, colour = a1, i + 1, 1 - colour
            else:
                a2 = here[i + 1]
                bits += [HORIZONTAL, _run(a1 - max(a0, 0), colour), _run(a2 - a1, 1 - colour)]
                a0, i = a2, i + 2
        above = here
    bits.append(END)
    return np.packbits(np.frombuffer("".join(bits).encode(), np.uint8) - 48).tobytes()


@lru_cache(1)
def _modes() -> dict[str, object]:
    return {c: d for d, c in VERTICAL.items()} | {PASS: "pass", HORIZONTAL: "horizontal"}


@lru_cache(2)
def _runs(black: int) -> dict[str, int]:
    codes = BLACK if black else WHITE
    return {c: n if n < 64 else 64 * (n - 63) for n, c in enumerate(codes)} | {c: 1792 + 64 * n for n, c in enumerate(LONG)}


def fax_decode(raw: bytes, width: int, height: int | None = None) -> np.ndarray:
    """(height, width) of truth values, true being black, of group 4 data; rows that are cut off are left out."""
    bits = "".join(map("{:08b}".format, raw))
    at, rows, above = 0, [], [width] * 4

    def code(table: dict):
        nonlocal at
        for n in range(1, 14):
            if (found := table.get(bits[at : at + n])) is not None:
                at += n
                return found
        return None

    def run(colour: int) -> int:
        total = 0
        while True:
            n = code(_runs(colour))
            if n is None:
                raise ValueError("not a run")
            total += n
            if n < 64:
                return total

    while height is None or len(rows) < height:
        here, a0, j, colour = [], -1, 0, 0
        try:
            while a0 < width:
                mode = code(_modes())
                if mode is None:
                    raise ValueError("not a mode")
                while j and above[j - 1] > a0:
                    j -= 1
                while above[j] < width and (above[j] <= a0 or j % 2 != colour):
                    j += 1
                if mode == "pass":
                    a0 = above[min(j + 1, len(above) - 1)]
                elif mode == "horizontal":
                    a1 = max(a0, 0) + run(colour)
                    a0 = a1 + run(1 - colour)
                    here += [a1, a0]
                else:
                    a0, colour = above[j] + mode, 1 - colour
                    here.append(a0)
                if a0 > width or a0 < -1:
                    raise ValueError("beyond the row")
        except ValueError:
            break
        turns = np.zeros(width + 1, np.int8)
        np.add.at(turns, [x for x in here if x < width], 1)
        rows.append(np.cumsum(turns[:width]) % 2 == 1)
        above = here + [width] * 4
    return np.array(rows, bool).reshape(len(rows), width)


# fixed values: steps of the JPEG standard's example for luma and chroma, row by row
LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
#: Places of a block from corner to corner, by diagonals that turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (s := k // 8 + k % 8, k // 8 if s % 2 else k % 8)))


def _steps(table: str, quality: float) -> np.ndarray:
    """Steps for a quality of 0 to 1: halved at 0.75, ten times as wide at 0.05."""
    share = 0.5 / max(quality, 0.01) if quality < 0.5 else 2 - 2 * min(quality, 1.0)
    return np.clip(np.floor(np.array(table.split(), float) * share + 0.5), 1, 255)


def _blocks(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(blocks, 64) of quantised coefficients, each block in zigzag order; edges are repeated to whole blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    n = np.arange(8)
    cosine = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None]
    cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((cosine @ cells @ cosine.T).reshape(-1, 64) / steps).astype(np.int64)[:, ZIGZAG]


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is a first coefficient, symbol, further bits, how many) in the order of the stream."""
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    extra = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    count = len(blocks)
    first = np.diff(blocks[:, 0], prepend=0)
    parts = [(np.arange(count) * 1024, np.ones(count, bool), size(first), extra(first, size(first)), size(first))]
    block, place = np.nonzero(blocks[:, 1:])
    value = blocks[block, place + 1]
    fresh = np.r_[True, block[1:] != block[:-1]][: len(block)]
    gap = place - np.where(fresh, -1, np.r_[-1, place[:-1]][: len(place)]) - 1
    parts.append((block * 1024 + (place + 1) * 16 + 15, np.zeros(len(block), bool), (gap % 16) * 16 + size(value), extra(value, size(value)), size(value)))
    for many in range(1, 4):  # sixteen zeros in a row, up to three times
        b, p = block[gap >= 16 * many], place[gap >= 16 * many]
        parts.append((b * 1024 + (p + 1) * 16 + many, np.zeros(len(b), bool), np.full(len(b), 0xF0), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)))
    last = np.zeros(count, np.int64)
    np.maximum.at(last, block, place + 1)
    ended = np.flatnonzero(last < 63)
    parts.append((ended * 1024 + 1023, np.zeros(len(ended), bool), np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64)))
    order, *rest = (np.concatenate(c) for c in zip(*parts))
    at = np.argsort(order, kind="stable")
    return tuple(c[at] for c in rest)


def _code_lengths(counts: np.ndarray) -> list[list[int]]:
    """Symbols by code length (1 to 16) for ``counts``; one code of the longest length stays unused, as the format asks."""
    heap = [(int(n), 0, [int(s)]) for s, n in enumerate(counts) if n] + [(0, 1, [-1])]
    heapq.heapify(heap)
    depth: dict[int, int] = {s: 0 for _, _, held in heap for s in held}
    while len(heap) > 1:
        (n, r, a), (m, q, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, max(r, q) + 1, a + b))
    by = [0] * 64
    for d in depth.values():
        by[d] += 1
    for d in range(63, 16, -1):  # pairs of too long codes go up: one takes their parent, one shares a shorter code's place
        while by[d]:
            up = next(k for k in range(d - 2, 0, -1) if by[k])
            by[d] -= 2
            by[d - 1] += 1
            by[up] -= 1
            by[up + 1] += 2
    ranked = iter(sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], -counts[s], s)))
    longest = max(d for d in range(64) if by[d])
    by[longest] -= 1
    return [[next(ranked) for _ in range(by[d])] for d in range(1, 17)]


def _table(lengths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    code, codes, sizes = 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, held in enumerate(lengths, 1):
        for s in held:
            codes[s], sizes[s] = code, n
            code += 1
        code <<= 1
    return codes, sizes


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def jpeg_encode(image: np.ndarray, quality: float) -> bytes:
    """JPEG of (height, width) or (height, width, 3) bytes; colours are taken at half the resolution.

    One scan for each component, with codes made for it; the quality is that of
    the usual scale from 0 to 1.
    """
    image = np.asarray(image)
    height, width = image.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise ValueError("a side of 1 to 65535")
    if image.ndim == 3 and image.shape[2] == 1:
        image = image[..., 0]
    luma, chroma = _steps(LUMA, quality), _steps(CHROMA, quality)
    if image.ndim == 2:
        planes = [(image.astype(float), luma, 1)]
    else:
        r, g, b = (image[..., k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [(y, luma, 2)]
        for c in ((b - y) / 1.772 + 128, (r - y) / 1.402 + 128):
            c = np.pad(c, ((0, height % 2), (0, width % 2)), mode="edge")
            planes.append((c.reshape(c.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)), chroma, 1))
    out = [b"\xff\xd8", _marker(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    for k, steps in enumerate((luma, chroma)[: 1 + (len(planes) > 1)]):
        out.append(_marker(0xDB, bytes([k]) + steps[ZIGZAG].astype(np.uint8).tobytes()))
    parts = b"".join(bytes([k + 1, 17 * at, min(k, 1)]) for k, (_, _, at) in enumerate(planes))
    out.append(_marker(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + parts))
    for k, (plane, steps, _) in enumerate(planes):
        first, symbol, more, many = _symbols(_blocks(plane, steps))
        code, size = np.empty_like(symbol), np.empty_like(symbol)
        for kind, chosen in ((0, first), (1, ~first)):
            lengths = _code_lengths(np.bincount(symbol[chosen], minlength=256))
            out.append(_marker(0xC4, bytes([16 * kind]) + bytes(map(len, lengths)) + bytes(s for held in lengths for s in held)))
            codes, sizes = _table(lengths)
            code[chosen], size[chosen] = codes[symbol[chosen]], sizes[symbol[chosen]]
        value, width_of = (code << many) | more, size + many
        ends = np.cumsum(width_of)
        down = np.repeat(ends, width_of) - 1 - np.arange(ends[-1])
        bits = ((np.repeat(value, width_of) >> down) & 1).astype(np.uint8)
        packed = np.packbits(np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]).tobytes()
        out += [_marker(0xDA, bytes([1, k + 1, 0, 0, 63, 0])), packed.replace(b"\xff", b"\xff\0")]
    return b"".join([*out, b"\xff\xd9"])


def srgb_profile() -> bytes:
    """An ICC display profile (version 2.1) of the sRGB colours, made from their definition."""
    fixed = lambda v: struct.pack(">i", round(v * 65536))
    xyz = lambda *v: b"XYZ \0\0\0\0" + b"".join(map(fixed, v))
    x = np.arange(1024) / 1023
    curve = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    tone = b"curv\0\0\0\0" + struct.pack(">I", 1024) + np.rint(curve * 65535).astype(">u2").tobytes()
    name = b"sRGB IEC61966-2.1\0"
    # fixed values: white and primaries under the connection space's light
    tags = {
        b"desc": b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name + bytes(78), b"cprt": b"text\0\0\0\0" + b"no rights reserved\0", b"wtpt": xyz(0.9642, 1.0, 0.8249),
        b"rXYZ": xyz(0.43607, 0.22249, 0.01392), b"gXYZ": xyz(0.38515, 0.71687, 0.09708), b"bXYZ": xyz(0.14307, 0.06061, 0.7141), b"rTRC": tone, b"gTRC": tone, b"bTRC": tone,
    }
    table, data, at = struct.pack(">I", len(tags)), b"", 132 + 12 * len(tags)
    placed: dict[bytes, int] = {}
    for sign, body in tags.items():
        if body not in placed:
            placed[body] = at + len(data)
            data += body + bytes(-len(body) % 4)
        table += sign + struct.pack(">II", placed[body], len(body))
    head = struct.pack(">I4sI4s4s4s6H4s", at + len(data), bytes(4), 0x02100000, b"mntr", b"RGB ", b"XYZ ", 2024, 1, 1, 0, 0, 0, b"acsp")
    head += bytes(28) + fixed(0.9642) + fixed(1.0) + fixed(0.8249)
    return head + bytes(128 - len(head)) + table + data
