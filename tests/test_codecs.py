"""Codings against the JVM's own decoders, which share no code with them."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.sources import codecs


def _tiff(black: np.ndarray) -> bytes:
    data = codecs.fax_encode(black)
    height, width = black.shape
    tags = [(256, 4, width), (257, 4, height), (258, 3, 1), (259, 3, 4), (262, 3, 0), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data)), (293, 4, 0)]
    at = 8 + len(data) + len(data) % 2
    entries = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    return b"II*\0" + struct.pack("<I", at) + data + bytes(len(data) % 2) + struct.pack("<H", len(tags)) + entries + bytes(4)


def _decoded(spark, tmp_path, name: str, raw: bytes) -> np.ndarray:
    (tmp_path / name).write_bytes(raw)
    r = spark.read.format("image").load(str(tmp_path / name)).select("image.*").first()
    assert r is not None, "no decoder took it"
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1]


def _pictures():
    rng = np.random.default_rng(7)
    text = np.zeros((90, 700), bool)
    for _ in range(150):
        y, x = rng.integers(0, 85), rng.integers(0, 690)
        text[y : y + rng.integers(1, 9), x : x + rng.integers(1, 40)] = True
    wide = np.zeros((6, 6000), bool)
    wide[1, 5:5900] = wide[2, 2600:2664] = wide[4, :3] = wide[5] = True
    runs = np.zeros((70, 5400), bool)
    for n in range(70):  # each length of either colour, and each multiple of 64
        runs[n, n : 2 * n + 1] = True
        runs[n, 200 + 64 * n : 200 + 128 * n] = True
    return [text, wide, runs, rng.random((40, 41)) < 0.5, np.ones((3, 9), bool), np.zeros((2, 1), bool)]


def test_fax_codes_are_free_of_prefixes():
    for codes in (codecs.WHITE + codecs.LONG, codecs.BLACK + codecs.LONG, [*codecs.VERTICAL.values(), codecs.PASS, codecs.HORIZONTAL]):
        assert not any(a != b and b.startswith(a) for a in codes for b in codes) and len(set(codes)) == len(codes)
    assert (len(codecs.WHITE), len(codecs.BLACK), len(codecs.LONG)) == (91, 91, 13)


@pytest.mark.parametrize("k", range(6))
def test_fax(spark, tmp_path, k):
    black = _pictures()[k]
    assert (codecs.fax_decode(codecs.fax_encode(black), black.shape[1], black.shape[0]) == black).all()
    assert (codecs.fax_decode(codecs.fax_encode(black), black.shape[1]) == black).all()  # its own end
    got = _decoded(spark, tmp_path, "a.tif", _tiff(black))
    assert ((got[..., 0] == 0) == black).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(0, 6), st.randoms(use_true_random=False))
def test_fax_round_trip(width, height, r):
    black = np.array([[r.random() < 0.4 for _ in range(width)] for _ in range(height)], bool).reshape(height, width)
    assert (codecs.fax_decode(codecs.fax_encode(black), width) == black).all()


def test_fax_cut_off():
    black = _pictures()[0]
    some = codecs.fax_decode(codecs.fax_encode(black)[:300], black.shape[1], black.shape[0])
    assert 0 < len(some) < len(black) and (some == black[: len(some)]).all()


@pytest.mark.parametrize("shape", [(64, 64, 3), (37, 51, 3), (1, 1, 3), (16, 17), (100, 9), (200, 300, 3)])
def test_jpeg(spark, tmp_path, shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = 128 + 100 * np.sin(x / 17) * np.cos(y / 13)
    if len(shape) == 3:
        image = np.stack([image, 255 - image, (x + y) % 256 / 2 + 60], axis=2)
    image = image.astype(np.uint8)
    got = _decoded(spark, tmp_path, "a.jpg", codecs.jpeg_encode(image, 0.95))
    assert got.shape[:2] == shape[:2]
    want = image if len(shape) == 3 else np.repeat(image[..., None], got.shape[2], 2)
    assert np.abs(got.astype(int) - want).mean() < 3


def test_jpeg_of_noise(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (120, 90), dtype=np.uint8)
    image[:40] = 255
    sizes = [len(codecs.jpeg_encode(image, q)) for q in (0.1, 0.5, 0.85, 1.0)]
    assert sizes == sorted(sizes)
    got = _decoded(spark, tmp_path, "a.jpg", codecs.jpeg_encode(image, 1.0))[..., 0]
    assert np.abs(got.astype(int) - image).max() <= 3
    with pytest.raises(ValueError):
        codecs.jpeg_encode(np.zeros((0, 4), np.uint8), 0.5)


def test_profile(spark):
    raw = codecs.srgb_profile()
    jvm = spark._jvm.java.awt
    made = jvm.color.ICC_Profile.getInstance(bytearray(raw))
    assert made.getNumComponents() == 3
    space = jvm.color.ICC_ColorSpace(made)
    floats = spark._sc._gateway.new_array(spark._jvm.float, 3)
    for c, v in enumerate((0.2, 0.5, 0.9)):
        floats[c] = v
    assert [round(v, 2) for v in space.toRGB(floats)] == [0.2, 0.5, 0.9]
