"""Sources, sinks, settings, engines and the stream."""

import json
import struct
import zlib

import numpy as np
import pytest

from inkspan.operators import engines
from inkspan.plans import settings
from inkspan.sources import pdf, readers, sinks
from inkspan.streaming import inbox


def png(dpi=None):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    phys = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + phys + chunk(b"IDAT", zlib.compress(b"\0\1\2\0\3\4")) + chunk(b"IEND", b"")


def tiff(frames, dpi):
    out = b"II*\0" + struct.pack("<I", 8)
    for i in range(frames):
        at = len(out)
        after = at + 2 + 12 * 2 + 4
        out += struct.pack("<H", 2) + struct.pack("<HHII", 282, 5, 1, after) + struct.pack("<HHIHH", 296, 3, 1, 2, 0) + struct.pack("<I", after + 8 if i + 1 < frames else 0) + struct.pack("<II", dpi, 1)
    return out


def test_pictures(spark, tmp_path):
    for name, content in (("a.png", png(300)), ("b.PNG", png()), ("c.tif", tiff(3, 200)), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    rows = readers.picture_pages(readers.read_pictures(spark, str(tmp_path)), dpi=72).collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.page_idx, round(r.dpi)) for r in rows)
    assert got == [("a.png", 0, 300), ("b.PNG", 0, 72), ("c.tif", 0, 200), ("c.tif", 1, 200), ("c.tif", 2, 200)]
    assert readers.resolution(b"BM" + b"\0" * 10) is None


def test_tiff_frames(spark, tmp_path):
    """Plain, Deflate and PackBits strips of gray, colour and one-bit frames; an unknown coding is left out."""
    rng = np.random.default_rng(1)
    gray, colour, bits = rng.integers(0, 256, (3, 5, 1), np.uint8), rng.integers(0, 256, (2, 4, 3), np.uint8), rng.integers(0, 2, (4, 11), np.uint8)
    runs = lambda raw: b"".join(bytes([0, x]) for x in raw[:3]) + bytes([len(raw) - 4]) + raw[3:]
    frames = [(gray, 8, 1, 1, [gray[:2].tobytes(), gray[2:].tobytes()]), (colour, 8, 8, 2, [zlib.compress(colour.tobytes())]), (bits, 1, 32773, 0, [runs(np.packbits(bits, axis=1).tobytes())]), (gray, 8, 7, 1, [b"x"])]
    for e in "<>":
        out = (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8)
        for n, (x, depth, coding, meaning, strips) in enumerate(frames):
            after = len(out) + 2 + 12 * 8 + 4
            data = after + 8 * len(strips)
            places = [data + sum(map(len, strips[:i])) for i in range(len(strips))]
            held = struct.pack(e + f"{2 * len(strips)}I", *places, *map(len, strips)) + b"".join(strips)
            field = lambda tag, v, e=e: struct.pack(e + "HHII", tag, 4, 1, v)
            many = lambda tag, at, one, k=len(strips), e=e: struct.pack(e + "HHII", tag, 4, k, at if k > 1 else one)
            out += struct.pack(e + "H", 8) + field(256, x.shape[1]) + field(257, x.shape[0]) + field(258, depth) + field(259, coding) + field(262, meaning)
            out += many(273, after, places[0]) + field(277, x.shape[2] if x.ndim == 3 else 1) + many(279, after + 4 * len(strips), len(strips[0]))
            out += struct.pack(e + "I", data + sum(map(len, strips)) if n + 1 < len(frames) else 0) + held
        (tmp_path / f"{'le' if e == '<' else 'be'}.tif").write_bytes(out)
    (tmp_path / "x.png").write_bytes(png())
    rows = readers.tiff_pages(readers.read_pictures(spark, str(tmp_path))).collect()
    assert len(rows) == 6 and readers._unpacked_runs(b"\xfe\x07\x80\x01ab") == b"\7\7\7ab"
    want = [gray, colour, (255 - bits * 255)[:, :, None]]
    assert all((r.height, r.width, r.channels) == want[r.page_idx].shape and bytes(r.pixels) == want[r.page_idx].tobytes() for r in rows)


def test_tsv(spark, tmp_path):
    line = "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.5\tword"
    (tmp_path / "p.tsv").write_text("\n".join(["level\tpage", line, "", line.replace("5\t", "4\t", 1), line.replace("10", "x"), "5\t1", line.replace("word", " ")]))
    rows = readers.read_tsv(spark, str(tmp_path / "p.tsv")).collect()
    assert [(r.word, r.x, r.y, r.width, r.height, r.confidence) for r in rows] == [("word", 10, 20, 30, 40, 96.5)]
    assert engines.words_of_tsv((tmp_path / "p.tsv").read_text()) == [("word", 10, 20, 30, 40, 96.5)]


def test_truth_texts_and_dictionary(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"source": "s", "title": "t", "pages": [{"page": 1, "words": ["a", "b\n"]}, {"page": 2, "words": []}]}))
    assert [(r.page, r.words) for r in readers.read_truth(spark, str(tmp_path / "t.json")).orderBy("page").collect()] == [(1, ["a", "b\n"]), (2, [])]
    (tmp_path / "d.txt").write_text("a\nb\n")
    assert readers.read_dictionary(spark, [str(tmp_path / "none"), str(tmp_path / "d.txt")]) == ["", "a", "b", " "]
    assert readers.read_texts(spark, str(tmp_path / "d.txt")).first().text == "a\nb\n"


def test_sinks(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 1, "b", 5, 6, 7, 8), (1, 0, 0, "a", 1, 2, 3, 4)], "doc int, page int, nth int, word string, x long, y long, width long, height long")
    text = sinks.page_text(words, ["doc", "page"], order=["nth"])
    assert text.first().text == "page 1\n======\na b \n\n"
    sinks.write_text(text, str(tmp_path / "text"))
    assert "".join(p.read_text() for p in (tmp_path / "text").glob("part*")) == "page 1\n======\na b \n\n"
    boxes = json.loads(sinks.box_json(words, ["doc"], order="nth").first().json)
    assert boxes[0] == {"word": "a", "x1": 1, "y1": 2, "x2": 4, "y2": 6}
    sinks.write_json(sinks.box_json(words, ["doc"], order="nth"), str(tmp_path / "json"))
    sinks.write_metrics(words.select("doc", "word"), str(tmp_path / "m"))
    for _ in range(2):
        sinks.append_report(words.select("doc", "word"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 4


def test_pdf_round_trip(spark):
    words = [("brown", 72.0, 700.0, 12.0, 0.95), ("漢字\U0001f600", 10.5, 20.25, 1.0, 1.0)]
    page = {"width": 612.0, "height": 792.0, "words": words, "background": (4, 4, bytes(range(16))), "mask": (8, 2, b"\x0f\xf0")}
    raw = pdf.write_pdf([page, {"width": 100.0, "height": 50.0}], {"Title": "Ünder", "Producer": "A -> B", "Other": "x"})
    back = pdf.read_pdf(raw)
    assert back["info"] == {"Title": "Ünder", "Producer": "A -> B"}
    assert back["pages"][0]["words"] == words and (back["pages"][1]["width"], back["pages"][1]["words"]) == (100.0, [])
    b = spark.createDataFrame([(1, 0, "x", 0, 0, 70, 11), (1, 1, "yz", 80, 0, 20, 11)], "doc int, nth int, word string, x long, y long, width long, height long")
    out = pdf.pdf_words(pdf.pdf_documents(b, "doc"), "doc").orderBy("nth").collect()
    assert [r.word for r in out] == ["x", "yz"] and out[1].tx == pytest.approx(19.2)


def test_pdf_preserve():
    """Outline, notes, files and metadata go over; pictures and words stay; what has no page is left out."""
    words = [("w", 1.0, 2.0, 3.0, 1.0)]
    page = {"width": 612.0, "height": 792.0, "words": words, "background": (4, 4, bytes(range(16))), "mask": (8, 2, b"\x0f\xf0")}
    note = (10.0, 20.0, 30.0, 40.0, "sée")
    xmp = "<rdf:Description><pdfaid:part>1</pdfaid:part></rdf:Description><rdf:Description></rdf:Description>"
    size = {"width": 1.0, "height": 1.0}
    files = [("a.txt", b""), ("b.bin", b"\nendobj\nstream\n" * 3)]
    source = pdf.write_pdf([size | {"notes": [note]}, size, size | {"notes": [note]}], {"Title": "T", "Producer": "Old"}, outline=[("one", 0), ("twö", 1), ("three", 2)], files=files[::-1], xmp=xmp)
    assert pdf.read_pdf(source)["files"] == files and pdf.read_pdf(source)["xmp"] == xmp
    back = pdf.read_pdf(pdf.preserve(source, pdf.write_pdf([page, page], {"Creator": "C"}), "New"))
    assert back["info"] == {"Title": "T", "Producer": "Old -> New", "Creator": "C"}
    assert back["outline"] == [("one", 0), ("twö", 1)] and back["files"] == files
    assert [p["notes"] for p in back["pages"]] == [[note], []] and back["pages"][0] == page | {"notes": [note]}
    assert back["xmp"] == xmp.replace("</rdf:Description>", "<pdfaid:conformance>B</pdfaid:conformance></rdf:Description>", 1)
    bare = pdf.read_pdf(pdf.preserve(pdf.write_pdf([]), pdf.write_pdf([size]), "New"))
    assert (bare["info"], bare["outline"], bare["files"]) == ({"Producer": "New"}, [], []) and "<pdfaid:part>2</pdfaid:part>" in bare["xmp"]


def test_settings():
    text = '{ // c\n "dpi": 200, /* x */ "url": "http://a/*b*/", "engine": null }'
    assert settings.load(text, {"dpi": 150, "language": None}) == settings.DEFAULTS | {"dpi": 150, "url": "http://a/*b*/", "engine": None}
    assert settings.load(None) == settings.load("  ") == settings.DEFAULTS


def test_engines(spark):
    engines.ENGINES["fixed"] = lambda content, given: [(content.decode(), 1, 2, 3, 4, given["c"])] * 2
    rows = engines.recognise(spark.createDataFrame([(7, bytearray(b"hi")), (8, bytearray(b"yo"))], "page int, content binary"), "fixed", {"c": 5.0}).collect()
    assert sorted((r.page, r.word, r.confidence) for r in rows) == [(7, "hi", 5.0)] * 2 + [(8, "yo", 5.0)] * 2
    with pytest.raises(ValueError, match="no engine"):
        engines.recognise(spark.createDataFrame([], "content binary"), "nope")
    assert engines.run_program(["sh", "-c", "echo out; echo err >&2; exit 42"]) == (42, "out\n", "err\n")
    assert len(engines.run_program(["sh", "-c", "head -c 200000 /dev/zero"])[1]) == 200000


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(300))
    stream = readers.picture_pages(inbox.watch(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_settings_stop_at_the_first_bad_token():
    from inkspan.plans.settings import DEFAULTS, load

    own = lambda text: {k: v for k, v in load(text).items() if DEFAULTS.get(k) != v}
    assert own(r'{"dpi": 200, /* finer */ "engine": "a//b", /* x */ "n": null, "s": "\u00e9\"", "f": -1.5e2, "t": true}') == {"dpi": 200, "engine": "a//b", "s": 'é"', "f": -150.0, "t": True}
    assert own('{"dpi": 200, "engine": oops, "tile": 5}') == {"dpi": 200} and own('{"dpi": 200 "tile": 5}') == {}
    assert own("{}") == own("") == own("[1]") == own('{"a') == own(None) == {}


def test_pictures_by_pattern_and_decoded(spark, tmp_path):
    from inkspan.sources.readers import read_pictures, read_rasters

    def png(w, h, rgb):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(rgb) * w for _ in range(h)))) + part(b"IEND", b"")

    (tmp_path / "a1.png").write_bytes(png(3, 2, (1, 2, 3)))
    (tmp_path / "b1.png").write_bytes(png(1, 1, (9, 9, 9)))
    (tmp_path / "a2.png").write_bytes(b"not a picture")
    assert sorted(r.path.rsplit("/", 1)[1] for r in read_pictures(spark, str(tmp_path), pattern="a*").collect()) == ["a1.png", "a2.png"]
    (r,) = read_rasters(spark, str(tmp_path), pattern="a*").collect()
    assert (r.width, r.height, r.channels, bytes(r.pixels)) == (3, 2, 3, bytes((3, 2, 1)) * 6)


def test_truth_round_trip(spark, tmp_path):
    from inkspan.sources.readers import read_truth
    from inkspan.sources.sinks import truth_json, write_json

    rows = [("s", "t", 2, ["b\\", 'c"']), ("s", "t", 1, ["a\n", "\t", "é"]), ("q", "u", 1, [])]
    write_json(truth_json(spark.createDataFrame(rows, "source string, title string, page int, words array<string>")), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in read_truth(spark, str(tmp_path / "t"), lines=True).collect()) == sorted(rows)


def test_files_by_others_give_an_error_and_no_end(spark):
    ours = pdf.write_pdf([{"width": 10, "height": 10, "words": [("a", 1, 1, 1, 1)]}, {"width": 10, "height": 10}])
    other = b"%PDF-1.4\n1 0 obj <</Type /Page /Parent 2 0 R>> endobj 3 0 obj <</Type/Page>> endobj 2 0 obj <</Type /Pages>> endobj\ntrailer <<>>\n%%EOF"
    docs = spark.createDataFrame([(1, bytearray(ours)), (2, bytearray(other)), (3, bytearray(b"text")), (4, None), (5, bytearray(ours[:200]))], "doc int, content binary")
    out = sorted((r.doc, r.page, r.words, r.error is None) for r in pdf.pdf_pages(docs, "doc").collect() if r.doc != 5)
    assert out[:3] == [(1, 1, 1, True), (1, 2, 0, True), (2, 2, None, False)] and [r[3] for r in out[3:]] == [False, False]
    assert [r.word for r in pdf.pdf_words(docs, "doc").collect()] == ["a"]


def test_files_are_put_in_place_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", bytearray(b"one")), ("b.pdf", bytearray(b""))], "name string, content binary")
    for _ in range(2):
        assert sorted(tuple(r) for r in pdf.write_files(rows, f"file://{tmp_path}/out").collect()) == [("a.pdf", 3), ("b.pdf", 0)]
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {"a.pdf": b"one", "b.pdf": b""}
