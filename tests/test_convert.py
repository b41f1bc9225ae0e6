"""Files to searchable documents, from the command line on."""

import json

import numpy as np
import pytest

from inkspan.__main__ import main
from inkspan.operators import engines
from inkspan.plans import convert as C
from inkspan.sources import codecs, pdf
from inkspan.sources import pdf_objects as P


def _page(height: int, width: int) -> np.ndarray:
    """Dark bars on a light ground."""
    page = np.full((height, width), 230, np.uint8)
    for y in range(20, height - 20, 30):
        page[y : y + 12, 15 : width - 40] = 15
    return page


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "shot.jpg").write_bytes(codecs.jpeg_encode(_page(150, 200), 0.95))
    words = [("alpha", 10.0, 700.0, 12.0, 1.0), ("beta", 60.0, 700.0, 12.0, 1.0), ("gamma", 10.0, 650.0, 12.0, 1.0)]
    page = {"width": 612.0, "height": 792.0, "words": words, "background": (200, 150, _page(150, 200).tobytes())}
    (at / "scan.pdf").write_bytes(pdf.write_pdf([page, page | {"words": []}], {"Title": "T"}, outline=[("one", 0)]))
    return at


def test_text_and_boxes(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    assert main([f"file://{folder}", "-o", f"file://{out}", "--mrc-only", "--pdfa", "--dpi", "144"]) == 0
    listed = dict(line.split("\t") for line in capsys.readouterr().out.splitlines())
    assert {n: (out / n).stat().st_size for n in listed} == {n: int(v) for n, v in listed.items()} and len(listed) == 4
    made = {n: out / n for n in listed}
    (scan,) = (p for n, p in made.items() if "scan" in n and n.endswith(".pdf"))
    doc = P.Document(scan.read_bytes())
    first, second = doc.pages()
    assert "".join(g[0] for g in P.placed_glyphs(doc, first)) == "alphabetagamma" and not list(P.placed_glyphs(doc, second))
    pictures = {p[0]: p for p in P.pictures(doc, first)}
    mask = np.frombuffer(pictures["ma"][5], np.uint8).reshape(150, 200)
    assert ((mask == 0) == (_page(150, 200) < 100)).all() and pictures["ba"][4] == "jpeg" and pictures["ba"][1] == 66
    assert P.said(doc.get(doc.trailer["Info"])["Title"]) == "T" and "Outlines" in doc.catalog and "OutputIntents" in doc.catalog
    (text,) = (p for n, p in made.items() if n.endswith(".txt"))
    assert text.read_text().split() == ["page", "1", "======", "alpha", "beta", "gamma"]
    (boxes,) = (json.loads(p.read_text()) for n, p in made.items() if n.endswith(".json"))
    assert [w["word"] for w in boxes[0]["words"]] == ["alpha", "beta", "gamma"] and boxes[0]["page"] == 1
    assert abs(boxes[0]["words"][0]["x1"] - 20) <= 1


def test_engine_and_faults(spark, folder, tmp_path, capsys):
    seen = lambda content, given: [(content[:2].decode(), 30, 40, 50, 12, 90.0)]
    engines.ENGINES["seen"] = seen
    try:
        (folder / "bad.pdf").write_bytes(b"no")
        out = tmp_path / "out"
        assert main([f"file://{folder}", "-o", f"file://{out}", "--ocr-engine", "seen", "--no-mrc"]) == 1
        said = capsys.readouterr()
        assert "bad.pdf" in said.err and "not a PDF" in said.err
        shot = next(p for p in out.iterdir() if "shot" in p.name and p.suffix == ".pdf")
        doc = P.Document(shot.read_bytes())
        (page,) = doc.pages()
        assert "".join(g[0] for g in P.placed_glyphs(doc, page)) == "P5"
        assert [p[0] for p in P.pictures(doc, page)] == ["ba"] and doc.box(page)[2:] == (48.0, 36.0)
    finally:
        del engines.ENGINES["seen"]
    assert main([f"file://{folder}", "-o", f"file://{tmp_path}/x", "--ocr-engine", "missing"]) == 1


def test_pages_of_one_name_and_empty_pages(spark, folder, tmp_path):
    (folder / "b").mkdir()
    (folder / "b" / "shot.jpg").write_bytes((folder / "shot.jpg").read_bytes())
    with pytest.raises(ValueError, match="one name"):
        C.convert(spark, str(folder), str(tmp_path / "x"), engine=None)
    got = {(r.doc.rsplit("/", 1)[1], r.page): (r.width, r.height, r.channels) for r in C.page_rasters(spark, str(folder)).collect()}
    assert got[("scan.pdf", 0)] == got[("scan.pdf", 1)] == (200, 150, 1) and got[("shot.jpg", 0)][:2] == (200, 150)
    none = C.layered(spark.createDataFrame([], C.PAGE))
    assert none.count() == 0
    blank = spark.createDataFrame([("d", 0, 8, 8, 1, bytearray(b"\xff" * 64))], C.PAGE)
    r = C.layered(blank).first()
    assert r.background.width >= 1 and r.width == 8 * 72 / 300
