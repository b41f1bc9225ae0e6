"""Searchable PDF: a small writer and a reader of what it writes.

A document is written in one group: pages with an optional gray background (a
Flate stream), an optional stencil mask over it and the words as invisible text
(mode 3). Besides pages it may hold an outline, notes on pages, attached files
and metadata, which ``preserve`` carries from one document to another. ``read_pdf``
walks the same structure; documents by others are read by ``pdf_objects``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.sources.codecs import fax_decode, fax_encode, jpeg_encode, srgb_profile
from inkspan.sources.pdf_objects import INFO, Document, Name, Stream, carried, said

# fixed values: the fields of the info dictionary and the namespaces of its metadata
BARE_XMP = (
    '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    '<rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"></rdf:Description></rdf:RDF></x:xmpmeta>'
)
#: Quality of a background's JPEG, without and under a mask.
QUALITY = (0.85, 0.50)


def _text(s: str, mark: bytes = b"feff") -> bytes:
    return b"<" + mark + s.encode("utf-16-be").hex().encode() + b">"


def _list(key: bytes, of: list[int]) -> bytes:
    return b" /%s [%s]" % (key, b" ".join(b"%d 0 R" % k for k in of)) if of else b""


def _number(x: float) -> bytes:
    return f"{x:.4f}".rstrip("0").rstrip(".").encode() or b"0"


def _units() -> bytes:
    """A map of codes to Unicode for text that is written in UTF-16 units: each stands for itself."""
    rows = [b"<%02x00> <%02xff> <%02x00>" % (k, k, k) for k in range(256)]
    parts = [b"%d beginbfrange\n" % len(some) + b"\n".join(some) + b"\nendbfrange\n" for some in (rows[k : k + 100] for k in range(0, 256, 100))]
    return (
        b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Units def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n"
        + b"".join(parts)
        + b"endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend\n"
    )


def _picture(p: dict, name: str, coded: bool) -> tuple[bytes, bytes]:
    """Head and data of a page's picture; ``coded``: a JPEG, or fax data for a mask, else packed without loss."""
    w, h, data = p[name]
    head = b"/Type /XObject /Subtype /Image /Width %d /Height %d " % (w, h)
    if name == "background":
        colors = 3 if w * h and len(data) == 3 * w * h else 1
        head += b"/ColorSpace /Device%s /BitsPerComponent 8" % (b"RGB" if colors == 3 else b"Gray")
        if coded and w and h and len(data) == w * h * colors:
            return head + b" /Filter /DCTDecode", jpeg_encode(np.frombuffer(data, np.uint8).reshape(h, w, colors), QUALITY[bool(p.get("mask"))])
    else:
        head += b"/ImageMask true /BitsPerComponent 1"
        row = -(-w // 8)
        if coded and w and h and len(data) == row * h:
            black = np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, row), axis=1)[:, :w] == 0
            return head + b" /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns %d /Rows %d >>" % (w, h), fax_encode(black)
    return head + b" /Filter /FlateDecode", zlib.compress(data)


def write_pdf(pages: list[dict], info: dict[str, str] | None = None, *, outline: list[tuple[str, int]] = (), files: list[tuple[str, bytes]] = (), xmp: str | None = None, coded: bool = False) -> bytes:
    """Bytes of a document.

    A page: width, height (points); words: (text, x, y, size, stretch);
    background (gray or three colours), mask (a bit a pixel, 0 is painted):
    (width, height, bytes); notes: (x, y, width, height, text). ``outline``
    holds titles with the page (from 0) that each leads to, ``files`` names
    with contents. ``coded`` writes backgrounds as JPEG and masks as fax data
    (group 4), else both are packed without loss.
    """
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> int:
        z = zlib.compress(data)
        return add(b"<< " + head + b" /Filter /FlateDecode /Length %d >>\nstream\n" % len(z) + z + b"\nendstream")

    catalog, tree = add(b""), add(b"")
    units = stream(b"", _units())
    font = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /ToUnicode %d 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>] >>" % units)
    kids = []
    for p in pages:
        content, pictures = [], []
        for name in ("background", "mask"):
            if p.get(name):
                head, data = _picture(p, name, coded)
                pictures.append(b"/%s %d 0 R" % (name[:2].encode(), add(b"<< " + head + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream")))
                content.append(b"q %s 0 0 %s 0 0 cm /%s Do Q" % (_number(p["width"]), _number(p["height"]), name[:2].encode()))
        for text, x, y, size, stretch in p.get("words", ()):
            content.append(b"BT 3 Tr /F1 %s Tf %s 0 0 1 %s %s Tm %s Tj ET" % (_number(size), _number(stretch), _number(x), _number(y), _text(text, b"")))
        body = stream(b"", b"\n".join(content))
        notes = [add(b"<< /Type /Annot /Subtype /Text /Rect [%s] /Contents %s >>" % (b" ".join(map(_number, (x, y, x + w, y + h))), _text(said))) for x, y, w, h, said in p.get("notes", ())]
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %s %s] /Resources << /Font << /F1 %d 0 R >> /XObject << %s >> >> /Contents %d 0 R%s >>" % (tree, _number(p["width"]), _number(p["height"]), font, b" ".join(pictures), body, _list(b"Annots", notes))))
    more = b""
    if outline:
        root, first = len(objects) + 1, len(objects) + 2
        add(b"<< /Type /Outlines /Count %d /First %d 0 R /Last %d 0 R >>" % (len(outline), first, first + len(outline) - 1))
        for n, (title, page) in enumerate(outline):
            near = b"".join(b" /%s %d 0 R" % (k, first + at) for k, at in ((b"Prev", n - 1), (b"Next", n + 1)) if 0 <= at < len(outline))
            add(b"<< /Title %s /Parent %d 0 R /Dest [%d 0 R /Fit]%s >>" % (_text(title), root, kids[page], near))
        more += b" /Outlines %d 0 R" % root
    if files:
        held = [(name, stream(b"/Type /EmbeddedFile", data)) for name, data in sorted(files, key=lambda f: _text(f[0]))]
        specs = [(name, add(b"<< /Type /Filespec /F %s /UF %s /EF << /F %d 0 R >> >>" % (_text(name), _text(name), at))) for name, at in held]
        more += b" /Names << /EmbeddedFiles << /Names [%s] >> >>" % b" ".join(b"%s %d 0 R" % (_text(name), at) for name, at in specs)
    if xmp is not None:
        data = xmp.encode()
        more += b" /Metadata %d 0 R" % add(b"<< /Type /Metadata /Subtype /XML /Length %d >>\nstream\n" % len(data) + data + b"\nendstream")
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, more)
    about = add(b"<< " + b" ".join(b"/%s %s" % (k.encode(), _text(v)) for k, v in (info or {}).items() if k in INFO and v is not None) + b" >>")
    out, places = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, about, len(out))


def read_pdf(raw: bytes) -> dict:
    """What ``write_pdf`` wrote: info, outline, files, xmp, and of each page its size, words, notes and pictures."""
    start = int(re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", raw)[1])
    n = int(re.match(rb"xref\n0 (\d+)\n", raw[start:])[1])
    head = raw.index(b"\n", raw.index(b"\n", start) + 1) + 1
    at = [int(raw[head + 20 * i : head + 20 * i + 10]) for i in range(n)]
    ref = lambda key, b: (m := re.search(rb"/%s (\d+) 0 R" % key, b)) and int(m[1])
    refs = lambda key, b: [int(k) for k in re.findall(rb"(\d+) 0 R", m[1])] if (m := re.search(rb"/%s \[(.*?)\]" % key, b, re.S)) else []
    text = lambda key, b: _plain(re.search(rb"/%s <([0-9a-f]*)>" % key, b)[1])
    own = lambda i: _object(raw, at[i])

    trailer = raw[raw.rindex(b"trailer") :]
    info = {k.decode(): _plain(v) for k, v in re.findall(rb"/(\w+) <([0-9a-f]*)>", own(ref(b"Info", trailer))[0])}
    catalog = own(ref(b"Root", trailer))[0]
    kids = refs(b"Kids", own(ref(b"Pages", catalog))[0])
    pages = []
    for k in kids:
        page = own(k)[0]
        box = [float(v) for v in re.search(rb"/MediaBox \[(.*?)\]", page)[1].split()]
        content = own(ref(b"Contents", page))[1]
        words = [(_plain(t), float(x), float(y), float(s), float(f)) for s, f, x, y, t in re.findall(rb"/F1 (\S+) Tf (\S+) 0 0 1 (\S+) (\S+) Tm <([0-9a-f]*)> Tj", content)]
        notes = []
        for note in (own(i)[0] for i in refs(b"Annots", page)):
            x0, y0, x1, y1 = (float(v) for v in re.search(rb"/Rect \[(.*?)\]", note)[1].split())
            notes.append((x0, y0, x1 - x0, y1 - y0, text(b"Contents", note)))
        pictures = {}
        for name in ("background", "mask"):
            if i := ref(name[:2].encode(), page):
                head, data = own(i)
                w, h = (int(re.search(rb"/%s (\d+)" % side, head)[1]) for side in (b"Width", b"Height"))
                pictures[name] = (w, h, np.packbits(~fax_decode(data, w, h), axis=1).tobytes() if b"/CCITTFaxDecode" in head else data)
        pages.append({"width": box[2], "height": box[3], "words": words, "notes": notes} | pictures)
    outline, item = [], (top := ref(b"Outlines", catalog)) and ref(b"First", own(top)[0])
    while item and len(outline) < n:
        entry = own(item)[0]
        outline.append((text(b"Title", entry), kids.index(refs(b"Dest", entry)[0])))
        item = ref(b"Next", entry)
    files = []
    for name, spec in re.findall(rb"<([0-9a-f]*)> (\d+) 0 R", catalog.partition(b"/EmbeddedFiles")[2]):
        files.append((_plain(name), own(ref(b"F", own(int(spec))[0]))[1]))
    meta = ref(b"Metadata", catalog)
    return {"info": info, "pages": pages, "outline": outline, "files": files, "xmp": own(meta)[1].decode() if meta else None}


def _plain(hexed: bytes) -> str:
    return bytes.fromhex(hexed.decode()).decode("utf-16-be").removeprefix("\ufeff")


def _object(raw: bytes, at: int) -> tuple[bytes, bytes]:
    """An object's own text and what its stream holds; the stream's length decides where it ends, since the data may hold any bytes."""
    begin = raw.index(b" obj\n", at) + 5
    end = raw.index(b"\nendobj\n", begin)
    data = raw.find(b"stream\n", begin, end)
    if data < 0:
        return raw[begin:end], b""
    head = raw[begin:data]
    held = raw[data + 7 : data + 7 + int(re.search(rb"/Length (\d+)", head)[1])]
    return head, zlib.decompress(held) if b"/FlateDecode" in head else held


def with_conformance(xmp: str | None, part: str = "2", level: str = "B") -> str:
    """Metadata that names its archival conformance; what it says already stays."""
    xmp = xmp if xmp and "</rdf:Description>" in xmp else BARE_XMP
    for tag, value in (("part", part), ("conformance", level)):
        if f"<pdfaid:{tag}>" not in xmp:
            xmp = xmp.replace("</rdf:Description>", f"<pdfaid:{tag}>{value}</pdfaid:{tag}></rdf:Description>", 1)
    return xmp


def _intent() -> dict:
    """The colours that a document's are meant as."""
    z = zlib.compress(srgb_profile())
    intent = {"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1")} | {k: b"sRGB IEC61966-2.1" for k in ("Info", "OutputCondition", "OutputConditionIdentifier")}
    return {"OutputIntents": [intent | {"RegistryName": b"http://www.color.org", "DestOutputProfile": Stream({"N": 3, "Filter": Name("FlateDecode")}, z)}]}


def preserve(source: bytes, made: bytes, producer: str) -> bytes:
    """``made`` with what ``source`` holds beside its pages' contents (see ``carried``), whoever wrote it.

    Metadata names its archival conformance, and the catalog the colours meant
    (sRGB).
    """
    return carried(source, made, producer, with_conformance, _intent())[0]


def pdf_documents(boxes: DataFrame, doc: str, *, scale: float = 0.24, height: float = 792.0, width: float = 612.0, order: str = "nth") -> DataFrame:
    """doc, content: a one-page document of each one's word boxes (pixels), its words placed invisibly."""
    kind = dict(boxes.dtypes)[doc]

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r[order])
        words = [placed(r, scale, height) for r in rows]
        return pa.table({doc: t[doc].slice(0, 1), "content": pa.array([write_pdf([{"width": width, "height": height, "words": words}])], pa.binary())})

    return boxes.select(doc, order, "word", "x", "y", "width", "height").groupBy(doc).applyInArrow(run, f"{doc} {kind}, content binary")


def assembled(boxes: DataFrame, pages: DataFrame, doc: str, *, scale: float = 0.24, order: str = "nth", coded: bool = False) -> DataFrame:
    """doc, content: a document of each one's pages, in order.

    ``pages``: doc, page, width, height (points), background and mask (each
    null, or a struct of width, height, data); ``boxes``: doc, page, ``order``,
    word, x, y, width, height (pixels). A page's background comes first, the
    mask over it, its words invisibly over both; boxes of pages that aren't
    there are left out. ``coded`` is that of ``write_pdf``. One document is
    made in one task, as it is one file.
    """
    kind = dict(pages.dtypes)[doc]

    def run(pages: pa.Table, boxes: pa.Table) -> pa.Table:
        of: dict[int, list] = {}
        for r in sorted(boxes.to_pylist(), key=lambda r: r[order]):
            of.setdefault(r["page"], []).append(r)
        made = []
        for p in sorted(pages.to_pylist(), key=lambda r: r["page"]):
            words = [placed(r, scale, p["height"]) for r in of.get(p["page"], ())]
            picture = lambda x: (x["width"], x["height"], x["data"]) if x else None
            made.append({"width": p["width"], "height": p["height"], "words": words, "background": picture(p["background"]), "mask": picture(p["mask"])})
        return pa.table({doc: pages[doc].slice(0, 1) if made else pages[doc], "content": pa.array([write_pdf(made, coded=coded)] if made else [], pa.binary())})

    left = pages.select(doc, "page", "width", "height", "background", "mask").groupBy(doc)
    return left.cogroup(boxes.select(doc, "page", order, "word", "x", "y", "width", "height").groupBy(doc)).applyInArrow(run, f"{doc} {kind}, content binary")


def placed(r: dict, scale: float, height: float) -> tuple[str, float, float, float, float]:
    """A word's text, place, size and stretch on a page of ``height`` points."""
    size = max(1.0, r["height"] * scale)
    natural = len(r["word"]) * size * 0.5
    return r["word"], r["x"] * scale, height - (r["y"] + 0.75 * r["height"]) * scale, size, r["width"] * scale / natural if natural else 1.0


_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")


def opened(raw: bytes | None) -> tuple[dict | None, int | None, str | None]:
    """What ``read_pdf`` gives, the number of pages, and why there is none of the first.

    The pages of another writer's file are counted where its objects lie open;
    in compressed or encrypted ones they aren't.
    """
    if not raw or not raw.startswith(b"%PDF-"):
        return None, None, "not a PDF"
    try:
        found = read_pdf(raw)
        return found, len(found["pages"]), None
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, zlib.error, UnicodeDecodeError) as e:
        n = 0 if b"/Encrypt" in raw else len(_PAGE.findall(raw))
        return None, n or None, f"not read: {type(e).__name__}"


def pdf_pages(docs: DataFrame, doc: str) -> DataFrame:
    """doc, page (from 1), words, background and mask (bytes, null without), error: a row a page, or one with the error of a file that isn't read."""
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b["content"]):
                found, n, error = opened(raw.as_py())
                size = lambda p, k: len(p[k][2]) if k in p else None
                rows = [(k, len(p["words"]), size(p, "background"), size(p, "mask"), None) for k, p in enumerate(found["pages"], 1)] if found else [(n, None, None, None, error)]
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([b[doc].take(pa.array([i] * len(rows))), *cols], names=[doc, "page", "words", "background", "mask", "error"])

    return docs.select(doc, "content").mapInArrow(run, f"{doc} {kind}, page int, words int, background long, mask long, error string")


def write_files(docs: DataFrame, folder: str, *, name: str = "name") -> DataFrame:
    """name, length of files written into ``folder`` (a path or address that all executors reach), each put in place whole.

    A file is written beside its place and then moved there, so a task that is
    lost or run twice leaves no half a file. Evaluate the result to write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for b in batches:
            for n, raw in zip(b[name].to_pylist(), b["content"]):
                part = f"{base}/.{n}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(raw.as_buffer())
                files.move(part, f"{base}/{n}")
            yield pa.RecordBatch.from_arrays([b[name], pa.array([len(x.as_py()) for x in b["content"]], pa.int64())], names=[name, "length"])

    return docs.select(name, "content").mapInArrow(run, f"{name} string, length long")


def pdf_words(docs: DataFrame, doc: str) -> DataFrame:
    """doc, page (from 1), nth, word, tx, ty, font_size, stretch, read back from documents; those that aren't read give no rows (see ``pdf_pages``)."""
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, p, i, *w) for d, c in zip(b[doc].to_pylist(), b["content"].to_pylist()) for p, page in enumerate((opened(c)[0] or {"pages": ()})["pages"], 1) for i, w in enumerate(page["words"])]
            names = (doc, "page", "nth", "word", "tx", "ty", "font_size", "stretch")
            kinds = (b.schema.field(doc).type, pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return docs.select(doc, "content").mapInArrow(run, f"{doc} {kind}, page int, nth int, word string, tx double, ty double, font_size double, stretch double")


def preserved(docs: DataFrame, doc: str, *, source: str = "source", made: str = "made", producer: str = "inkspan") -> DataFrame:
    """doc, content, producer, outlines, notes, files, and whether metadata names its conformance: each ``made`` document with its ``source``'s elements.

    Where either isn't read, content is ``made`` as it is, the numbers are null
    and no conformance is named.
    """
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, m in zip(b[source].to_pylist(), b[made].to_pylist()):
                try:
                    content, n = carried(s or b"", m or b"", producer, with_conformance, _intent())
                    about = Document(content)
                    name = said(about.part(about.trailer["Info"], "Producer", bytes))
                    rows.append((content, name, n["outlines"], n["notes"], n["files"], b"<pdfaid:part>" in about.data(about.part(about.catalog, "Metadata", Stream))))
                except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
                    rows.append((m, None, None, None, None, False))
            cols = zip(*rows) if rows else [()] * 6
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b[doc], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[doc, "content", "producer", "outlines", "notes", "files", "archival"])

    return docs.select(doc, source, made).mapInArrow(run, f"{doc} {kind}, content binary, producer string, outlines int, notes int, files int, archival boolean")


def with_elements(docs: DataFrame, doc: str) -> DataFrame:
    """doc, made, source: beside each ``made`` document a one-page one with as many outline entries, notes and files as the columns say."""
    kind = dict(docs.dtypes)[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("producer", "outlines", "notes", "files")))
            source = [
                write_pdf(
                    [{"width": 612.0, "height": 792.0, "notes": [(10.0 * i, 20.0, 30.0, 40.0, f"note {i}") for i in range(notes)]}],
                    {"Producer": producer},
                    outline=[(f"part {i}", 0) for i in range(outlines)],
                    files=[(f"file {i}", bytes(range(256))) for i in range(files)],
                )
                for producer, outlines, notes, files in rows
            ]
            yield pa.RecordBatch.from_pydict({doc: b[doc], "made": b["made"], "source": pa.array(source, pa.binary())})

    return docs.select(doc, "made", "producer", "outlines", "notes", "files").mapInArrow(run, f"{doc} {kind}, made binary, source binary")
