"""Pictures and documents to searchable documents, with their text and word boxes: the page operators in one plan.

A page's picture comes from a picture file, a frame of one, or the largest
picture on a document's page; no page is rendered. Words come from an engine,
or with ``mrc_only`` from the document's own text. Pages stay one row each
until they meet as a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions.text import output_name
from inkspan.operators import layout, raster
from inkspan.operators.engines import recognise
from inkspan.sources import pdf, sinks
from inkspan.sources.pdf_objects import document_glyphs, document_pages, document_pictures
from inkspan.sources.readers import PICTURES, read_rasters, tiff_pages

PAGE = "doc string, page int, width int, height int, channels int, pixels binary"


def page_rasters(spark: SparkSession, path: str) -> DataFrame:
    """doc, page (from 0), width, height, channels, pixels (three or four channels as the source has them, blue first from picture files).

    Frames of TIFF files, other pictures, and of each page of a document the
    largest picture that has plain samples; pages without one give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    frames = tiff_pages(files.where(kind.isin("tif", "tiff"))).select(F.col("path").alias("doc"), F.col("page_idx").alias("page"), "width", "height", "channels", "pixels")
    shots = read_rasters(spark, path).where(~F.lower("path").rlike(r"\.tiff?$") & F.lower("path").rlike(rf"\.({'|'.join(PICTURES)})$"))
    shots = shots.select(F.regexp_replace("path", "^file:/+", "file:/").alias("doc"), F.lit(0).alias("page"), "width", "height", "channels", "pixels")
    scans = document_pictures(files.where(~kind.isin(*PICTURES)).withColumnRenamed("path", "doc"), "doc").where("coding = 'raw'")
    size = F.struct(F.col("width").cast("long") * F.col("height"), "name", "width", "height", "channels", F.col("data").alias("pixels"))
    scans = scans.groupBy("doc", "page").agg(F.max_by(F.struct("width", "height", "channels", F.col("data").alias("pixels")), size.getField("col1")).alias("p"))
    return frames.unionByName(shots).unionByName(scans.select("doc", (F.col("page") - 1).alias("page"), "p.*"))


def layered(pages: DataFrame, *, dpi: float = 300.0, mrc: bool = True, inpaint_radius: int = 3, background_scale: float = 0.33, blur_sigma: float = 0.8) -> DataFrame:
    """doc, page, width, height (points), background, mask (structs), content (the gray picture as PGM): one row a page, nothing shuffled.

    With ``mrc`` ink goes into the mask, and what is left is inpainted, made
    smaller and blurred in proportion; else the picture is the background.
    """
    picture = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
    schema = "doc string, page int, width double, height double, background struct<width:int,height:int,data:binary>, mask struct<width:int,height:int,data:binary>, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, h, c) in enumerate(zip(*(b[k].to_pylist() for k in ("width", "height", "channels")))):
                image = np.frombuffer(b["pixels"][i].as_buffer(), np.uint8)[: w * h * c].reshape(h, w, c)
                gray = raster.to_gray(image[..., 2::-1] if c > 2 else image).astype(np.int64)
                back, mask = gray, None
                if mrc:
                    ink = gray <= raster.otsu(raster.flatten_background(gray))
                    back = raster.scale_background(raster.inpaint(gray, ink, inpaint_radius), background_scale, bool(ink.any()))
                    if ink.any():
                        back = raster.gaussian_blur(back, blur_sigma)
                        mask = {"width": w, "height": h, "data": np.packbits(~ink, axis=1).tobytes()}
                yield pa.RecordBatch.from_arrays([
                    b["doc"].slice(i, 1), b["page"].slice(i, 1), pa.array([w * 72 / dpi]), pa.array([h * 72 / dpi]),
                    pa.array([{"width": back.shape[1], "height": back.shape[0], "data": back.astype(np.uint8).tobytes()}], picture), pa.array([mask], picture),
                    pa.array([b"P5 %d %d 255\n" % (w, h) + gray.astype(np.uint8).tobytes()], pa.binary()),
                ], names=["doc", "page", "width", "height", "background", "mask", "content"])

    return pages.select("doc", "page", "width", "height", "channels", "pixels").mapInArrow(run, schema)


def text_layer(documents: DataFrame, *, dpi: float = 300.0) -> DataFrame:
    """doc, page (from 0), nth, word, x, y, width, height, confidence: a document's own text as words, from its glyphs."""
    glyphs = document_glyphs(documents, "doc").withColumns({"page": F.col("page") - 1, "y": F.col("y") - 0.75 * F.col("height")})
    lines = layout.anchored_lines(glyphs, ["doc", "page"])
    words = layout.gap_words(lines, ["doc", "page", "line"])
    blocks = layout.char_blocks(words, ["doc", "page", "line", "word"], dpi=dpi)
    nth = F.row_number().over(Window.partitionBy("doc", "page").orderBy("line", "word"))
    return blocks.select("doc", "page", nth.alias("nth"), F.col("text").alias("word"), "x", "y", "width", "height", "confidence")


def convert(spark: SparkSession, path: str, out: str, *, engine: str | None = "tesseract", settings: dict | None = None, mrc: bool = True, mrc_only: bool = False, archival: bool = False) -> DataFrame:
    """name, length of what was written into the folder ``out``: a document, its text and its word boxes for each file that has pages.

    Without an ``engine`` pages have no words but those that ``mrc_only`` takes
    from documents' own text. ``archival`` names the conformance and carries a
    document's own elements over. Files of one name in two folders are an error.
    Evaluate the result to write; an empty folder writes nothing.
    """
    given = settings or {}
    dpi = float(given.get("dpi", 300))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("doc"), "content")
    pages = layered(page_rasters(spark, path), dpi=dpi, mrc=mrc or mrc_only, **{k: given[k] for k in ("inpaint_radius", "background_scale", "blur_sigma") if k in given})
    none = "doc string, page int, nth int, word string, x long, y long, width long, height long, confidence double"
    if mrc_only:
        words = text_layer(files.where(~F.lower(F.regexp_extract("doc", r"\.([^./]+)$", 1)).isin(*PICTURES)), dpi=dpi)
    elif engine:
        words = layout.reading_order(recognise(pages.select("doc", "page", "content"), engine, given), ["doc", "page"], order="word").withColumnRenamed("place", "nth")
    else:
        words = spark.createDataFrame([], none)
    made = pdf.assembled(words, pages, "doc", scale=72 / dpi, coded=True)
    if archival:
        source = made.withColumnRenamed("content", "made").join(files.withColumnRenamed("content", "own"), "doc", "left")
        empty = F.lit(pdf.write_pdf([]))
        source = source.withColumn("source", F.when(F.col("own").substr(1, 5) == F.lit(b"%PDF-"), F.col("own")).otherwise(empty))
        made = pdf.preserved(source, "doc").select("doc", "content")
    base = F.regexp_extract("doc", r"([^/]+)$", 1)
    names = files.select(output_name(base, ".pdf").alias("name")).groupBy("name").count()
    if twice := names.where("count > 1").limit(3).collect():
        raise ValueError(f"files of one name: {[r['name'] for r in twice]}")
    text = sinks.page_text(words, ["doc", "page"], order=["nth"]).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "").alias("t"))
    boxes = sinks.box_json(words, ["doc", "page"], order="nth").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "json"))).alias("pages"))
    # each page's boxes are JSON already
    listed = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: F.concat(F.lit('{"page":'), (p["page"] + 1).cast("string"), F.lit(',"words":'), p["json"], F.lit("}"))), ","), F.lit("]"))
    every = made.select(output_name(base, ".pdf").alias("name"), "content")
    every = every.unionByName(text.select(output_name(base, ".txt").alias("name"), F.col("t").cast("binary").alias("content")))
    every = every.unionByName(boxes.select(output_name(base, ".json").alias("name"), listed.cast("binary").alias("content")))
    return pdf.write_files(every, out)


def unread(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, error of documents and pages that aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("doc"), "content")
    return document_pages(files.where(~F.lower(F.regexp_extract("doc", r"\.([^./]+)$", 1)).isin(*PICTURES)), "doc").where("error is not null").select("doc", "page", "error")
