"""Sources: recogniser output, ground truth, pictures, dictionaries and texts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a picture by its extension.
PICTURES = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff")
TRUTH = "source string, title string, pages array<struct<page:int,words:array<string>>>"


def parse_tsv(lines: DataFrame, *, keep: list[str] = ()) -> DataFrame:
    """Words of level 5 from 12-column recogniser output in ``value``; short rows and bad numbers are dropped."""
    f = F.split("value", "\t")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    rows = lines.select(
        *keep, at(0).alias("level"), at(11).alias("word"), *(at(i).try_cast("long").alias(n) for i, n in ((6, "x"), (7, "y"), (8, "width"), (9, "height"))), at(10).try_cast("double").alias("confidence")
    )
    good = (F.col("level") == "5") & (F.btrim("word", F.lit(" \t\r\n")) != "")
    for c in ("x", "y", "width", "height", "confidence"):
        good &= F.col(c).isNotNull()
    return rows.where(good).drop("level")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")), keep=["path"])


def read_truth(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """source, title, page, words: a row a page; a file holds one source's truth, or with ``lines`` one's on each line."""
    rows = spark.read.schema(TRUTH).option("multiLine", not lines).json(path)
    return rows.select("source", "title", F.explode("pages").alias("p")).select("source", "title", "p.page", "p.words")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_dictionary(spark: SparkSession, paths: list[str]) -> list[str]:
    """Characters of the first dictionary that exists: blank first, space last. A few thousand lines at most."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p)):
            rows = spark.read.text(p).select("value", F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
            return ["", *(r["value"] for r in rows), " "]
    return ["", " "]


def read_pictures(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """path, content of files with a picture's extension whose name matches ``pattern``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PICTURES)).select("path", "content")


def read_rasters(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """path, width, height, channels, pixels (blue, green, red) of pictures that Spark's image source decodes; what it can't is left out."""
    files = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def resolution(content: bytes) -> float | None:
    """Dots an inch by a PNG's, JPEG's, BMP's or TIFF's own header; None if it tells none."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            at = content.find(b"pHYs", 0, 1 << 16)
            if at > 0:
                x, _, unit = struct.unpack(">IIB", content[at + 4 : at + 13])
                return x * 0.0254 if unit == 1 and x else None
        elif content[:2] == b"BM":
            x = struct.unpack("<i", content[38:42])[0]
            return x * 0.0254 if x > 0 else None
        elif content[:2] == b"\xff\xd8":
            at = content.find(b"JFIF\0", 0, 64)
            if at > 0:
                unit, x = content[at + 7], struct.unpack(">H", content[at + 8 : at + 10])[0]
                return {1: 1.0, 2: 2.54}.get(unit, 0) * x or None
        elif content[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if content[:2] == b"II" else ">"
            tags = dict(_tags(content, e, struct.unpack(e + "I", content[4:8])[0]))
            if 282 in tags:
                a, b = struct.unpack(e + "II", content[tags[282] : tags[282] + 8])
                return a / b * (2.54 if tags.get(296) == 3 else 1) if b and a else None
    except (struct.error, IndexError):
        pass
    return None


def _tags(content: bytes, e: str, at: int) -> Iterator[tuple[int, int]]:
    for i in range(struct.unpack(e + "H", content[at : at + 2])[0]):
        tag, kind, _, value = struct.unpack(e + "HHII", content[at + 2 + 12 * i : at + 14 + 12 * i])
        yield tag, value if kind != 3 else struct.unpack(e + "H", content[at + 10 + 12 * i : at + 12 + 12 * i])[0]


def tiff_frames(content: bytes) -> int:
    """Number of pictures in a TIFF; 1 of any other file."""
    if content[:4] not in (b"II*\0", b"MM\0*"):
        return 1
    e, n = "<" if content[:2] == b"II" else ">", 0
    at, seen = struct.unpack(e + "I", content[4:8])[0], set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        n += 1
        count = struct.unpack(e + "H", content[at : at + 2])[0]
        at = struct.unpack(e + "I", (content[at + 2 + 12 * count : at + 6 + 12 * count] + b"\0\0\0\0")[:4])[0]
    return n


def _values(content: bytes, e: str, at: int) -> dict[int, list[int]]:
    """All whole-number values of each tag of the directory at ``at``."""
    out = {}
    for i in range(struct.unpack(e + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", content[at + 2 + 12 * i : at + 10 + 12 * i])
        if sign := {1: "B", 3: "H", 4: "I"}.get(kind):
            size = struct.calcsize(sign) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", content[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            out[tag] = list(struct.unpack(e + sign * n, content[place : place + size]))
    return out


def _unpacked_runs(raw: bytes) -> bytes:
    """PackBits: a count of literal bytes, or of repeats of the next one."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


#: fixed values: compressions by the format's numbers
UNPACK = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_runs}


def tiff_rasters(content: bytes) -> Iterator[np.ndarray | None]:
    """Each frame's samples, (height, width, channels) of 8 bits; None for a frame whose coding isn't read here.

    Strips of one or eight bits a sample, plain, Deflate or PackBits; white-is-zero is turned round.
    """
    e = "<" if content[:2] == b"II" else ">"
    at, seen = struct.unpack(e + "I", content[4:8])[0], set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        count = struct.unpack(e + "H", content[at : at + 2])[0]
        try:
            yield _frame(content, _values(content, e, at))
        except (struct.error, zlib.error, KeyError, ValueError):
            yield None
        at = struct.unpack(e + "I", (content[at + 2 + 12 * count : at + 6 + 12 * count] + b"\0\0\0\0")[:4])[0]


def _frame(content: bytes, tags: dict[int, list[int]]) -> np.ndarray | None:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, channels, bits = tags[256][0], tags[257][0], one(277, 1), set(tags.get(258, [1]))
    if bits not in ({1}, {8}) or one(317, 1) != 1 or one(284, 1) != 1 or (bits == {1} and channels != 1):
        return None
    data = b"".join(UNPACK[one(259, 1)](content[a : a + n]) for a, n in zip(tags[273], tags[279]))
    row = -(-width * channels * next(iter(bits)) // 8)
    rows = np.frombuffer(data, np.uint8)[: row * height].reshape(height, row)
    if bits == {1}:
        rows = np.unpackbits(rows, axis=1)[:, :width] * np.uint8(255)
    return (255 - rows if one(262, 1) == 0 else rows).reshape(height, width, channels)


def tiff_pages(pictures: DataFrame) -> DataFrame:
    """path, page_idx, width, height, channels, pixels: the frames of each TIFF, one at a time; frames that can't be decoded are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                raw = content.as_py()
                for i, r in enumerate(tiff_rasters(raw) if raw[:4] in (b"II*\0", b"MM\0*") else ()):
                    if r is not None:
                        yield pa.RecordBatch.from_pydict({
                            "path": pa.array([path], pa.string()), "page_idx": pa.array([i], pa.int32()), "width": pa.array([r.shape[1]], pa.int32()),
                            "height": pa.array([r.shape[0]], pa.int32()), "channels": pa.array([r.shape[2]], pa.int32()), "pixels": pa.array([r.tobytes()], pa.binary()),
                        })

    return pictures.select("path", "content").mapInArrow(run, "path string, page_idx int, width int, height int, channels int, pixels binary")


def picture_pages(pictures: DataFrame, *, dpi: float = 300.0) -> DataFrame:
    """path, page_idx, dpi: a row a frame, with the file's own resolution or the default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, resolution(c) or dpi) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist()) for i in range(tiff_frames(c))]
            yield pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "page_idx": pa.array([r[1] for r in rows], pa.int32()), "dpi": pa.array([r[2] for r in rows], pa.float64())})

    return pictures.select("path", "content").mapInArrow(run, "path string, page_idx int, dpi double")
