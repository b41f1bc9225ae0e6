"""Layout reconstruction: glyphs to lines, words, reading order, batches and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.geometry import pixel_box, upper_median

LINES_PER_PAGE, BATCH, NARROWEST, LONGEST_DOCUMENT = 43, 6, 0.6, 30


def _parts(pages: DataFrame, page: list[str], others: list[str], breaks: Column, name: str) -> DataFrame:
    """Rows of the array ``g`` of each page, in parts that begin at ``breaks`` (places from 1), numbered from 0 in ``name``."""
    with_breaks = pages.withColumn("_b", breaks)
    part = F.transform("_b", lambda at, i: F.struct(i.alias("n"), F.slice("g", at, F.coalesce(F.get("_b", i + 1), F.size("g") + 1) - at).alias("p")))
    return with_breaks.select(*page, F.explode(part).alias("z")).select(*page, F.col("z.n").alias("n"), F.explode("z.p").alias("r")).select(*page, *(F.col(f"r.{c}").alias(c) for c in others), F.col("n").alias(name))


def anchored_lines(glyphs: DataFrame, page: list[str], *, y: str = "y", height: str = "height", order: str = "glyph") -> DataFrame:
    """``glyphs`` with the column ``line`` (from 0).

    In order of y a glyph starts a line when it is farther than half the page's
    upper median height from the first glyph of the line. The anchor is not the
    previous row, so it is a fold over the page's glyphs, which meet in one row
    and give the places where lines begin; pages are bounded by what fits on
    paper.
    """
    others = [c for c in glyphs.columns if c not in page]
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(y).alias("_y"), F.col(order).alias("_o"), *others)))
    pages = glyphs.groupBy(*page).agg(sorted_.alias("g"), upper_median(F.collect_list(height)).alias("mid"))
    return _parts(pages, page, others, _anchored(lambda g, at: F.abs(g["_y"] - at["_y"]) > 0.5 * F.col("mid")), "line")


def _anchored(far: Callable[[Column, Column], Column]) -> Column:
    """Places (from 1) in ``g`` at which a line begins: where an element is ``far`` from the one that its line began with."""
    start = F.struct(F.lit(1).alias("n"), F.array(F.lit(1)).alias("b"))

    def step(s: Column, g: Column) -> Column:
        new = far(g, F.element_at("g", F.element_at(s["b"], -1)))
        return F.struct((s["n"] + 1).alias("n"), F.when(new, F.concat(s["b"], F.array(s["n"] + 1))).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.slice("g", F.lit(2), F.size("g")), start, step)["b"]


def gap_words(glyphs: DataFrame, line: list[str], *, x: str = "x", width: str = "width", height: str = "height", order: str = "glyph") -> DataFrame:
    """``glyphs`` with ``word`` (from 0 in each line): a gap over max(0.3 of the previous height, 2) starts one."""
    w = Window.partitionBy(*line).orderBy(x, order)
    gap = F.col(x) - (F.lag(x).over(w) + F.lag(width).over(w))
    new = (gap > F.greatest(0.3 * F.lag(height).over(w), F.lit(2.0))).cast("int")
    return glyphs.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("word", F.sum("_new").over(w)).drop("_new")


def reading_order(boxes: DataFrame, page: list[str], *, x: str = "x", y: str = "y", width: str = "width", height: str = "height", order: str = "box") -> DataFrame:
    """``boxes`` with ``place`` (from 1): lines of boxes whose centres are near their line's first one, then from left to right by centre.

    Near is half the mean of both heights at most. Comparing boxes two by two by
    that rule isn't transitive; held against the line's first box in order of
    centres it gives a total order, and a slanted page doesn't run into one line.
    """
    others = [c for c in boxes.columns if c not in page]
    centre = lambda a, side: F.col(a) + F.col(side) / 2
    row = F.struct(centre(y, height).alias("_y"), F.col(order).alias("_o"), centre(x, width).alias("_x"), F.col(height).alias("_h"), *others)
    pages = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("g"))
    rows = _parts(pages, page, [*others, "_x"], _anchored(lambda g, at: F.abs(g["_y"] - at["_y"]) > (g["_h"] + at["_h"]) / 4), "_line")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("_line", "_x", order))).drop("_line", "_x")


def width_batches(crops: DataFrame, group: list[str], *, width: str = "width", order: str = "crop", most: int = BATCH, narrowest: float = NARROWEST) -> DataFrame:
    """``crops`` with ``batch`` (from 0): by width, missing ones last; ``most`` a batch; none narrower than ``narrowest`` of its widest.

    Missing crops count for the batch's number but not for its widths.
    """
    others = [c for c in crops.columns if c not in group]
    rows = F.array_sort(F.collect_list(F.struct(F.col(width).isNull().alias("_gone"), F.col(width).alias("_w"), F.col(order).alias("_o"), *others)))
    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0).alias("n"), F.lit(0).alias("in"), F.array().cast("array<int>").alias("b"))

    def step(s: Column, c: Column) -> Column:
        w = c["_w"].cast("double")
        new = F.coalesce((s["in"] == most) | (s["low"] < narrowest * w), F.lit(False)) | (s["n"] == 0)
        return F.struct(F.when(new, w).otherwise(F.coalesce(s["low"], w)).alias("low"), (s["n"] + 1).alias("n"), F.when(new, 1).otherwise(s["in"] + 1).alias("in"), F.when(new, F.concat(s["b"], F.array(s["n"] + 1))).otherwise(s["b"]).alias("b"))

    of = crops.groupBy(*group).agg(rows.alias("g"))
    return _parts(of, group, others, F.aggregate("g", start, step)["b"], "batch")


def visible_glyphs(glyphs: DataFrame, *, text: str = "text") -> DataFrame:
    """Without glyphs whose text is null, empty or blank."""
    return glyphs.where(F.coalesce(~F.col(text).rlike(r"^\s*$"), F.lit(False)))


def of_pages(rows: DataFrame, first: int, last: int, *, page: str = "page") -> DataFrame:
    """Rows of the pages from ``first`` to ``last``; files written by page are pruned by it."""
    return rows.where(F.col(page).between(first, last))


def short_documents(rows: DataFrame, doc: list[str], *, pages: str = "pages", most: int = LONGEST_DOCUMENT) -> DataFrame:
    """Without documents of over ``most`` pages."""
    return rows.where(F.col(pages) <= most)


def page_order(rows: DataFrame, doc: list[str], *, page: str = "page", took: str = "took") -> DataFrame:
    """``rows`` (a row a page, in any order) with ``place`` (from 1) in their document and ``so_far``, the time up to each page."""
    w = Window.partitionBy(*doc).orderBy(page)
    return rows.withColumns({"place": F.row_number().over(w), "so_far": F.sum(took).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def shown_and_skipped(words: DataFrame, page: list[str], *, word: str = "word", font: str = r"^[\x{20}-\x{7E}\x{A0}-\x{FF}]*$") -> DataFrame:
    """page, shown, skipped: words that a font can show (all their characters match ``font``) and words that it can't."""
    ok = F.col(word).rlike(font)
    return words.groupBy(*page).agg(F.count_if(ok).alias("shown"), F.count_if(~ok).alias("skipped"))


def page_lines(docs: DataFrame, *, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, line (from 0), page (from 0), text of the lines that are kept: not blank, no rule of signs, no picture note."""
    kept = lambda t: ~t.rlike(r"^\s*$") & ~t.rlike(r"[_=]{4,}") & ~t.rlike(r"^\[Illustration")
    lines = F.filter(F.split("text", "\n"), kept)
    rows = docs.select("doc_id", F.posexplode(lines).alias("line", "text"))
    return rows.select("doc_id", "line", F.floor(F.col("line") / per_page).cast("int").alias("page"), "text")


def char_blocks(glyphs: DataFrame, word: list[str], *, dpi: float = 300.0, text: str = "text", x: str = "x", order: str = "glyph") -> DataFrame:
    """One block a word: its glyphs' texts in order and the union of their boxes (points) as a box of pixels; confidence 100."""
    edges = glyphs.groupBy(*word).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x, order, text))), lambda s: s[text]), "").alias("text"),
        *(f(F.col(a) + F.col(b) if b else F.col(a)).alias(n) for n, f, a, b in (("x0", F.min, x, ""), ("y0", F.min, "y", ""), ("x1", F.max, x, "width"), ("y1", F.max, "y", "height"))),
    )
    box = pixel_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), dpi)
    return edges.select(*word, "text", *(v.alias(k) for k, v in box.items()), F.lit(100.0).alias("confidence"))
