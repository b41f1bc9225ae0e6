"""Sinks: page text, word boxes as JSON, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import PAGE_HEAD, RULE


def page_text(words: DataFrame, page: list[str], *, order: list[str], word: str = "word") -> DataFrame:
    """page, text: the heading, each word in order with one space behind it, an empty line. The last of ``page`` counts from 0."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, word))), lambda s: F.concat(s[word], F.lit(" "))), "")
    head = F.concat(F.lit(PAGE_HEAD), (F.col(page[-1]) + 1).cast("string"), F.lit(RULE))
    return words.groupBy(*page).agg(ordered.alias("_t")).select(*page, F.concat(head, "_t", F.lit("\n\n")).alias("text"))


def box_json(boxes: DataFrame, page: list[str], *, order: str) -> DataFrame:
    """page, json: its words with corners x1, y1, x2, y2 in order."""
    row = F.struct(F.col(order).alias("_o"), "word", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    out = F.transform(F.array_sort(F.collect_list(row)), lambda s: F.struct(*(s[c].alias(c) for c in ("word", "x1", "y1", "x2", "y2"))))
    return boxes.groupBy(*page).agg(F.to_json(out).alias("json"))


def truth_json(pages: DataFrame) -> DataFrame:
    """source, json: ground truth of each source from rows source, title, page, words (an array)."""
    of = pages.groupBy("source").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("page", "words"))).alias("pages"))
    return of.select("source", F.to_json(F.struct("source", "title", "pages")).alias("json"))


def line_text(lines: DataFrame, page: list[str], *, order: str = "line", words: str = "words") -> DataFrame:
    """As ``page_text``, from arrays of words by line: words are joined where the line is, so a page gathers its lines only."""
    line = F.when(F.size(words) > 0, F.concat(F.array_join(words, " "), F.lit(" "))).otherwise("")
    rows = lines.select(*page, F.col(order).alias("_o"), line.alias("_l"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda s: s["_l"]), "")
    head = F.concat(F.lit(PAGE_HEAD), (F.col(page[-1]) + 1).cast("string"), F.lit(RULE))
    return rows.groupBy(*page).agg(ordered.alias("_t")).select(*page, F.concat(head, "_t", F.lit("\n\n")).alias("text"))


def write_text(pages: DataFrame, path: str) -> None:
    """One text file a partition; the writer's own line feed is each page's last."""
    pages.select(F.regexp_replace("text", r"\n\z", "").alias("value")).write.text(path)


def write_json(pages: DataFrame, path: str) -> None:
    pages.select(F.col("json").alias("value")).write.text(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Tab-separated values with a heading."""
    rows.write.option("sep", "\t").option("header", True).csv(path)


def append_report(rows: DataFrame, path: str) -> None:
    """Rows as lines of a table in Markdown, added to what is there."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    rows.select(cells.alias("value")).write.mode("append").text(path)
