"""Text expressions: words, tokens, names and sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s+"
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
INSIDE = r"[^\p{L}\p{N}]+"
#: What a page's text begins with, and how words are parted.
PAGE_HEAD, RULE = "page ", "\n======\n"


def words(text: Column) -> Column:
    """Non-empty runs between blanks."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised_words(text: Column) -> Column:
    """Words in lower case without leading and trailing characters that are neither letter nor digit."""
    return F.filter(F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, EDGES, ""))), lambda w: w != "")


def normalised_text(text: Column) -> Column:
    """Lower case, runs of control and separator characters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{Cc}\p{Z}]+", " "))


def tokens(text: Column) -> Column:
    """Words with every character inside them that is neither letter nor digit deleted."""
    return F.filter(F.transform(words(text), lambda w: F.regexp_replace(w, INSIDE, "")), lambda w: w != "")


def output_name(path: Column, extension: str) -> Column:
    """The path without a final .pdf, and the extension."""
    return F.concat(F.regexp_replace(path, r"(?i)\.pdf$", ""), F.lit(extension))


def extension(path: Column) -> Column:
    """Lower-cased file extension; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def human_size(n: Column) -> Column:
    """B below 1024, KB without decimals below 1024 of these, then MB with one."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.0f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def producer_chain(old: Column, new: Column) -> Column:
    """``old -> new``; ``new`` alone where there is no old one."""
    return F.when(F.trim(F.coalesce(old, F.lit(""))) != "", F.concat_ws(" -> ", old, new)).otherwise(new)


def suppress_short(text: Column, longest: int = 2) -> Column:
    """Empty where there are ``longest`` characters or fewer; the row stays."""
    return F.when(F.length(text) <= longest, F.lit("")).otherwise(text)


def between_markers(text: Column, head: str, tail: str) -> Column:
    """What stands after the match of ``head`` and before that of ``tail``, stripped; a missing marker cuts nothing."""
    body = F.when(text.rlike(head), F.regexp_replace(text, f"(?s)^.*?(?:{head})", "")).otherwise(text)
    return F.btrim(F.regexp_replace(body, f"(?s)(?:{tail}).*$", ""), F.lit(" \t\n\r"))


def ratio(distance: Column, length: Column, other: Column) -> Column:
    """Error rate: distance by reference length; of an empty reference 0 if the other is empty too, else 1."""
    return F.when(length > 0, distance / length).otherwise(F.when(other == 0, 0.0).otherwise(1.0))


def is_cjk(text: Column) -> Column:
    """Whether any character is of one of the CJK ranges."""
    # fixed values: unified ideographs, hiragana, katakana, Hangul, extension A
    return text.rlike(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]")


def is_cjk_language(language: Column) -> Column:
    """Whether a language's name calls for a CJK font."""
    low = F.lower(language)
    # fixed values: how names of such languages begin
    return low.startswith("chi") | low.startswith("jpn") | low.startswith("kor") | low.contains("cjk")


def sampled_words(some: Column, pages: Column, most: int = 10) -> Column:
    """Words of a document from those of its first ``most`` pages: as they are if that is all, else by pages, cut to a whole number."""
    return F.when(pages <= most, some).otherwise(F.floor(some / most * pages))


def guard(words: Column, pages: Column, compress_only: Column) -> Column:
    """What keeps a document from being worked on; null if nothing does."""
    return F.when(pages == 0, "no pages").when(compress_only & (words == 0), "no text to keep; recognise it first")


def program_flags(flags: Column) -> Column:
    """Flags of an outside program without empty ones and without -b and what follows it."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        drop = s["skip"] | (x == "-b")
        return F.struct((~s["skip"] & (x == "-b")).alias("skip"), F.when(drop | (x == ""), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))

    return F.aggregate(F.split(flags, SPACE), start, step)["out"]


def first_description(xmp: Column) -> Column:
    """The first description element of metadata; null without one."""
    return F.try_element_at(F.regexp_extract_all(xmp, F.lit(r"(?s)<rdf:Description\b.*?(?:/>|</rdf:Description>)"), F.lit(0)), F.lit(1))


def conformance(xmp: Column, part: str = "2", level: str = "B") -> Column:
    """Metadata that names its archival conformance: what is absent is put at the end of the first description."""
    for tag, value in (("part", part), ("conformance", level)):
        element = f"<pdfaid:{tag}>{value}</pdfaid:{tag}>"
        xmp = F.when(xmp.contains(f"<pdfaid:{tag}>"), xmp).otherwise(F.regexp_replace(xmp, "(?s)^(.*?)(</rdf:Description>)", f"$1{element}$2"))
    return xmp
