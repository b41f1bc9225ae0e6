"""``python -m inkspan INPUT -o FOLDER``: searchable documents of a file's or folder's pages."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkspan", description="Pictures and documents to searchable documents, with text and word boxes.")
    p.add_argument("input", help="file or folder (any address that Spark reads)")
    p.add_argument("-o", "--output", required=True, help="folder that all machines reach")
    p.add_argument("--settings", help="file of settings, JSON with comments")
    p.add_argument("--dpi", type=int)
    p.add_argument("--language", "--lang")
    p.add_argument("--psm", dest="page_mode", help="page mode of the engine")
    p.add_argument("--tesseract-path")
    p.add_argument("--ocr-engine", dest="engine", help="a registered engine, or none")
    p.add_argument("--no-mrc", action="store_true", help="keep pictures whole instead of mask and background")
    p.add_argument("--mrc-only", action="store_true", help="take the words of documents that have them")
    p.add_argument("--pdfa", action="store_true", help="carry elements over and name the archival conformance")
    p.add_argument("--threads", type=int, help="tasks at once, where this machine does the work")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if every file was read; 1 if not, with what wasn't on standard error. What was read is written either way."""
    from pyspark.sql import SparkSession

    from inkspan.plans.convert import convert, unread
    from inkspan.plans.settings import load

    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("inkspan").config("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    spark = SparkSession.getActiveSession() or (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    given = {k: getattr(a, k) for k in ("dpi", "language", "page_mode", "tesseract_path", "engine")}
    settings = load(Path(a.settings).read_text() if a.settings else None, given)
    engine = None if settings["engine"] in (None, "none") else settings["engine"]
    try:
        rows = convert(spark, a.input, a.output, engine=engine, settings=settings, mrc=not a.no_mrc, mrc_only=a.mrc_only, archival=a.pdfa)
        for r in rows.select("name", "length").toLocalIterator():
            print(f"{r['name']}\t{r['length']}")
        faults = 0
        for r in unread(spark, a.input).toLocalIterator():
            print(f"{r['doc']}, page {r['page']}: {r['error']}", file=sys.stderr)
            faults += 1
    except Exception as e:  # the command ends with its message
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    return 1 if faults else 0


if __name__ == "__main__":
    sys.exit(main())
