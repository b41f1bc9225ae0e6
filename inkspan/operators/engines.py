"""Recognition engines: a registry of functions from a picture to words, run in Arrow batches.

No recogniser comes with this package. ``tesseract`` needs its program on the
workers; others are registered by the user. An engine never guesses: where it
can't run it raises.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Word = tuple[str, int, int, int, int, float]  # text, x, y, width, height, confidence
ENGINES: dict[str, Callable[[bytes, dict], list[Word]]] = {}
WORDS = "word string, x long, y long, width long, height long, confidence double"


def engine(name: str):
    def add(f):
        ENGINES[name] = f
        return f

    return add


def run_program(command: list[str], *, timeout: float | None = None, env: dict | None = None) -> tuple[int, str, str]:
    """Exit code, standard output and standard error, drained side by side."""
    done = subprocess.run(command, capture_output=True, timeout=timeout, env=(os.environ | env) if env else None)
    return done.returncode, done.stdout.decode(errors="replace"), done.stderr.decode(errors="replace")


def words_of_tsv(text: str) -> list[Word]:
    out = []
    for line in text.split("\n")[1:]:
        f = line.rstrip("\r").split("\t")
        if len(f) >= 12 and f[0] == "5" and f[11].strip():
            try:
                out.append((f[11], *(int(v) for v in f[6:10]), float(f[10])))
            except ValueError:
                continue
    return out


@engine("tesseract")
def tesseract(content: bytes, settings: dict) -> list[Word]:
    program = settings.get("tesseract_path") or shutil.which("tesseract")
    if not program:
        raise RuntimeError("no tesseract program on this worker; set tesseract_path")
    with tempfile.TemporaryDirectory() as d:  # of this task alone, gone when it ends
        with open(f"{d}/page", "wb") as f:
            f.write(content)
        code, out, said = run_program([program, f"{d}/page", "stdout", "-l", settings.get("language", "eng"), "--psm", str(settings.get("page_mode", 1)), "tsv"], timeout=settings.get("timeout_s", 300), env={"OMP_THREAD_LIMIT": "1"})
    if code:
        raise RuntimeError(f"tesseract ended with {code}: {said[-300:]}")
    return words_of_tsv(out)


def recognise(pages: DataFrame, name: str, settings: dict | None = None, *, content: str = "content") -> DataFrame:
    """All columns of ``pages`` but ``content``, and a row a word."""
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; there are {sorted(ENGINES)}")
    read, given = ENGINES[name], settings or {}
    others = [c for c in pages.columns if c != content]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(c, given) for c in b[content].to_pylist()]
            take = pa.array([i for i, ws in enumerate(found) for _ in ws], pa.int64())
            flat = [w for ws in found for w in ws]
            names = ("word", "x", "y", "width", "height", "confidence")
            types = (pa.string(), *[pa.int64()] * 4, pa.float64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in others), *(pa.array([w[i] for w in flat], k) for i, k in enumerate(types))], names=[*others, *names])

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), WORDS]))
