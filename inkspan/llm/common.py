"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

#: Tables of more files than this are numbered in a copy, as the list of files is broadcast (about 150 bytes each).
MOST_FILES = 1 << 16
#: Rows of a file, as a power of two, and so the place of the file's number in a row's number.
_FILE_BITS = 40


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on one machine (a local master, as in tests), where the session names
    none, a folder is made and set for the session; elsewhere that is an error,
    since each executor would write to a disk of its own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Rows of an Arrow batch, at most, while a table is saved.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Lists that ``scratch`` blocks keep of the tables saved within them, innermost last.
_OPEN: list[list[DataFrame]] = []


def save(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back.

    A lost executor then costs a re-read and never a recomputation, and values
    that were made while writing stay as they are. Rows cross to Python in
    batches of ``BATCH_ROWS`` meanwhile, as texts may be long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._inkspan_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``save`` wrote; only for tables that nothing reads any more."""
    spark, place = df.sparkSession, df._inkspan_path
    if place is None:
        return
    df._inkspan_path = None
    if is_remote():  # no file system there: the data goes, an empty table stays
        df.limit(0).write.mode("overwrite").parquet(place)
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables saved within the block, each deleted at its end but those taken out of the list."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for table in made:
            forget(table)


def quoted(name: str) -> str:
    """A column's name for ``F.col``: dots and quotes in it are its own."""
    return "`" + name.replace("`", "``") + "`"


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_row_id(docs: DataFrame, name: str, *, most_files: int = MOST_FILES) -> DataFrame:
    """``docs`` with a number for each row, put last: the place of its file among the table's files, and its place in the file.

    ``docs`` must be a table read from files, or a selection of its columns and
    rows. The number is the row's own however the scan is split, so decisions
    can be joined back by it; doc_id can't serve, as it may be null or repeated.
    What isn't read from files, or from more than ``most_files``, is copied with
    its numbers; there the copy's columns must serve both sides of such a join.
    """
    spark = docs.sparkSession
    own = [F.col(quoted(c)) for c in docs.columns]
    of, index, begin = (fresh(docs, f"__row_{x}") for x in ("file", "index", "first"))
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select(*own, meta["file_path"].alias(of), meta["row_index"].alias(index))
        files = [r[0] for r in placed.select(of).distinct().limit(most_files + 1).collect()]
    except AnalysisException:
        files = None
    if files is None or len(files) > most_files:
        return save(docs.select(*own, F.monotonically_increasing_id().alias(name)), "numbered")
    numbers = spark.createDataFrame([(f, i << _FILE_BITS) for i, f in enumerate(sorted(files))], f"{of} string, {begin} long")
    return placed.join(F.broadcast(numbers), of).select(*own, (F.col(begin) + F.col(index)).alias(name))


def spread_join(rows: DataFrame, names: DataFrame, on: list[str], by: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` (about ``n``) joined to ``names``, one row a key of ``on``, where a key may hold a third of ``rows``.

    A key's rows are dealt into about the square root of ``n`` parts by ``by``.
    Only one row of each part meets its name, which it then brings to the rest:
    no task has more than some ``n ** 0.5`` rows of a key. Keys aren't null.
    """
    parts = max(64, math.isqrt(max(0, n)))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    brought = dealt.select(*on, "__part").distinct().join(names, on, how)
    return dealt.join(brought, [*on, "__part"]).drop("__part")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def unit_hash(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) that depends on ``of`` and the seed alone."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
