"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into blocks of a fixed size. Sorting the blocks
gives each distinct block an integer name; then adjacent names are paired and
the pairs are sorted and named in turn, until one name is left of every
document. Names are given by comparing the blocks themselves, so two documents
have one identity exactly if their texts are equal: no hash can collide.

Naming is salted. Equal keys first meet in one of ``salts`` parts each, so a
key that holds a third of all rows is spread; one representative of each part
then meets the others of its key, at most ``salts`` of them. ``salts`` grows
with the square root of the table's rows, so neither a part nor the meeting of
a key's representatives holds more rows than that. Of the blocks only those
whose hash more than ``salts`` rows have are dealt so; the others meet at once.
Text moves in one shuffle, representatives of frequent blocks in a second, and
all else is integers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import forget, fresh, quoted, save, spread_join, with_row_id

BLOCK_BYTES = 4096
LEAST_SALTS = 256
#: Hashes (9 bytes each) of frequent blocks that are broadcast at most; more are joined by a shuffle.
MOST_OFTEN = 1 << 20


def name_keys(rows: DataFrame, key: str, salts: int, what: str, *, counted: bool = False) -> DataFrame:
    """``rows`` (with a column ``rid``) with ``key`` replaced by its integer ``name``.

    Equal keys get equal names and different keys different ones; names follow
    the sort order of the keys within each partition. Keys are dealt into
    ``salts`` parts, whose own names are then made one by a second sort. With
    ``counted`` that is only done for keys whose hash more than ``salts`` rows
    have, so wide keys cross the network once: equal keys have one hash and thus
    one way, and keys that merely share a hash are still told apart by sorting.
    """
    others = [c for c in rows.columns if c != key]
    mark, often = F.lit(True), None
    if counted:
        often = rows.groupBy(F.xxhash64(key).alias("__hash")).count().where(F.col("count") > salts).select("__hash", F.lit(True).alias("__often"))
        often = save(often, f"{what}-often")
        few = often.count() <= MOST_OFTEN
        rows = rows.withColumn("__hash", F.xxhash64(key)).join(F.broadcast(often) if few else often, "__hash", "left")
        mark = F.col("__often").isNotNull()
    salted = rows.withColumn("often", mark).withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("rid"), F.lit(salts))).otherwise(0)).select(*others, key, "often", "salt")
    met = (
        salted.repartition(key, "salt")
        .sortWithinPartitions(key, "salt")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("local", F.min("place").over(Window.partitionBy(key, "salt")))
        .select(*others, "often", "local", F.when(F.col("often") & (F.col("place") == F.col("local")), F.col(key)).alias("shown"))
    )
    met = save(met, f"{what}-met")
    names = (
        met.where(F.col("shown").isNotNull())
        .select("local", "shown")
        .withColumn("name", F.min("local").over(Window.partitionBy("shown")))
        .select("local", "name")
    )
    named = met.where("often").select(*others, "local").join(names, "local").select(*others, "name")
    if counted:
        named = named.unionByName(met.where("NOT often").select(*others, F.col("local").alias("name")))
    out = save(named, f"{what}-named")
    forget(met)
    if often is not None:
        forget(often)
    return out


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block_bytes: int = BLOCK_BYTES, salts: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays; a null text is
    empty; a null id is below all others; of rows with one id that with the
    lowest number stays, so each group keeps exactly one row. An empty table gives an
    empty one. Other columns of ``docs``, whatever their names, play no part.
    ``rid`` is the row's number: that of ``row_col``, else its place in the
    table's files (see ``with_row_id``). ``salts`` (None: by the number of rows)
    changes no result.
    """
    n = docs.count()
    salts = salts or max(LEAST_SALTS, math.isqrt(n))
    if row_col is None:
        row_col = fresh(docs, "__rid")
        docs = with_row_id(docs, row_col)
    raw = F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), raw.alias("raw"), F.col(quoted(row_col)).alias("rid"))
    last = F.greatest(F.lit(0), F.floor((F.length("raw") - 1) / block_bytes)).cast("int")
    blocks = rows.select(
        "rid",
        "doc_id",
        F.sha2("raw", 256).alias("sha"),
        last.alias("last"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
        ).alias("pos", "block"),
    ).withColumns({"doc_id": F.when(F.col("pos") == 0, F.col("doc_id")), "sha": F.when(F.col("pos") == 0, F.col("sha"))})
    level = name_keys(blocks, "block", salts, "blocks", counted=True)
    heads = level.where(F.col("pos") == 0).select("rid", "doc_id", "sha", "last", "name")

    single = heads.where(F.col("last") == 0).select("rid", "doc_id", "sha", F.lit(0).alias("kind"), "name")
    longest = level.agg(F.max("last")).first()[0] or 0
    joined = single
    if longest:
        level = level.where(F.col("last") > 0).select("rid", "pos", "name")
        for _ in range(math.ceil(math.log2(longest + 1))):
            half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
            pairs = level.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.struct(half(0).alias("a"), F.coalesce(half(1), F.lit(-1)).alias("b")).alias("pair")
            )
            level = name_keys(pairs, "pair", salts, "pairs")
        several = heads.where(F.col("last") > 0).drop("name", "last").join(level.select("rid", "name"), "rid")
        joined = single.unionByName(several.withColumn("kind", F.lit(1)))
    identity = save(joined, "identity")
    groups = identity.groupBy("kind", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", (-F.col("rid")).alias("minus"))).alias("best")
    )
    return spread_join(identity, groups, ["kind", "name"], "rid", n).select(
        "rid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.minus") == -F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
