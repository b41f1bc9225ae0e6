"""Mixing sources to target weights by the cube method.

Each source's target is a number of words. Every document of a source is taken
target / size times on average: the whole part for certain, the fraction with
that inclusion probability. The probabilities are moved through the null-space
of the balancing constraints - the source's words and its documents - until all
but two are 0 or 1 (the flight). A flight over any group of documents keeps the
group's totals exactly, so it runs on blocks of ``block`` documents in parallel;
the two left over by each block meet in blocks again, and so on, until one block
a source is left. Its last two documents are landed on the side that misses the
targets least. Long documents move first, so that short ones are left to land.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import fresh, quoted, save, with_row_id

WEIGHTS, SHARE, MOST, BLOCK, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 2048, 42
WORDS = r"[^\x20\x09-\x0D]+"


def flight(p: list[float], sizes: list[float], rand: random.Random) -> list[int]:
    """Move ``p`` in place, keeping sum(p) and sum(p * sizes), until at most two are left between 0 and 1; those are returned.

    Three documents have one direction that leaves both totals as they are; a
    step goes along it to the nearer wall on a side drawn so that each
    probability keeps its expectation, and settles at least one of the three.
    """
    eps = 1e-9
    open_: list[int] = []
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            open_.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(open_) == 3:
            a, b, c = open_
            v = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(v):
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(open_, v) if x)
            down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(open_, v) if x)
            step = up if rand.random() * (up + down) < down else -down
            for k, x in zip(open_, v):
                p[k] += step * x
                if p[k] < eps or p[k] > 1 - eps:
                    p[k] = float(p[k] > 0.5)
            open_ = [k for k in open_ if 0 < p[k] < 1]
    return open_


def land(p: list[float], sizes: list[float], open_: list[int]) -> None:
    """Settle the last ones: of their few roundings the one nearest to the words wanted, then to the documents wanted."""
    def miss(bits: int) -> tuple[float, float]:
        d = [(bits >> n & 1) - p[k] for n, k in enumerate(open_)]
        return abs(sum(x * sizes[k] for x, k in zip(d, open_))), abs(sum(d))

    best = min(range(1 << len(open_)), key=miss)
    for n, k in enumerate(open_):
        p[k] = float(best >> n & 1)


def _cube(seed: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["rid"].to_numpy(), t["spread"].to_numpy(), -t["size"].to_numpy()))
        t = t.take(pa.array(order))
        p, sizes = t["p"].to_pylist(), t["size"].to_pylist()
        mark = f"{seed}:{t['rank'][0].as_py()}:{t['block'][0].as_py()}:{t['level'][0].as_py()}"
        open_ = flight(p, sizes, random.Random(hashlib.sha256(mark.encode()).digest()))
        if t["last"][0].as_py():
            land(p, sizes, open_)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).drop_columns(["level", "last", "block"])

    return run


def ranked_sources(stats: DataFrame) -> DataFrame:
    """``stats`` (a row a source) with ``rank``, the source's place by code point, null last; sources are sorted in ranges, never in one task."""
    place = F.asc_nulls_last("source")
    dealt = save(stats.repartitionByRange(place).withColumn("pid", F.spark_partition_id()), "sources")
    before = dealt.groupBy("pid").agg(F.count("*").alias("many")).select("pid", (F.sum("many").over(Window.orderBy("pid")) - F.col("many")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(place)) - 1
    return dealt.withColumn("nth", nth).join(before, "pid").withColumn("rank", (F.col("before") + F.col("nth")).cast("long")).drop("pid", "nth", "before")


def source_targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``stats`` (source, words, n) with rank and target: ``share`` of all words by weight, at most ``most`` times a source's own, the excess reshared.

    Sources by code point, null last, take ``weights`` in turn, repeating. What
    a weight of 1 gets grows with each round of resharing; a round is one
    aggregation over the sources and the rounds end when no further source is
    above its bound, so sources may be many.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = save(ranked_sources(stats).withColumn("weight", weight), "weights")
    bound, each, above = most * F.col("words"), 0.0, -1
    while True:
        over = F.col("weight") * each > bound
        r = rows.agg(F.sum("words").alias("all"), F.count_if(over).alias("over"), F.sum(F.when(over, bound)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r["over"] == above or not r["open"]:
            break
        above, each = r["over"], (share * r["all"] - (r["given"] or 0.0)) / r["open"]
    return rows.withColumn("target", F.least(F.col("weight") * each, bound) if r["open"] else bound.cast("double"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block: int = BLOCK,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the text's number of words (null: 0), ``target`` the source's
    words wanted, ``copies`` how often the mix takes the row (0 to ``most``
    rounded up), ``taken`` copies times size. A null source is a source of its
    own, the last. Documents without words are taken like others of their
    source and add nothing. Draws depend on ids, places in the table's files and
    ``seed`` alone, so reruns agree however the scan is split; rows that repeat
    an id are told apart by their place. An empty table gives an empty one.
    ``rid`` is the row's number: that of ``row_col``, else its place in the
    table's files. Other columns, whatever their names, play no part.
    """
    if row_col is None:
        row_col = fresh(docs, "__rid")
        docs = with_row_id(docs, row_col)
    of = lambda c, name: F.col(quoted(c)).alias(name)
    words = F.coalesce(F.regexp_count(F.col(quoted(text_col)), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = save(docs.select(of(row_col, "rid"), of(id_col, "doc_id"), of(source_col, "source"), words.alias("size")).withColumn("spread", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), weights, share, most)
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    sources = save(sources.select(F.col("source").alias("of"), "rank", F.col("words").alias("source_size"), "target", ratio.alias("ratio"), F.ceil(F.col("n") / block).alias("blocks")), "targets")
    whole = F.floor(F.col("ratio") + 1e-12)
    rows = (
        rows.join(sources, F.col("source").eqNullSafe(F.col("of")))
        .withColumns({"whole": whole.cast("int"), "p": F.greatest(F.lit(0.0), F.col("ratio") - whole)})
        .select("rid", "doc_id", "source", "size", "spread", "rank", "source_size", "target", "whole", "p", "blocks")
    )
    parts = []
    level, now, most_blocks = 0, rows, sources.agg(F.max("blocks")).first()[0] or 1
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns)
    fewer = lambda n: -(-2 * n // block)
    while True:
        dealt = now.withColumns({"block": F.pmod(F.xxhash64(F.lit(level), "spread", "rid"), "blocks"), "level": F.lit(level), "last": F.col("blocks") == 1})
        done = save(dealt.groupBy("rank", "block").applyInArrow(_cube(seed), schema), f"cube-{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(done.where(~open_))
        if most_blocks == 1:
            break
        now = done.where(open_).withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        most_blocks = fewer(most_blocks)
        level += 1
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("int")
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
