"""Links between texts whose sets of word shingles are similar, by deletion-variant signatures of min-hashes.

A SimHash of 64 bits differs in about ten bits at a similarity of 0.8, too many
for one-wildcard segments that are wide enough to tell documents apart. The
same scheme holds for a signature of min-hashes, of which a fifth differ: it is
cut into ``bands`` segments of ``places`` values, each segment is indexed with
each of its values in turn made a wildcard, and rows that share a key meet by
an equality join and are verified on their shingles. A pair of similarity s
meets with a probability of 1 - (1 - s**4 - 4 (1 - s) s**3) ** 4 by default:
0.999 at 0.8.

Rows of equal shingle sets are searched once, keys of equal rows too. A group's
verified links are given as a spanning forest, never as pairs. A group of over
``block`` rows or ``WEIGHT`` hashes is dealt into blocks that are searched one by
one, each with the group's first row. What is tied to that row in its own block
is tied to all others that are, so only rows that aren't are then compared with
the other blocks, again block by block: a group of near copies costs a pass over
it, and a group of unlike rows all pairs of its blocks. Texts of any length are
compared on all their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import forget, save

BANDS, PLACES, BLOCK, KEEP = 4, 4, 384, None
#: Hashes that a block of a group holds, about; longer texts make blocks of fewer rows.
WEIGHT = 1 << 20


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of a family of hashes of hashes: a multiplication by an odd number between two folds."""
    odd = np.uint64(xxhash.xxh64_intdigest(str(k)) | 1)
    x = (h ^ (h >> np.uint64(32))) * odd
    return x ^ (x >> np.uint64(29))


def signature_keys(shingles: np.ndarray, bands: int = BANDS, places: int = PLACES) -> list[int]:
    """One key for each place of each band, of the band's other min-hashes; none of an empty set."""
    if not len(shingles):
        return []
    least = [int(_mixed(shingles, k).min()) for k in range(bands * places)]
    out = []
    for at in range(0, len(least), places):
        for wild in range(at, at + places):
            rest = (least[k] for k in range(at, at + places) if k != wild)
            out.append(xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in rest), wild))
    return out


def thinned(shingles: np.ndarray, keep: int | None = KEEP) -> tuple[int, np.ndarray]:
    """(level, values): all of a set up to ``keep`` (None: of any set), else those of a share of 2 ** -level of the hash space.

    Two sets are compared at the higher of their levels, so sets up to ``keep``
    exactly, longer ones by ``keep`` / 2 common places at least (a standard
    error of 0.0125 at 0.8).
    """
    if keep is None:
        return 0, np.unique(shingles)
    level = max(0, math.ceil(math.log2(len(shingles) / keep))) if len(shingles) else 0
    x = (_mixed(shingles, -1) >> np.uint64(32)).astype(np.uint32)
    return level, np.unique(x[x < (1 << (32 - level))] if level else x)


def set_forest(sets: list[np.ndarray], levels: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest (as index pairs) of the links among ``sets``; with ``side``, of those between its two sides."""
    n = len(sets)
    own = np.array([len(s) for s in sets])
    above = np.array([int(np.searchsorted(s, 1 << (31 - int(l)))) for s, l in zip(sets, levels)])  # size one level up
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.r_[0, np.cumsum(own)]
    of, size = np.repeat(np.arange(n), own), int(value.max(initial=-1)) + 1
    rest, links = np.ones(n, bool), []
    posting, first, built = of, of, 2 * n + 1
    for start in range(n):
        if not rest[start]:
            continue
        rest[start] = False
        front = [start]
        while front and (left := int(rest.sum())):
            if 2 * left < built:  # the index holds those that are left, and is made anew whenever they halve
                among = rest[of]
                posting = of[among][np.argsort(value[among], kind="stable")]
                first, built = np.r_[0, np.cumsum(np.bincount(value[among], minlength=size))], left
            f = front.pop()
            mine = value[ends[f] : ends[f + 1]]
            many = first[mine + 1] - first[mine]
            at = np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(posting[at], minlength=n)
            gap = levels - levels[f]
            sizes = np.where(gap < 0, above, own) + np.where(gap > 0, above[f], own[f])
            near = rest & (np.abs(gap) <= 1) & (both > 0) & (both * (1 + similarity) >= similarity * sizes - 1e-9)
            if side is not None:
                near &= side != side[f]
            found = np.flatnonzero(near).tolist()
            links += [(f, g) for g in found]
            rest[found] = False
            front += found
    return links


def _search(similarity: float, kind: type):
    """Units of rows (key, i, j, rid, side, rep, level, hashes), sorted, to links (a, b), and loose rows (a, key).

    ``rep`` is null in units of a kind that has no loose rows; else it is the
    row that stands in each block of its group, and what its unit's links don't
    tie to it is loose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            rid, side, rep, level, raw = zip(*held)
            found = set_forest([np.frombuffer(x, kind) for x in raw], np.array(level), np.array(side) if rep[0] is None else None, similarity)
            loose: list[int] = []
            if rep[0] is not None and rep[0] >= 0:
                up = list(range(len(rid)))
                for x, y in found:  # a forest: its links come in the order in which rows are reached
                    up[y] = up[x]
                root = up[rid.index(rep[0])]
                loose = [r for r, u in zip(rid, up) if u != root]
            if found or loose:
                yield _rows([rid[x] for x, _ in found] + loose, [rid[y] for _, y in found] + [None] * len(loose), [None] * len(found) + [group[0]] * len(loose))

        for b in batches:
            for key, i, j, *row in zip(*(b[c].to_pylist() for c in ("key", "i", "j", "rid", "side", "rep", "level", "hashes"))):
                if (key, i, j) != group:
                    yield from links()
                    held, group = [], (key, i, j)
                held.append(row)
        yield from links()

    return run


def _rows(a: list, b: list, key: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "key": pa.array(key, pa.int64())})


def shingle_links(texts: DataFrame, shingle_hashes, *, words: int = 5, seed: int = 42, similarity: float = 0.8, bands: int = BANDS, places: int = PLACES, block: int = BLOCK, keep: int | None = KEEP, weight: int = WEIGHT, groups: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of row numbers over ``texts`` (rid, text): their components are those of the pairs that met and are similar.

    ``shingle_hashes(text, words, seed)`` gives the hashes of a text's
    shingles. Texts without words, null ones too, link to nothing here. With a
    ``keep``, sets of more hashes than that are compared on a sample. ``groups``
    (rid, key) names further groups whose rows are compared with each other.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words, seed)) for t in b["text"]]
            keys = pa.array([np.array(signature_keys(s, bands, places), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
            whole = pa.array([np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b["rid"], whole, pa.array([len(s) for s in sets], pa.int64()), keys], names=["rid", "whole", "size", "keys"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [thinned(np.unique(shingle_hashes(t.as_py(), words, seed)), keep) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["rid"], pa.array([l for l, _ in found], pa.int32()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["rid", "level", "hashes"])

    made = save(texts.select("rid", "text").mapInArrow(sketch, "rid long, whole long, size long, keys array<long>").where(F.col("whole").isNotNull()), "signatures")
    first, sketched = made.groupBy("whole").agg(F.min("rid").alias("rep")), made
    made = save(made.join(first, "whole").select("rid", "rep", "size", F.when(F.col("rid") == F.col("rep"), F.col("keys")).alias("keys")), "represented")
    forget(sketched)
    same = made.where("rid <> rep").select(F.col("rep").alias("a"), F.col("rid").alias("b"))
    keyed = made.where("rid = rep").select("rid", "size", F.explode("keys").alias("key"))
    if groups is not None:
        ends = made.select("rid", "rep").join(groups, "rid").select(F.col("rep").alias("rid"), "key").distinct()
        keyed = keyed.unionByName(ends.join(made.select("rid", "size"), "rid"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("rid").alias("low"), F.bit_xor(F.xxhash64("rid")).alias("mark")).where("n > 1")
    shared = save(shared.groupBy("n", "held", "low", "mark").agg(F.min("key").alias("key")).select("key", "n", "held", "low"), "shared")
    members = save(keyed.join(shared, "key").select("key", "n", "held", "low", "rid"), "members")
    asked = save(members.select("rid").distinct(), "asked")
    sets = save(texts.join(asked, "rid", "left_semi").select("rid", "text").mapInArrow(thin, "rid long, level int, hashes binary"), "sets")
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") / weight))).cast("int")
    dealt = members.select("key", "rid", "low", blocks.alias("blocks"), F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("at"))

    def searched(units: DataFrame, what: str) -> DataFrame:
        ready = units.join(sets, "rid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        run = _search(similarity, np.uint64 if keep is None else np.uint32)
        return save(ready.select("key", "i", "j", "rid", "side", "rep", "level", "hashes").mapInArrow(run, "a long, b long, key long"), what)

    everywhere = F.when(F.col("rid") == F.col("low"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at"))
    rep = F.when(F.col("blocks") > 1, F.col("low")).otherwise(-1)
    near = searched(dealt.select("key", "rid", F.explode(everywhere).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), rep.alias("rep")), "similar")
    edges = near.where("b is not null").select("a", "b").unionByName(same)
    loose = near.where("b is null").select("key", F.col("a").alias("rid")).distinct()
    if loose.isEmpty():
        return edges
    counts = loose.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    left = loose.join(counts, "key").join(dealt.select("key", "blocks").distinct(), "key")
    left = left.select("key", "rid", F.pmod(F.xxhash64("rid"), "parts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    right = dealt.join(counts, "key").select("key", "rid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"))
    more = searched(left.unionByName(right).withColumn("rep", F.lit(None).cast("long")), "similar-loose")
    return edges.unionByName(more.where("a <> b").select("a", "b"))
