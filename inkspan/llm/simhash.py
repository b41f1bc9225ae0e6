"""SimHash near-dedup by deletion-variant signatures.

Fingerprints that differ in at most d bits, cut into d // 2 + 1 segments, have a
segment that differs in at most one bit (each other count would need more than
d bits in all). So each distinct fingerprint is indexed under every segment with
each of its bits in turn made a wildcard; fingerprints that share a key are met
by an equality join - here a shuffle and sort by key, read as runs - and
verified by their Hamming distance. Two segments of 32 bits (d = 3) make 64
keys of 31 bits each: of n different fingerprints about n / 2 ** 31 share a key
by chance, five at ten thousand million, each a comparison of two numbers.

A run gives a spanning forest of its links, never its pairs. A wildcard other
than a segment's first is only asked for links across the wildcard bit, as
equal segments already meet under the first. Runs are held ``block`` rows at a
time; the blocks of a longer run are written as they fill, and finished by
comparing them pairwise in tasks of their own. What a task has linked is written
whenever ``HELD`` fingerprints are linked. Components come from large-star /
small-star rounds over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import forget, fresh, quoted, save, spread_join, with_row_id
from inkspan.llm.shingles import shingle_links

BITS, MAX_BITS, BLOCK = 64, 3, 32768
#: Linked fingerprints that a task holds before it writes them.
HELD = 1 << 18
#: From so many edges on, the joins of the star rounds deal a node's edges into parts.
MANY_EDGES = 1 << 20
#: Odd multipliers that turn one shingle hash into further independent ones.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words: of the whole sequence."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not w:
        return np.empty(0, np.uint64)
    j, h = b" ".join, xxhash.xxh64_intdigest
    return np.array([h(j(s), seed) for s in zip(*(w[i:] for i in range(words)))] if len(w) >= words else [h(j(w), seed)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if over half of the hashes have it; 0 of no hash."""
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, *, words: int = 3, seed: int = 42, kinds: int = 1) -> DataFrame:
    """rid, doc_id, kind, fp (as a signed long): ``kinds`` independent fingerprints of each of ``rows`` (rid, doc_id, text)."""
    to = np.array(MIXERS, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.empty((b.num_rows, kinds), np.uint64)
            for r, text in enumerate(b["text"]):
                h = shingle_hashes(text.as_py(), words, seed)
                fps[r, 0] = fingerprint(h)
                for k in range(1, kinds):
                    x = (h ^ (h >> np.uint64(32))) * to[k - 1]
                    fps[r, k] = fingerprint(x ^ (x >> np.uint64(29)))
            many = np.repeat(np.arange(b.num_rows), kinds)
            yield pa.RecordBatch.from_arrays(
                [b["rid"].take(pa.array(many)), b["doc_id"].take(pa.array(many)), pa.array(np.tile(np.arange(kinds, dtype=np.int32), b.num_rows)), pa.array(fps.reshape(-1).view(np.int64))],
                names=["rid", "doc_id", "kind", "fp"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("rid", "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, kind int, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cuts = np.linspace(0, BITS, max_bits // 2 + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits


def forest(fps: np.ndarray, side: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest (as index pairs) of the links among ``fps``; with ``side``, of those between its two sides.

    A search from each component's first member: members found leave the rest,
    so a tight cluster costs little more than one pass.
    """
    links: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found_of = np.full(len(rest), -1, np.int64)
            step = max(1, (1 << 22) // len(rest))
            for at in range(0, len(front), step):
                f = front[at : at + step]
                near = _near(fps[f], fps[rest], max_bits)
                if side is not None:
                    near &= side[f][:, None] != side[rest][None, :]
                hit = near.any(axis=0) & (found_of < 0)
                found_of[hit] = f[near[:, hit].argmax(axis=0)]
            got = found_of >= 0
            links += zip(found_of[got].tolist(), rest[got].tolist())
            front, rest = rest[got], rest[~got]
    return links


class _Union:
    """Union-find over the fingerprints that one task has linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def written(self) -> Iterator[pa.RecordBatch]:
        """Each component as a star; nothing is held after it."""
        many = [x for x in self.up if self.find(x) != x]
        if many:
            yield _rows(np.array([self.find(x) for x in many], np.uint64).view(np.int64), np.array(many, np.uint64).view(np.int64), None, None)
        self.up = {}


def _side(fps: np.ndarray, key: int, cuts: list[tuple[int, int]]) -> np.ndarray | None:
    """Which of two sides each fingerprint is on: its value of the wildcard bit. None under a segment's first wildcard."""
    bit = (key >> 32) & 0xFF
    return None if any(bit == first for first, _ in cuts) else (fps >> np.uint64(bit)) & np.uint64(1)


def _links(max_bits: int, block: int):
    cuts = segments(max_bits)
    firsts = np.array([a for a, _ in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = _Union()
        key_of, held, blocks = None, [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Search what is held of the open run; if more follows (or came before), write it for the pairs of blocks."""
            nonlocal held, blocks
            fps = np.concatenate(held).view(np.uint64) if held else np.empty(0, np.uint64)
            if len(fps) > 1:
                for a, b in forest(fps, _side(fps, key_of, cuts), max_bits):
                    union.add(int(fps[a]), int(fps[b]))
            if len(fps) and (not last or blocks):
                yield _rows(fps.view(np.int64), fps.view(np.int64), np.full(len(fps), key_of, np.int64), np.full(len(fps), blocks, np.int32))
            held, blocks = [], 0 if last else blocks + 1

        for b in batches:
            keys, fps = b["key"].to_numpy(), b["fp"].to_numpy()
            if not len(keys):
                continue
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[at[1:], len(keys)]
            inner = (ends - at == 2) & (np.arange(len(at)) > 0) & (np.arange(len(at)) < len(at) - 1)
            x, y = fps[at[inner]].view(np.uint64), fps[at[inner] + 1].view(np.uint64)
            bit = (keys[at[inner]] >> 32) & 0xFF
            ok = (np.bitwise_count(x ^ y) <= max_bits) & (np.isin(bit, firsts) | (((x ^ y) >> bit.astype(np.uint64)) & np.uint64(1) == 1))
            for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                union.add(p, q)
            for i in np.flatnonzero(~inner & ((ends - at > 2) | (np.arange(len(at)) == 0) | (np.arange(len(at)) == len(at) - 1))):
                if key_of is not None and keys[at[i]] != key_of:
                    yield from flush(True)
                key_of = int(keys[at[i]])
                part = fps[at[i] : ends[i]]
                while len(part):
                    room = block - sum(map(len, held))
                    held.append(part[:room])
                    part = part[room:]
                    if sum(map(len, held)) == block:
                        yield from flush(False)
                if len(union.up) > HELD:
                    yield from union.written()
        if key_of is not None:
            yield from flush(True)
        yield from union.written()

    return run


def _rows(a, b, key, at) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.nulls(n, pa.int32()) if at is None else pa.array(at)], names=["a", "b", "key", "at"]
    )


def near_links(distinct: DataFrame, *, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp``: their components are those of all pairs within ``max_bits`` bits."""
    spots = [(s, first, first + i) for s, (first, width) in enumerate(segments(max_bits)) for i in range(width)]
    masks = {s: ((1 << width) - 1) << first for s, (first, width) in enumerate(segments(max_bits))}

    def key(s: int, first: int, bit: int):
        kept = masks[s] & ~(1 << bit)
        kept -= (1 << 64) if kept >> 63 else 0
        value = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(kept).cast("long")), first)
        return value.bitwiseOR(F.lit(bit << 32).cast("long"))

    wide = max(width for _, width in segments(max_bits)) > 32
    if wide:
        raise ValueError("max_bits must be 2 at least: a segment has to fit 32 bits")
    keyed = distinct.select("fp", F.explode(F.array(*(key(*spot) for spot in spots))).alias("key"))
    out = save(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits, block), "a long, b long, key long, at int"), "links")
    edges = out.where(F.col("key").isNull()).select("a", "b")
    late = out.where(F.col("key").isNotNull()).select(F.col("a").alias("fp"), "key", "at")
    if late.isEmpty():
        return edges
    counts = late.groupBy("key").agg((F.max("at") + 1).alias("n"))
    pairs = (
        late.join(counts, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .where(F.col("other") != F.col("at"))
        .select("fp", "key", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    )
    cuts = segments(max_bits)

    def across(t: pa.Table) -> pa.Table:
        fps, key_of = t["fp"].to_numpy().view(np.uint64), int(t["key"][0].as_py())
        found = forest(fps, _side(fps, key_of, cuts), max_bits)
        i = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": fps[i[:, 0]].view(np.int64), "b": fps[i[:, 1]].view(np.int64)})

    more = pairs.groupBy("key", "i", "j").applyInArrow(across, "a long, b long")
    return edges.unionByName(save(more, "late-links"))


def components(edges: DataFrame, *, many: int = MANY_EDGES) -> DataFrame:
    """node, root of every node of ``edges`` (a, b); root is the smallest node of its component.

    Large-star and small-star rounds until nothing changes; each is two
    aggregations and joins. From ``many`` edges on, the joins deal a node's
    edges into parts, since one node may hold a third of them.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = save(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        meet = lambda e, least, on, by: spread_join(e, least, [on], by, 2 * before[0]) if before[0] >= many else e.join(least, on)  # noqa: B023, E731
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = save(meet(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = meet(large, least, "b", "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*")
        then, now = now, save(small.where("a <> b").distinct(), "small")
        for done in (then, large):
            forget(done)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def simhash_dedup(
    docs: DataFrame, *, words: int = 3, seed: int = 42, kinds: int = 1, max_bits: int = MAX_BITS, block: int = BLOCK, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, fingerprint, component_id, kept.

    Rows link if their fingerprints (with ``kinds`` over 1: any of them, each
    made with other hashes) differ in ``max_bits`` bits at most. With a
    ``similarity`` they link if their sets of shingles are as similar (Jaccard);
    fingerprints then only name rows to compare, beside the keys of ``shingles``
    (see there for the odds that such a pair meets). component_id
    is the smallest id reachable, and ``kept`` marks one row of each component,
    that with the smallest id (a null id last, then the lowest number).
    Texts without words, null ones too, have fingerprint zero and link like any
    other. An empty table gives an empty one. ``rid`` is the row's number: that
    of ``row_col``, else its place in the table's files. Other columns of
    ``docs``, whatever their names, play no part.
    """
    if row_col is None:
        row_col = fresh(docs, "__rid")
        docs = with_row_id(docs, row_col)
    texts = docs.select(F.col(quoted(row_col)).alias("rid"), F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    prints = save(fingerprints(texts, words=words, seed=seed, kinds=kinds), "prints")
    first = prints.where("kind = 0")
    n = first.count()
    if similarity is not None:
        rows = first.withColumn("node", F.col("rid"))
        groups = None
        for k in range(kinds):
            own = prints.where(F.col("kind") == k).select("rid", "fp")
            linked = components(near_links(own.select("fp").distinct(), max_bits=max_bits, block=block)).withColumnRenamed("node", "fp")
            mine = spread_join(own, linked, ["fp"], "rid", n, "left").select("rid", F.xxhash64(F.lit("fingerprint"), F.lit(k), F.coalesce("root", "fp")).alias("key"))
            groups = mine if groups is None else groups.unionByName(mine)
        edges = shingle_links(texts.select("rid", "text"), shingle_hashes, words=words, seed=seed, similarity=similarity, groups=groups)
        blank = texts.where(F.coalesce("text", F.lit("")).rlike(r"^[\x09-\x0D\x20]*\z")).select("rid")
        least = blank.agg(F.min("rid").alias("rid")).first()["rid"]
        edges = edges.unionByName(blank.select(F.lit(least).cast("long").alias("a"), F.col("rid").alias("b")))
    elif kinds == 1:
        node, edges = F.col("fp"), near_links(prints.select("fp").distinct(), max_bits=max_bits, block=block)
        rows = first.withColumn("node", node)
    else:
        # nodes: documents of one first fingerprint; the other kinds link those
        rows = first.withColumn("node", F.col("fp"))
        edges = None
        for k in range(kinds):
            own = prints.where(F.col("kind") == k).select("rid", "fp")
            found = near_links(own.select("fp").distinct(), max_bits=max_bits, block=block)
            if k == 0:
                edges = found
                continue
            # the k-th prints become nodes too, tagged by a hash of kind and value, tied to the rows' first prints
            tag = lambda c, k=k: F.xxhash64(F.lit(k), F.col(c))
            ties = rows.join(own.withColumnRenamed("fp", "fp_k"), "rid").select(F.col("node").alias("a"), tag("fp_k").alias("b")).distinct()
            edges = edges.unionByName(found.select(tag("a").alias("a"), tag("b").alias("b"))).unionByName(ties)
    roots = components(edges)
    labelled = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = save(labelled, "labelled")
    each = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    names = spread_join(labelled.select("node", "root"), each, ["root"], "node", n).select("node", "component_id", F.col("best.rid").alias("best_rid"))
    return spread_join(rows, names, ["node"], "rid", n).select(
        "rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("rid") == F.col("best_rid")).alias("kept")
    )
