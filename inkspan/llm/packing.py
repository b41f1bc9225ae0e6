"""Best-fit packing by exact-complement hashing.

Documents are encoded once and cut into pieces of at most ``size`` tokens. All
planning happens on the histogram of piece lengths, which has ``size`` entries
however large the corpus is: for each length, longest first, the index of
available single, pair and triple length sums is asked for the exact
complement, and as many sequences as availability allows are taken of that
combination; what has no exact complement goes best-fit, longest first. The
plan is a list of (length, range of ranks) -> (range of sequences, offset), a
few thousand rows at most, and pieces find their place by their rank among
those of their length. Ranks come from counts by (length, bucket) and a row
number within each bucket, so no length is ever in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import quoted, save, with_row_id
from inkspan.llm.tokens import VOCABULARY, encoder

SIZE, END_ID, BUCKET_ROWS = 1024, 2, 4096


def pieces(docs: DataFrame, *, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, piece, start, length, ids_crc32: only documents over ``size`` are cut; their first piece takes the remainder."""
    rows = with_row_id(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b["text"]):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    of.append(r), piece.append(k), start.append(a), length.append(z - a), crc.append(zlib.crc32(ids[a:z].tobytes()))
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["rid"].take(of), b["doc_id"].take(of), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("rid", "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Available:
    """How many pieces of each length are left, and the sums of one, two or three of them."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest member; two of one length need two of it."""
        half = gap // 2
        there = (self.left[gap - half : gap] > 0) & (self.left[half:0:-1] > 0)
        if gap % 2 == 0 and len(there) and self.left[half] < 2:
            there[0] = False
        at = np.flatnonzero(there)
        return (gap - half + int(at[-1]), half - int(at[-1])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.left[:gap - 1])[::-1].tolist():
            if a * 3 < gap:
                return None
            self.left[a] -= 1
            two = self.pair(gap - a)
            self.left[a] += 1
            if two:
                return (a, *two)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up ``counts`` of pieces by length."""
    have, out = _Available(counts, size), []

    def take(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = int(min(have.left[x] // k for x, k in need.items()))
        for x, k in need.items():
            have.left[x] -= k * n
        out.append((lengths, n))

    if have.left[size]:
        take((size,))
    for length in range(size - 1, 0, -1):
        while have.left[length]:
            have.left[length] -= 1
            found = have.single(size - length) or have.pair(size - length) or have.triple(size - length)
            have.left[length] += 1
            if not found:
                break
            take((length, *found))
    # Best fit, longest first, on groups of like sequences: by gap, the sequences with that gap.
    open_at: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = size - sum(lengths)
        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append([lengths, n])

    for length in np.flatnonzero(have.left)[::-1].tolist():
        left = int(have.left[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = size // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            gap = gaps[at]
            lengths, n = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            k = min(n, left)
            left -= k
            if n > k:
                put(lengths, n - k)
            put((*lengths, length), k)
    return out + [(lengths, n) for groups in open_at.values() for lengths, n in groups]


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and first rank: sorted arrays key (length << 40 | rank), sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in found:
        offset = 0
        for x in lengths:
            rows.append((x << 40 | used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    rows.sort()
    key, seq, off = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
    return {"key": key, "sequence": seq, "offset": off}


def pack(docs: DataFrame, *, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: rid, doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece that holds the end id alone.
    Repeated rows and null ids are packed as rows of their own, and pieces of one
    length are told apart by their row's place in the table's files and their
    place in it. An empty table gives an empty one. Other columns, whatever
    their names, play no part.
    """
    cut = save(pieces(docs, size=size, end_id=end_id, vocabulary=vocabulary, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` rows at most
    where = places(plan(counts, size))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), F.lit(buckets)))
    before = (
        cut.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "piece"))).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b["length"].to_numpy() << 40) | b["rank"].to_numpy()
            at = np.searchsorted(where["key"], key, side="right") - 1
            cols = {c: b[c] for c in ("rid", "doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": where["sequence"][at] + (key - where["key"][at]), "offset": where["offset"][at]})

    kind = dict(cut.dtypes)["doc_id"]
    return ranked.select("rid", "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
