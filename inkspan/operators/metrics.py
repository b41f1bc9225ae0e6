"""Recognition quality: error rates, recall and precision, by page and by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import ratio


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate."""
    return ratio(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Of word lists, a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    names = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([names[w] for w in b], np.int64)
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != names[w]))
        row = np.r_[i, step]
        # insertions: each place may be reached from any place before it
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def word_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with ``word_distance`` between two array columns; null counts as no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [edit_distance(x or [], y or []) for x, y in zip(b[reference].to_pylist(), b[hypothesis].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.int32())], names=[*b.schema.names, "word_distance"])

    return pairs.mapInArrow(run, pairs.withColumn("word_distance", F.lit(0)).schema)


def share_found(of: Column, among: Column) -> Column:
    """Share of ``of``'s words, repeats counted, that occur in ``among``; 1 of no words."""
    hits = F.size(F.filter(of, lambda w: F.array_contains(among, w)))
    return F.when(F.size(of) == 0, 1.0).otherwise(hits / F.size(of))
