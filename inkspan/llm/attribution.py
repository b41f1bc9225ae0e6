"""Token counts of fields and sections, from one encoding of the whole document.

The document is encoded once, with the character offsets of each token, and the
tokens are interval-joined to its sections. A token that crosses a boundary goes
whole to the section that holds most of its characters, on a tie to the first
of these; so the sections' counts add up to the document's. (Encoding each
section alone would give other tokens at every boundary.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.llm.tokens import VOCABULARY, encoder


def lines(text: str) -> np.ndarray:
    """End of each line, its line feed included; one empty section of an empty text."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross its boundary; sections are those that end at ``ends``."""
    low = np.minimum(np.searchsorted(ends, first, side="right"), len(ends) - 1)
    high = np.minimum(np.searchsorted(ends, np.maximum(last - 1, first), side="right"), len(ends) - 1)
    own = low.copy()
    crossing = np.flatnonzero(low < high)
    for t in crossing.tolist():
        cuts = np.r_[first[t], ends[low[t] : high[t]], last[t]]
        own[t] = low[t] + int(np.diff(cuts).argmax())
    return np.bincount(own, minlength=len(ends)), np.bincount(own[crossing], minlength=len(ends))


def token_counts(docs: DataFrame, *, sections: Callable[[str], np.ndarray] = lines, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), start, end, n_tokens, n_crossing, doc_tokens: a row for each section of each row of ``docs``.

    ``sections`` gives the ascending ends of a text's sections, the last its
    length. A null text is empty; an empty one has one section without tokens.
    A token that is a part of a character counts where the character is.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                of, cols = [], ([], [], [], [], [], [])
                for r, t in enumerate(part["text"]):
                    text = t.as_py() or ""
                    ends = sections(text)
                    n, crossing = attribute(*enc.offsets(text), ends)
                    of.append(np.full(len(ends), r))
                    for c, x in zip(cols, (np.arange(len(ends)), np.r_[0, ends[:-1]], ends, n, crossing, np.full(len(ends), n.sum()))):
                        c.append(x)
                take = pa.array(np.concatenate(of))
                kinds = (pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(take), *(pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
