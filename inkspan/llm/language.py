"""Language identification by nearest centroid.

A text is a vector of its character bigrams and trigrams, hashed into ``BINS``
bins, weighted by log term frequency and inverse document frequency and
normalised. Each language has several centroids, clustered (spherical k-means)
from a bounded sample of its texts; the language of the centroid with the
largest cosine wins. Each language also has a radius, the cosine that nearly all
of its sample reaches: a text outside the radius of its winner is rejected,
which lowers its score and is told in a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import crc_mod, fresh, save, unit_hash, with_row_id

BINS, CENTROIDS, PER_LANGUAGE, SHARPNESS = 1 << 14, 4, 400, 25.0
#: Cosines that differ by no more are equal: means of one text's copies round by their number, products by the machine.
ROUNDING = 5e-6
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def bins_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the whole text's n-grams of letters that occur, and how often; what isn't a letter is a blank."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    u = np.where(_LETTER[u], u, np.uint32(32))
    if len(u) < 2:
        u = np.r_[u, np.full(2, 32, np.uint32)]
    u = u[np.r_[True, (u[1:] != 32) | (u[:-1] != 32)]]
    if len(u) < 2:
        u = np.r_[u, np.uint32(32)]
    two = (u[:-1] * np.uint32(0x9E3779B1) + u[1:]) * np.uint32(0x85EBCA77)
    three = (two[:-1] + u[2:]) * np.uint32(0xC2B2AE3D)
    n = np.bincount(np.concatenate((two, three)) >> np.uint32(18), minlength=BINS)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # BINS x centroids
    radius: np.ndarray  # of each centroid's language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text was rejected."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        at, v = weighted(text, self.idf)
        cos = v @ self.centroids[at]
        best = int(np.argmax(cos >= cos.max() - ROUNDING))
        of = {}
        for name, c in zip(self.languages, cos.tolist()):
            of[name] = max(of.get(name, -1.0), c)
        odds = {k: np.exp(SHARPNESS * (c - cos[best])) for k, c in of.items()}
        sure = float(odds[self.languages[best]] / sum(odds.values()))
        rejected = bool(cos[best] < self.radius[best])
        return self.languages[best], sure * max(0.0, min(1.0, float(cos[best] / self.radius[best]))) if rejected else sure, rejected


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = bins_of(text)
    v = ((1 + np.log(n)) * idf[at]).astype(np.float32)
    return at, v / max(1e-12, float(np.linalg.norm(v)))


def cluster(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from a spread-out start; fewer centroids if there are fewer different rows."""
    c = x[:1]
    while len(c) < min(k, len(x)):
        far = (x @ c.T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        c = np.r_[c, x[[int(far.argmin())]]]
    for _ in range(steps):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    return c


def fit(docs: DataFrame, *, centroids: int = CENTROIDS, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2.

    Document frequencies count all of these rows; about ``per_language`` texts
    of each language at most, chosen by a hash of their id and place, are
    clustered, so rows that repeat an id are chosen one by one. The model holds
    ``centroids`` vectors a language: languages are few by their nature.
    Null texts and texts without a letter teach nothing; of an empty table comes
    a model without languages. Other columns play no part.
    """
    rid = fresh(docs, "__rid")
    rows = with_row_id(docs.select("doc_id", "text", "lang"), rid).where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BINS + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                if has_letter(text := t.as_py()):
                    df[bins_of(text)[0]] += 1
                    n += 1
        df[BINS] = n
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS + 1, dtype=np.int32), "n": df})

    df = np.zeros(BINS + 1)
    for r in rows.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        df[r["bin"]] = r["n"]
    idf = (np.log((1 + df[BINS]) / (1 + df[:BINS])) + 0.1).astype(np.float32)
    sizes = [(r["lang"], min(1.0, per_language / r["n"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return Model(idf, [], np.empty((BINS, 0)), np.empty(0))
    rate = docs.sparkSession.createDataFrame(sizes, "lang string, rate double")
    sample = rows.join(F.broadcast(rate), "lang").where(unit_hash(5, "doc_id", rid) < F.col("rate")).select("lang", "text", F.xxhash64("doc_id", rid).alias("spread"))

    def learn(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["spread"].to_numpy(), kind="stable")))
        texts = [x for x in t["text"].to_pylist() if has_letter(x)]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32())), "radius": pa.array([], pa.float64())})
        x = np.zeros((len(texts), BINS), np.float32)
        for i, text in enumerate(texts):
            at, v = weighted(text, idf)
            x[i, at] = v
        c = cluster(x, centroids)
        radius = float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(c)), "centroid": pa.array(list(c), pa.list_(pa.float32())), "radius": pa.array([radius] * len(c), pa.float64())})

    found = sorted(save(sample.groupBy("lang").applyInArrow(learn, "lang string, centroid array<float>, radius double"), "centroids").collect(), key=lambda r: (r["lang"], r["centroid"]))
    return Model(idf, [r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(-1, BINS).T.copy(), np.array([max(1e-6, r["radius"]) for r in found]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row.

    A null text, or one without a letter of any alphabet, is ``und`` with score
    0, and so is every text where nothing was learned. Of languages whose
    centroids are equally near but for rounding, the first by name wins. Rows that repeat a text
    or an id are predicted alike, an empty table gives an empty one, whole texts
    are read however long. lang, source and doc_id are never looked at, nor are
    other columns, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
