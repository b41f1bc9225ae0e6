"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1; all other text is
unlabelled, never negative. The share of positives in it (the class prior) is
estimated by best-bin estimation: with a first classifier of positives against
unlabelled rows, it is the least ratio of the two classes' shares above a
threshold. Then an additive model over binned text statistics minimises the
non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)]).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import crc_mod, fresh, save, unit_hash, with_row_id
from inkspan.llm.learning import PER_CLASS, logistic, sigmoid

THRESHOLD, BINS, STATISTICS = 0.3, 8, 17
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:'\"()-", 5), (b"!?", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 1


def features(text: str) -> list[float]:
    """Statistics of the whole text; all 0 of an empty one."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    counts = Counter(words)
    most = counts.most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x]
    bare = sum(1 for w in words if not w[:1].isalnum() and w[0] < 128)
    tail = sum(1 for w in words if w[-1:] in b"#$%&*+/<=>@[\\]^_`{|}~!")
    return [
        math.log1p(n), len(counts) / n, most / n, sum(map(bytes.__eq__, words, words[1:])) / n, len(raw) / n,
        share[1], share[2], share[3], share[4], share[5], share[6], share[7], bare / n, tail / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(1 for w in words if len(w) <= 3) / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    coefficients: np.ndarray
    prior: float

    @property
    def width(self) -> int:
        return sum(len(e) + 1 for e in self.edges)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The column of each statistic's bin: a row of the additive model has a one in each of these, and nothing else."""
        first = np.cumsum([0, *(len(e) + 1 for e in self.edges[:-1])])
        return np.stack([a + np.searchsorted(e, x[:, j], side="right") for j, (a, e) in enumerate(zip(first, self.edges))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(margin(self.encode(x), self.coefficients))


def margin(bins: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sum of the coefficients of each row's bins, and the last one."""
    return c[bins].sum(axis=1) + c[-1]


def one_hot(bins: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(bins), width))
    np.put_along_axis(out, bins, 1, axis=1)
    return out


def class_prior(pos: np.ndarray, unl: np.ndarray, times: np.ndarray | None = None) -> float:
    """Best-bin estimate from scores of rows that the classifier was not fitted on; ``times`` tells how often each of ``unl`` comes."""
    times = np.ones(len(unl)) if times is None else times
    at = np.unique(np.r_[pos, unl])
    order = np.argsort(unl)
    below = np.r_[0, np.cumsum(times[order])]
    p = 1 - np.searchsorted(np.sort(pos), at) / len(pos)
    u = 1 - below[np.searchsorted(unl[order], at)] / below[-1]
    slack = math.sqrt(math.log(40) / 2 / len(pos)) + math.sqrt(math.log(40) / 2 / below[-1])
    ok = p > 0
    best = np.argmin((u[ok] + slack) / p[ok])
    return float(np.clip(u[ok][best] / p[ok][best], 0.05, 0.98))


def non_negative_risk(pos: np.ndarray, unl: np.ndarray, width: int, prior: float, *, ridge: float = 1e-4, steps: int = 1500, rate: float = 0.05) -> np.ndarray:
    """Minimise the risk over rows of bins by Adam; while the negative part is below 0 its own gradient is walked back."""
    c = np.zeros(width + 1)
    m, v = np.zeros_like(c), np.zeros_like(c)
    each = pos.shape[1]
    down = lambda bins, w: np.r_[np.bincount(bins.reshape(-1), np.repeat(w, each), width), w.sum()] / len(bins)
    for t in range(1, steps + 1):
        zp, zu = margin(pos, c), margin(unl, c)
        gp, gu = sigmoid(zp), sigmoid(zu)
        # log loss: l(z) = log(1 + exp(-z)), so l(-z) = log(1 + exp(z))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = down(unl, gu) - prior * down(pos, gp)
        g = (-prior * down(pos, 1 - gp) + g_neg if negative >= 0 else -g_neg) + ridge * c
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        c = c - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return c


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, rid, x: the statistics of each row's whole text, saved, since fitting and scoring both read them."""
    rid = fresh(docs, "__rid")
    rows = with_row_id(docs.select("doc_id", "text"), rid)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b[rid], pa.array([features(t.as_py() or "") for t in b["text"]], pa.list_(pa.float64()))], names=["doc_id", "rid", "x"])

    return save(rows.select("doc_id", "text", rid).mapInArrow(run, f"doc_id {kind}, rid long, x array<double>"), "statistics")


def fit(statistics: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model | None:
    """Learn from rows of ``measured`` whose crc32(doc_id) mod 5 is not 0.

    The bins' edges and the class prior are worked out over all of these rows;
    the two fits take about ``per_class`` labelled positives and twice as many
    unlabelled rows at most, chosen by a hash of id and place, so rows that
    repeat an id are chosen one by one. None if there is no positive or no row
    to learn from. Labels that are null or neither 0 nor 1 don't count.
    """
    rows = statistics.where(crc_mod(F.col("doc_id"), 5) != 0)
    quantiles = [*np.linspace(0, 1, BINS + 1)[1:-1].tolist(), 0.01, 0.05, 0.95, 0.99]
    at = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(F.col("x")[j], quantiles).alias(f"x{j}") for j in range(STATISTICS))).first()
    good = save(rows.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id"), "positives")
    rate, share = min(1.0, per_class / max(1, good.count())), min(1.0, 2 * per_class / max(1, at["n"]))
    draw = unit_hash(11, "doc_id", "rid")
    taken = lambda of, rate: np.array([r["x"] for r in of.where(draw < rate).select("x", draw.alias("d")).orderBy("d", "x").collect()], float).reshape(-1, STATISTICS)
    pos, unl = taken(good, rate), taken(rows, share)
    if not len(pos) or not len(unl):
        return None
    model = Model([np.unique(at[f"x{j}"]) for j in range(STATISTICS)], np.zeros(1), 0.5)
    p, u = model.encode(pos), model.encode(unl)
    hp, hu = max(1, len(p) // 2), int(np.ceil(len(u) / 2))
    hot = one_hot(np.r_[p[:hp], u[:hu]], model.width)
    first = logistic(hot, np.r_[np.ones(hp), np.zeros(hu)], np.r_[np.full(hp, 1 / hp), np.full(hu, 1 / hu)] * 1000, ridge=2.0)
    step = lambda z: np.floor(np.clip(z, -30, 30) * 64).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            found, n = np.unique(step(margin(model.encode(x), first)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"z": found, "n": n})

    # the sample's first half is what the classifier was fitted on: rows are in the order of their draw
    rest = rows.where(draw >= share / 2).select("x").mapInArrow(counted, "z long, n long").groupBy("z").agg(F.sum("n").alias("n")).collect()  # 3841 steps at most
    of_rest = (np.array([r["z"] for r in rest], float), np.array([r["n"] for r in rest], float)) if rest else (step(margin(u, first)).astype(float), np.ones(len(u)))
    model.prior = class_prior(step(margin(p[hp:] if len(p) > hp else p, first)).astype(float), *of_rest)
    model.coefficients = non_negative_risk(p, u, model.width, model.prior)
    return model


def score(statistics: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, rid, quality_score (0 to 1) of each row of ``measured``; a model of None scores 0.5.

    Null and empty texts are scored by their statistics, all 0; equal texts
    alike. An empty table gives an empty one. Only the statistics are looked at.
    """
    kind = dict(statistics.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rid"], pa.array(model(x) if model else np.full(len(x), 0.5))], names=["doc_id", "rid", "quality_score"])

    return statistics.mapInArrow(run, f"doc_id {kind}, rid long, quality_score double")
