"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of tokens; a token's class is found in a lexicon of
insults (words and stems with weights), threats, targets, negators and words of
reported speech. Small weighted transducers, one for each of these, are composed
in a row: each rewrites the symbols that the one before it writes, so that an
insult or a threat weighs more beside the one it is aimed at, and the whole of
that less when it is negated or only reported. Scores of clauses, never of
isolated words, are turned into a probability by a logistic fit.

The lexicon starts from a few common words and grows by what the labelled rows
show: terms whose documents are toxic far more often than chance would let any
term of the sample be, counted by the different contexts they stand in, so that
copies of one document prove nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import crc_mod, quoted
from inkspan.llm.learning import PER_CLASS, labelled_sample, logistic, sigmoid

THRESHOLD = 0.7
INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb imbecile crétin idiote débile connard abruti dummkopf idiotisch blöd arschloch abschaum estúpido imbécil tonto basura idiota asqueroso".split()
THREATS = "kill hurt destroy beat punch stab shoot burn tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your you're he she they him her them tu toi vous lui elle eux du dich dir ihr sie euch tú usted ustedes él ella ellos".split()
NEGATORS = "not no never isn't aren't wasn't don't pas jamais nicht kein keine nie nunca ningún".split()
REPORTERS = "said says wrote claimed quoted called reported dit écrit sagte schrieb dijo escribió".split()
#: What a threat without a target keeps, what one with a target gains, what an insult with one gains.
UNAIMED, AIMED, AIMED_INSULT = 0.15, 1.85, 1.5
#: What negation and reported speech leave of a clause, what a repeat counts.
NEGATED, REPORTED, AGAIN = 0.3, 0.5, 0.6
STEMS = range(3, 9)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PART = re.compile(WORD.pattern + "|[.!?;:]")
FAR = 1 << 30

Symbols = list[tuple[str, float]]  # class, weight


@dataclass(frozen=True)
class Near:
    """Transducer: rewrites symbols of class ``on`` by whether one of class ``by`` stands near.

    One automaton reads forward and counts from the last symbol of ``by``,
    another reads backward; a symbol that stands within ``behind`` after one or
    ``ahead`` before one has its weight multiplied by ``inside``, any other by
    ``outside``; with ``to``, one inside also changes its class.
    """

    on: str
    by: str
    behind: int
    ahead: int
    inside: float = 1.0
    outside: float = 1.0
    to: str | None = None

    def __call__(self, symbols: Symbols) -> Symbols:
        near = [False] * len(symbols)
        for reach, way in ((self.behind, range(len(symbols))), (self.ahead, range(len(symbols) - 1, -1, -1))):
            since = FAR
            for i in way:
                since += 1
                near[i] |= since <= reach
                if symbols[i][0] == self.by:
                    since = 0
        return [(self.to or kind if hit else kind, weight * (self.inside if hit else self.outside)) if kind in self.on else (kind, weight) for (kind, weight), hit in zip(symbols, near)]


@dataclass(frozen=True)
class Emit:
    """Transducer: passes symbols of class ``kind`` on; a repeat in one clause counts ``again``."""

    kind: str
    again: float

    def __call__(self, symbols: Symbols) -> Symbols:
        out, met = [], False
        for kind, weight in symbols:
            out.append((kind, weight * self.again if met and kind == self.kind else weight))
            met |= kind == self.kind
        return out


#: Composed in this order, each reading what the one before it writes: a reporter's own pronoun is no target;
#: threats and insults are emitted; targets aim them; negation before them and reported speech anywhere in
#: the clause act on all of that.
GRAMMAR = (
    Near("P", "R", 0, 1, to="O"),
    Emit("I", AGAIN),
    Emit("T", AGAIN),
    Near("T", "P", 0, 3, AIMED, UNAIMED),
    Near("I", "P", 8, 3, AIMED_INSULT),
    Near("IT", "N", FAR, 0, NEGATED),
    Near("IT", "R", FAR, FAR, REPORTED),
)


def clause_score(symbols: Symbols) -> float:
    """Weight of the composed transducers' output for one clause."""
    for transducer in GRAMMAR:
        symbols = transducer(symbols)
    return sum(weight for kind, weight in symbols if kind in "IT")


@dataclass
class Lexicon:
    words: dict[str, tuple[str, float]]
    stems: dict[str, float]

    def look(self, word: str) -> tuple[str, float] | None:
        found = self.words.get(word)
        weight = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
        if weight and (found is None or found[0] == "I" and found[1] < weight):
            return "I", weight
        return found


def base_lexicon() -> Lexicon:
    out: dict[str, tuple[str, float]] = {}
    for kind, words, weight in (("P", TARGETS, 0.0), ("N", NEGATORS, 0.0), ("R", REPORTERS, 0.0), ("T", THREATS, 1.0), ("I", INSULTS, 2.0)):
        out |= {w: (kind, weight) for w in words}
    return Lexicon(out, {})


class Reader:
    """Turns texts into clause scores; keeps the classes of tokens that it has met."""

    KEEP, LONGEST = 300_000, 64

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.seen = lexicon, {}

    def _class(self, token: str) -> tuple[tuple[str, float, str], ...] | None:
        """class, weight and the mark that follows (empty: none) of each word of a token; None of one plain word."""
        out: list[tuple[str, float, str]] = []
        for m in PART.finditer(token):
            if m[0] not in ".!?;:":
                out.append((*(self.lexicon.look(m[0]) or ("O", 0.0)), ""))
            elif out:
                out[-1] = (*out[-1][:2], out[-1][2] or m[0])
            else:
                out.append(("O", 0.0, m[0]))
        found = None if not out or len(out) == 1 and out[0][0] == "O" and not out[0][2] else tuple(out)
        if len(token) <= self.LONGEST:
            if len(self.seen) > self.KEEP:
                self.seen.clear()
            self.seen[token] = found
        return found

    def read(self, text: str) -> tuple[list[tuple[float, tuple]], int]:
        """Score and scored symbols of each clause that matches, and the number of words.

        A line's end or a closing mark ends a clause, but a colon after a word
        of reported speech, as what follows is what was said.
        """
        out: list[tuple[float, tuple]] = []
        n = 0
        get, look = self.seen.get, self._class
        miss = object()

        def close() -> None:
            if scored and (score := clause_score(clause)):
                out.append((score, tuple(clause)))

        for line in text.lower().split("\n"):
            tokens = line.split()
            found = [x if (x := get(t, miss)) is not miss else look(t) for t in tokens]
            some = [x for x in found if x is not None]
            n += len(tokens) - len(some) + sum(map(len, some))
            if not any(s[1] for x in some for s in x):
                continue
            clause: Symbols = []
            scored = False  # only insults and threats have weights
            for x in found:
                if x is None:
                    clause.append(("O", 0.0))
                    continue
                for kind, weight, mark in x:
                    clause.append((kind, weight))
                    scored = scored or weight > 0
                    if mark and not (mark == ":" and any(k == "R" for k, _ in clause[-3:])):
                        close()
                        clause, scored = [], False
            close()
        return out, n

    def features(self, text: str) -> np.ndarray:
        """Of the clauses that match: the largest score, their scores' sum, number and density; how many differ; whether any does."""
        found, n = self.read(text)
        s = [score for score, _ in found]
        return np.array([max(s, default=0.0), math.log1p(sum(s)), math.log1p(len(s)), math.log1p(100 * sum(s) / max(1, n)), math.log1p(len({c for _, c in found})), float(bool(s))])


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def scorer(self):
        reader = Reader(self.lexicon)
        return lambda text: float(sigmoid(np.append(reader.features(text or ""), 1.0) @ self.coefficients))


#: Used where the labelled rows hold only one class: a plain match is toxic.
DEFAULT = np.array([0.5, 1.0, 0.5, 0.5, 0.5, 1.0, -3.0])


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _support(positive: float, negative: float, p: float, n: float) -> float:
    """Likelihood ratio (G squared) of a term's counts against the classes' totals; 0 if it leans to the negative."""
    if positive * n <= negative * p:
        return 0.0
    of = p / (p + n)
    k = positive + negative
    return 2 * (positive * math.log(positive / (k * of)) + (negative * math.log(negative / (k * (1 - of))) if negative else 0.0))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The base lexicon and the terms that the sample's toxic rows hold far more often than the others."""
    out = base_lexicon()
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return out

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = (Counter(), Counter())
            for b in batches:
                for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                    found[y].update(t for t in _terms(text) if only is None or t in only)
            terms = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "pos": pa.array([found[1][t] for t in terms], pa.int64()), "neg": pa.array([found[0][t] for t in terms], pa.int64())})

        return run

    def counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
        return rows.select("text", "y").mapInArrow(count(only), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    # A term of k toxic rows and no other has G squared 2 k ln((p + n) / p); fewer rows than this can't pass.
    vocabulary = counted(sample.where("y = 1"), None)
    size = vocabulary.count()
    floor = 2 * math.log(max(2, size)) + 6
    least = floor / (2 * math.log((p + n) / p))
    first = {r["term"] for r in vocabulary.where(F.col("pos") >= least).select("term").collect()}
    second = {r["term"] for r in counted(sample, first).collect() if _support(r["pos"], r["neg"], p, n) >= floor}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple[str, int, str]] = set()
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                words = WORD.findall(text.lower())
                for i, w in enumerate(words):
                    for t in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                        if t in second:
                            rows.add((t, y, f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"))
            t, y, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"term": pa.array(t, pa.string()), "y": pa.array(y, pa.int32()), "around": pa.array(c, pa.string())})

    seen = sample.select("text", "y").mapInArrow(contexts, "term string, y int, around string").distinct().groupBy("term").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    for r in seen.collect():
        weight = math.log((r["pos"] + 0.5) / p * n / (r["neg"] + 0.5))
        if _support(r["pos"], r["neg"], p, n) >= floor and weight >= 2:
            if r["term"].endswith("*"):
                out.stems[r["term"][:-1]] = min(weight, 6.0) / 2
            elif out.words.get(r["term"], ("I",))[0] == "I":
                out.words[r["term"]] = ("I", min(weight, 6.0) / 2)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 3 is not 1; at most about ``per_class`` rows of each class."""
    sample = labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1, per_class=per_class)
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([reader.features(t).tolist() for t in b["text"].to_pylist()], pa.list_(pa.float64())), "y": b["y"], "weight": b["weight"]})

    rows = sample.select("text", "y", "weight").mapInArrow(run, "x array<double>, y int, weight double").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, DEFAULT)
    return Model(lexicon, logistic(np.array([r["x"] for r in rows]), y, np.array([r["weight"] for r in rows])))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``score_col`` (0 to 1) put last; all other columns stay, whatever their names.

    A null or empty text has the score of a text in which nothing matches. A
    column that already has the name is replaced, so give one that ``docs``
    doesn't have to keep it. Equal texts have equal scores, an empty table gives
    an empty one. The whole text is read, however long.
    """
    rows = docs.select(*(F.col(quoted(c)) for c in docs.columns if c != score_col))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([of(t.as_py()) for t in b.column(at)], pa.float64())], names=[*b.schema.names, "score"])

    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # Arrow functions take no names with dots
    return plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema).toDF(*rows.columns, score_col)
