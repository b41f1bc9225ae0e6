"""A training corpus from ``documents``: five stages, each reading what its predecessor wrote.

    toxicity       rows whose toxicity reaches the threshold go
    exact_dedup    of equal texts the row with the largest id stays
    near_dedup     one row of each group of near copies stays
    mixing         each source is brought to its target: rows go or are repeated
    packing        the rest is packed into sequences

All but the last return the columns of ``documents`` (any others, too, whatever
their names). Rows are told apart by their place in the table's files, so null
and repeated ids do no harm; a stage is given a table read from files. An empty
table gives an empty one at every stage. The table of a stage is deleted when
the next one's is written, with all that the stage wrote for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import toxicity
from inkspan.llm.common import forget, fresh, read, save, scratch, with_row_id
from inkspan.llm.exact_dedup import exact_dedup
from inkspan.llm.mixing import mix
from inkspan.llm.packing import pack
from inkspan.llm.simhash import simhash_dedup

#: Near copies: a similarity of the sets of shingles of five words of 0.8 (odds in the README).
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the number's column: a name that ``docs`` doesn't have."""
    row = fresh(docs, "__corpus_row")
    return with_row_id(docs, row), row


def _joined(rows: DataFrame, row: str, decisions: DataFrame) -> DataFrame:
    """``rows`` that ``decisions`` (rid) name, as often as they do, without the number."""
    return rows.join(decisions.select(decisions["rid"].alias(row)), row).drop(row)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below ``toxicity.THRESHOLD``, by a model of this table's labelled rows.

    A null or empty text is scored as one without a match and stays. Rows of one
    text go or stay together. Only numbers and texts cross to Python, in the
    batches of ``save``: rows that cross when the caller writes do so 10,000 at
    a time, which no operator can change.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows, row = _numbered(docs)
    scored = toxicity.score(rows.select(F.col(row).alias("rid"), "text"), model, score_col="score")
    kept = save(scored.where(F.col("score") < toxicity.THRESHOLD).select("rid"), "clean")
    return _joined(rows, row, kept.hint("merge"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null being empty: that with the largest id; a null id is below all, of one id the first in the files."""
    rows, row = _numbered(docs)
    return _joined(rows, row, exact_dedup(rows, row_col=row).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, a null id last, of one id the first in the files.

    Texts without words are copies of each other; a text of fewer words than a
    shingle is a shingle of its own.
    """
    rows, row = _numbered(docs)
    return _joined(rows, row, simhash_dedup(rows, words=NEAR_WORDS, similarity=NEAR_SIMILARITY, row_col=row).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; null sources are one source, texts without words are drawn like others and add nothing."""
    rows, row = _numbered(docs)
    taken = mix(rows, row_col=row).where("copies > 0")
    return _joined(rows, row, taken.select("rid", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece (see ``pack``); null and empty texts give a piece of the end id alone, repeated rows pieces of their own."""
    return pack(docs).drop("rid")


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The learned stage and the draws of the mix have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; the last stage's rows."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = save(stage(spark, docs, sf_dir), name)
            made.remove(docs)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
