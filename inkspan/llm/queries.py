"""The registered queries: each applies one operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import language, quality, toxicity
from inkspan.llm.attribution import token_counts
from inkspan.llm.common import crc_mod, read
from inkspan.llm.exact_dedup import exact_dedup
from inkspan.llm.mixing import mix
from inkspan.llm.neighbours import nearest
from inkspan.llm.packing import pack
from inkspan.llm.secrets import KINDS, scan_secrets
from inkspan.llm.simhash import simhash_dedup


def _held_out(n: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) modulo ``n`` is ``fold``; false of a null id."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == fold, F.lit(False)).alias("held_out")


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs))
    return out.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), "layers", "cut")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out(3, 1), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("rid")


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.measured(read(spark, sf_dir, "documents"))
    out = quality.score(rows, quality.fit(rows, read(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out(5, 0), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_cube_mixing,
        op2_language_id,
        op3_simhash_near_dedup,
        op4_secret_scan,
        op5_toxicity,
        op6_token_counts,
        op7_best_fit_packing,
        op8_collision_counting,
        op9_quality,
        op10_exact_dedup,
    )
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
