"""Collision counting against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm.neighbours import nearest
from inkspan.llm.queries import QUERIES


def test_recall(spark):
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    got = {}
    for r in QUERIES["op8_collision_counting"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in x if i % 100 == 0}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        for _, i, s in rows:
            assert i != q and s == pytest.approx(math.dist(x[i], x[q]), abs=1e-12)
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        want = [i for _, i in sorted(zip(d, ids)) if i != q][:10]
        hits += len({i for _, i, _ in rows} & set(want))
    assert hits / 10 / len(got) >= 0.9


SCHEMA = "vec_id long, embedding array<float>, shard int, v string, rid long"


def test_odd(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [0.0, 0.0]), (10, None), (11, [float("nan"), 1.0]), (12, [None, 1.0]), (13, [1.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    spark.createDataFrame([(*r, 1, "a", 2) for r in rows], SCHEMA).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    out = [tuple(r) for r in nearest(df, F.col("vec_id") % 100 == 0, shard_rows=3, query_rows=1).collect()]
    zero = sorted(r for r in out if r[0] == 0)
    assert len(zero) == 10 and [r[2] for r in zero if r[1] <= 3] == [0, 0, 3, 3, 7, 7]
    assert [r[2:] for r in sorted(r for r in out if r[0] == 100)] == [(8, 1.0), (0, math.sqrt(2)), (0, math.sqrt(2)), (3, math.sqrt(2)), (7, math.sqrt(2))]
    assert {r[0] for r in out} == {0, 100}
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_one_vector_held_by_a_third(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist())) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e"))
    out = nearest(spark.read.parquet(str(tmp_path / "e")), F.col("vec_id") == 300, shard_rows=200).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == [3 * i for i in range(10)]
