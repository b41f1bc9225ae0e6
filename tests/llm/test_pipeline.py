"""The pipeline: each stage against what it must keep, on the small tables and on awkward rows."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkspan.llm import common, toxicity
from inkspan.llm.common import read
from inkspan.llm.mixing import mix
from inkspan.llm.simhash import shingle_hashes

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def stages(spark, docs, sf_dir, tmp_path):
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        yield name, docs, out
        docs = out


def near_groups(texts):
    """Components of all pairs of texts whose sets of five-word shingles are alike at 0.8, by comparing every pair that shares a shingle."""
    sets = [frozenset(shingle_hashes(t, 5, 1).tolist()) for _, t in texts]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        both = Counter(j for h in s for j in where.get(h, ()))
        for j, n in both.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                up[find(i)] = find(j)
        for h in s:
            where.setdefault(h, []).append(i)
    blank = [i for i, s in enumerate(sets) if not s]
    for i in blank[1:]:
        up[find(i)] = find(blank[0])
    out = {}
    for i, row in enumerate(texts):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def test_stages(spark, tmp_path):
    for name, before, after in stages(spark, read(spark, SMALL, "documents"), SMALL, tmp_path):
        a = rows(before)
        if name != "packing":
            assert after.columns == before.columns
            b = rows(after)
            assert b.keys() <= a.keys()
        if name == "toxicity":
            model = toxicity.fit(before, read(spark, SMALL, "labels"))
            scores = {r.doc_id: r.toxicity for r in toxicity.score(before, model).collect()}
            assert b == Counter({k: n for k, n in a.items() if scores[k[0]] < toxicity.THRESHOLD})
        elif name == "exact_dedup":
            best = {}
            for d, t in a:
                best[t] = max(d, best.get(t, -1))
            assert b == Counter((d, t) for t, d in best.items())
        elif name == "near_dedup":
            roots = near_groups(list(a))
            want = {min(d for d, _ in group) for group in roots}
            got = {d for d, _ in b}
            # pairs at 0.8 meet by chance in at most a thousandth of cases, see the README
            assert len(got - want) <= 0.01 * len(want) and not want - got and set(b.values()) == {1}
        elif name == "mixing":
            assert max(b.values()) <= 2
            taken = {r.rid: r.copies for r in mix(before).collect()}
            assert sum(taken.values()) == sum(b.values())
            for source in {r.source for r in mix(before).select("source").distinct().collect()}:
                own = [r for r in mix(before).where(F.col("source").eqNullSafe(F.lit(source))).collect()]
                assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
                assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) <= 2
        else:
            assert {r.doc_id: r.n for r in after.where("piece = 0").groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == Counter(d for d, _ in a.elements())


def test_no_text_crosses_to_python_while_a_caller_writes_clean_rows(spark, tiny):
    """Arrow batches then have the session's 10,000 rows, which filled executors on larger tables; those of ``save`` have 1,024."""
    docs = read(spark, tiny, "documents")
    out = corpus_pipeline.toxicity_stage(spark, docs, tiny)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "EvalPython" not in plan
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_odd(spark, odd, empty, tmp_path):
    for i, docs in enumerate((odd, empty)):
        (tmp_path / str(i)).mkdir()
        for name, before, after in stages(spark, docs, SMALL, tmp_path / str(i)):
            if name != "packing":
                assert after.columns == before.columns
            if name == "exact_dedup":
                assert max(Counter(r.text or "" for r in after.collect()).values(), default=1) == 1


@pytest.fixture
def many_files(spark, tmp_path):
    """The small documents in 12 files of uneven sizes, with clashing and dotted names and a null and a repeated id."""
    docs = read(spark, SMALL, "documents").withColumn("toxicity", F.lit(-7.0)).withColumn("a.b", F.lit(1)).withColumn("__corpus_row", F.col("doc_id") * 3).withColumn("__corpus_score", F.lit("x"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 50 == 3, None).when(F.col("doc_id") % 50 == 4, 4).otherwise(F.col("doc_id")))
    for i in range(12):
        docs.where(F.pmod(F.xxhash64("text"), F.lit(78)) < 12 * i + 1 - i * i if i < 3 else F.pmod(F.xxhash64("text"), F.lit(78)) % 12 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "d.parquet"))
    return spark.read.parquet(str(tmp_path / "d.parquet"))


def test_decisions_come_back_however_the_scan_is_split(spark, many_files):
    """The files are split anew between each decision and its join."""
    def split(n):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 128 << 20 if n < 8 else 100_000)

    of = lambda df: Counter(tuple(r) for r in df.select("__corpus_row", "doc_id", "toxicity", F.col("`a.b`"), "__corpus_score").collect())
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = []
            for first, then in ((2, 12), (12, 2)):
                split(first)
                out = stage(spark, many_files, SMALL)
                split(then)
                assert out.columns == many_files.columns
                found.append(of(out))
            assert found[0] == found[1] and all(t == -7.0 and s == "x" for _, _, t, _, s in found[0])
            if name == "exact_dedup":
                split(3)
                texts = [r.text or "" for r in stage(spark, many_files, SMALL).collect()]
                assert len(texts) == len(set(texts)) == many_files.select(F.coalesce("text", F.lit(""))).distinct().count()
        split(2)
        a = {r.rid: (r.doc_id, r.copies) for r in mix(many_files, block=16).collect()}
        split(12)
        assert a == {r.rid: (r.doc_id, r.copies) for r in mix(many_files, block=16).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers(spark, many_files):
    numbered = common.with_row_id(many_files, "n")
    assert numbered.columns == [*many_files.columns, "n"] and numbered.select("n").distinct().count() == numbered.count() == many_files.count()
    copied = common.with_row_id(many_files, "n", most_files=3)
    assert copied.count() == copied.select("n").distinct().count() == many_files.count()
    assert common.with_row_id(spark.range(5), "n").select("n").distinct().count() == 5
    assert common.with_row_id(many_files.limit(0), "n").count() == 0


def test_tables_of_finished_stages_are_deleted(spark, tiny):
    place = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    out = corpus_pipeline.run(spark, tiny)
    names = {n.rsplit("-", 1)[0] for n in set(os.listdir(place)) - before}
    assert names == {"mixing", "pieces"}
    assert out.count() > 100 and np.all([r.length <= 1024 for r in out.collect()])


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_hot_keys_are_dealt(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    names = rows.groupBy("k").agg(F.count("*").alias("n"))
    a, b = (sorted(map(tuple, x.select("id", "k", "n").collect())) for x in (common.spread_join(rows, names, ["k"], "id", 3000), rows.join(names, "k")))
    assert a == b
