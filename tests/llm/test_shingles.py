"""Links by similar shingle sets against all pairs in Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm.shingles import set_forest, shingle_links, thinned
from inkspan.llm.simhash import components, shingle_hashes, simhash_dedup


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {frozenset(i for i in range(n) if find(i) == r) for r in map(find, range(n))}


def similar(texts, s=0.8):
    sets = [set(shingle_hashes(t, 5, 42).tolist()) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= s * len(sets[i] | sets[j]) - 1e-9]


def corpus(seed):
    """Groups of copies with a share of their words replaced, texts that share half of theirs, short and empty ones."""
    rand = random.Random(seed)
    word = lambda: f"w{rand.randrange(5000)}"
    texts = ["", None, " \n", "one", "ONE", "a b c d", "a b c d e f", "a b c d e f"]
    for size in (60, 150, 400, 3000):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base[: size // 2] + [word() for _ in range(size // 2)]))
            for _ in range(12):
                copy = list(base)
                for _ in range(rand.randint(0, max(1, size // 40))):
                    copy[rand.randrange(size)] = word()
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [2048, 3])
def test_links(spark, tmp_path, block):
    texts = corpus(block)
    spark.createDataFrame(list(enumerate(texts)), "rid long, text string").write.parquet(str(tmp_path / "t"))
    edges = shingle_links(spark.read.parquet(str(tmp_path / "t")), shingle_hashes, block=block, keep=1 << 20)
    want = similar(texts)
    root = {r.node: r.root for r in components(edges).collect()}
    got = classes(len(texts), [(i, root[i]) for i in root])
    true = classes(len(texts), want)
    # no link that isn't there; at most one pair in a hundred at the edge of 0.8 never meets
    assert all(any(g <= t for t in true) for g in got)
    assert len(got) <= len(true) * 1.02


def test_forest_of_two_sides():
    sets = [np.arange(10, dtype=np.uint32) + (i % 3 == 2) * 50 for i in range(30)]
    side = np.arange(30) % 2
    found = set_forest(sets, np.zeros(30, int), side, 0.8)
    assert all(side[a] != side[b] for a, b in found)
    assert {frozenset(c) for c in classes(30, found)} == {frozenset(range(2, 30, 3)), frozenset(i for i in range(30) if i % 3 != 2)}


def test_long_sets_are_compared_at_the_higher_level():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for cut, want in ((300, True), (3000, False)):
        pair = [thinned(base, 2048), thinned(base[cut:], 2048)]
        found = set_forest([s for _, s in pair], np.array([l for l, _ in pair]), None, 0.8)
        assert bool(found) is want


@pytest.mark.parametrize("weight", [1 << 20, 15_000])
def test_long_texts_are_compared_whole(spark, tmp_path, weight):
    rand = random.Random(5)
    texts = []
    for i in range(24):  # pairs at 0.7988 and 0.8011 by turns
        base = [f"p{i}w{k}" for k in range(8882 + i % 2 * 14)]
        texts += [" ".join(base + [f"{side}{rand.random()}" for _ in range(10_000 - len(base))]) for side in "xy"]
    pairs = similar(texts)
    assert len(pairs) == 12
    spark.createDataFrame(list(enumerate(texts)), "rid long, text string").write.parquet(str(tmp_path / "t"))
    # so many short keys that all pairs meet, and only the comparison decides
    edges = shingle_links(spark.read.parquet(str(tmp_path / "t")), shingle_hashes, bands=64, places=2, weight=weight)
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in edges.collect()} == set(pairs)


def test_a_hot_group_of_unlike_rows_loses_no_link(spark, tmp_path):
    """All rows share one key; the first row is like few of them, and links cross all blocks."""
    rand = random.Random(9)
    texts = []
    for i in range(60):
        base = [f"g{i}w{rand.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:]])][: 1 + i % 3]
    order = list(range(len(texts)))
    rand.shuffle(order)
    texts = [texts[i] for i in order]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    groups = rows.select("rid", F.lit(1).cast("long").alias("key"))
    for block in (4, 16, 1000):
        edges = shingle_links(spark.read.parquet(str(tmp_path / "t")), shingle_hashes, bands=1, places=64, block=block, groups=groups)
        root = {r.node: r.root for r in components(edges).collect()}
        assert {frozenset(c) for c in classes(len(texts), [(i, root[i]) for i in root])} == {frozenset(c) for c in classes(len(texts), similar(texts))}


def test_near_copies_of_the_tables_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = list(texts)
    of = {r.doc_id: r.component_id for r in simhash_dedup(docs, words=5, similarity=0.8).collect()}
    pairs = similar([texts[i] for i in ids])
    assert sum(of[ids[a]] == of[ids[b]] for a, b in pairs) >= 0.99 * len(pairs)


def test_odd(odd, empty):
    out = simhash_dedup(odd, words=5, similarity=0.8).collect()
    assert len(out) == odd.count() and sum(r.kept for r in out) == len({r.component_id for r in out})
    by = {r.doc_id: r.component_id for r in out}
    assert by[6] == by[7] == by[8] and by[3] == by[4] == by[5] and by[9] != by[10]
    assert simhash_dedup(empty, words=5, similarity=0.8).count() == 0


def test_fingerprints_alone_link_nothing(spark, tmp_path):
    rand = random.Random(8)
    line = "all rights reserved by the owners of this work and others"
    texts = []
    for i in range(12):  # one line outvotes all else in the fingerprint
        texts.append("\n".join([" ".join(f"d{i}w{rand.randrange(10**6)}" for _ in range(150))] + [line] * 150))
    texts += [texts[0] + " end", None, "", " \t", "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert len({r.component_id for r in simhash_dedup(docs, words=5).collect()}) < 8
    for kinds in (1, 2):
        of = {r.doc_id: r.component_id for r in simhash_dedup(docs, words=5, kinds=kinds, similarity=0.8).collect()}
        assert of == {**{i: i for i in range(12)}, 12: 0, 13: 13, 14: 13, 15: 13, 16: 16}
