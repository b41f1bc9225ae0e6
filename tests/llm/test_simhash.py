"""SimHash near-dedup against all pairs in Python."""

import random
import re

import pytest
import xxhash

from inkspan.llm.queries import QUERIES
from inkspan.llm.simhash import components, near_links, simhash_dedup


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = len(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(n - 2)] if n >= 3 else [" ".join(words)] * (n > 0)
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    """Index of the component of each fingerprint, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_query(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    fps = [fingerprint(t) for _, t in docs]
    comp = reach(fps)
    want = {}
    for (d, _), f, c in zip(docs, fps, comp):
        want[d] = (f"{f:016x}", min(x for (x, _), y in zip(docs, comp) if y == c))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, tiny).collect()}
    assert got == want


def test_odd(odd):
    out = simhash_dedup(odd).collect()
    assert len(out) == odd.count()
    assert {r.doc_id: r.fingerprint for r in out if r.doc_id} == {r.doc_id: f"{fingerprint(r.text):016x}" for r in odd.collect() if r.doc_id}
    zero = {r.component_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {3}
    assert sum(r.kept for r in out if r.component_id == 3) == 1
    assert sum(r.kept for r in out) == len({r.component_id for r in out})


def test_empty(empty):
    assert simhash_dedup(empty).count() == 0
    assert simhash_dedup(empty, kinds=3).count() == 0


@pytest.mark.parametrize("block", [32768, 5])
def test_links_of_tight_clusters(spark, block):
    rand = random.Random(block)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        c = rand.getrandbits(64)
        for _ in range(40):
            x = c
            for _ in range(rand.randint(0, 5)):
                x ^= 1 << rand.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits=3, block=block)
    for r in edges.collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 64
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(x, x) for x in signed]
    want = reach(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (100, 101)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert all(root[i] == 0 for i in range(1, 61)) and root[101] == 100


def test_more_kinds_find_no_less(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one = simhash_dedup(docs, words=5).where("kept").count()
    four = simhash_dedup(docs, words=5, kinds=4).where("kept").count()
    assert four <= one
