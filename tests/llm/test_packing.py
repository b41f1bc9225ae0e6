"""Best-fit packing: an exact round trip, and the number of sequences against its bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkspan.llm.packing import pack, places, plan
from inkspan.llm.queries import QUERIES
from inkspan.llm.tokens import encoder


def check(docs, out, size=1024):
    exact = encoder().exact
    want = sorted(tuple(exact.encode(r.text or "", add_special_tokens=False).ids) + (2,) for r in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.rid].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(docs)
    assert sorted(sum(p.length for p in ps) for ps in by_doc.values()) == sorted(map(len, want))
    for ps in by_doc.values():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps[:-1]]).tolist()
        assert all(p.length == size for p in ps[1:])
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps[:-1]]).tolist()
        assert sum(p.length for p in ps) <= size
    for r in docs:
        ids = np.array(exact.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        if r.doc_id is not None and len(ids) <= size:
            assert zlib.crc32(ids.tobytes()) in {p.ids_crc32 for p in out if p.doc_id == r.doc_id}
    return len(by_seq)


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    out = pack(table).collect()
    n = check(docs, out)
    assert n <= -(-sum(r.length for r in out) // 1024) * 1.05 + 2
    assert {f.name for f in QUERIES["op7_best_fit_packing"](spark, tiny).schema} == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_odd(odd):
    out = pack(odd).collect()
    check(odd.collect(), out)
    assert {(r.length, r.piece) for r in out if r.doc_id in (3, 4)} == {(1, 0)}


def test_empty(empty):
    assert pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rand = random.Random(seed)
    size = rand.choice([16, 64, 1024])
    counts = {x: rand.randint(1, 50) for x in rand.sample(range(1, size + 1), min(size, rand.randint(1, 300)))}
    found = plan(counts, size)
    used = defaultdict(int)
    for lengths, n in found:
        assert n > 0 and sum(lengths) <= size
        for x in lengths:
            used[x] += n
    assert used == counts
    key = places(found)["key"]
    assert (np.diff(key) > 0).all()


def test_plan_takes_exact_complements():
    assert sum(n for _, n in plan({1000: 3, 24: 3}, 1024)) == 3
    assert sum(n for _, n in plan({1000: 2, 20: 2, 4: 2}, 1024)) == 2
    assert sum(n for _, n in plan({1000: 1, 12: 1, 8: 1, 4: 1}, 1024)) == 1
    assert sum(n for _, n in plan({512: 4, 256: 4}, 1024)) == 3


def test_fast_ids_are_the_exact_ones(spark, tiny):
    e = encoder()
    texts = [r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    texts += ["  a  b\n\n c\t", " x y", "á̀", "<|endoftext|>x", "'S 're don't", "\U0001f600\U0001f601 中文", "x" * 30_000]
    for t in texts:
        assert e.ids(t).tolist() == e.exact.encode(t, add_special_tokens=False).ids


def test_the_second_encoder_is_only_made_for_texts_that_need_it():
    e = encoder.__wrapped__()
    assert len(e.ids("plain words " * 100)) > 0 and "exact" not in vars(e)
    assert e.ids("x <|endoftext|> y").tolist() == encoder().exact.encode("x <|endoftext|> y", add_special_tokens=False).ids and "exact" in vars(e)
