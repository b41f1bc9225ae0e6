"""The cube method: totals kept, targets met, reruns equal."""

import random
import re

import pytest

from inkspan.llm.mixing import MOST, SHARE, WEIGHTS, flight, land, mix, source_targets
from inkspan.llm.queries import QUERIES


def targets(sizes, weights=WEIGHTS, share=SHARE, most=MOST):
    """The rule, plainly: share by weight, bound, reshare what is over among the rest."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 0, "b": 0}, {}, {None: 5}, {f"s{i}": i * i for i in range(300)}, {"\ue000": 9, "\U0001f600": 900, "z": 10, "é": 4, "": 3}, {"a": 1, "b": 10, "c": 100, "d": 1000}])
def test_targets_of_many_sources(spark, sizes):
    stats = spark.createDataFrame([(s, w, 1) for s, w in sizes.items()], "source string, words long, n long")
    got = {r.source: r.target for r in source_targets(stats).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert targets({}) == {}
    assert targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    sizes = {f"s{i}": i * i for i in range(30)}
    out = targets(sizes)
    assert all(out[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(out.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_flight_keeps_totals_and_expectations():
    rand = random.Random(1)
    sizes = [float(rand.choice([0, 1, 5, 5, 80, 1000])) for _ in range(300)]
    hits = [0] * len(sizes)
    for seed in range(300):
        p = [0.3] * len(sizes)
        open_ = flight(p, sizes, random.Random(seed))
        assert len(open_) <= 2
        assert sum(p) == pytest.approx(90, abs=1e-5)
        assert sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.3 * sum(sizes), rel=1e-6)
        land(p, sizes, open_)
        assert set(p) <= {0.0, 1.0}
        hits = [h + x for h, x in zip(hits, p)]
    assert 0.15 < min(hits) / 300 and max(hits) / 300 < 0.45


@pytest.mark.parametrize("block", [2048, 16])
def test_query(spark, tiny, block):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = mix(docs, block=block).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    want = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    goal = targets(want)
    assert len(out) == len(size)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == want[r.source] and r.target == goal[r.source]
        assert 0 <= r.taken <= 2 * r.size
    for s, g in goal.items():
        taken = sum(r.taken for r in out if r.source == s)
        assert abs(taken - g) <= max((r.size for r in out if r.source == s), default=0)
    again = mix(docs, block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(QUERIES["op1_cube_mixing"](spark, tiny).columns)


def test_odd(odd):
    out = mix(odd).collect()
    assert len(out) == odd.count()
    assert all(r.taken <= 2 * r.size for r in out)
    assert {r.size for r in out if r.doc_id in (3, 4, 5)} == {0}


def test_empty(empty):
    assert mix(empty).count() == 0
