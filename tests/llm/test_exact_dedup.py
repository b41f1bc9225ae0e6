"""Exact dedup against grouping in Python."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from inkspan.llm.exact_dedup import exact_dedup
from inkspan.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[1] or ""].append(r[0])
    return sorted(
        (repr(r[0]), repr(max(ids, key=lambda x: -1 if x is None else x)), len(ids), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for r in rows
        for ids in [groups[r[1] or ""]]
    )


@pytest.mark.parametrize("block,salts", [(4096, 256), (7, 2), (100_000_000, 1)])
def test_odd_rows(odd, block, salts):
    if block == 7:
        odd = odd.where("length(text) < 1000 or text is null")
    out = exact_dedup(odd, block_bytes=block, salts=salts).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r[1] or "" for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("salts", [1, 3, 40])
def test_frequent_blocks(spark, tmp_path, monkeypatch, salts, most):
    """Frequent and rare blocks beside each other in one text, frequent ones known to all tasks or joined."""
    from inkspan.llm import exact_dedup as module

    monkeypatch.setattr(module, "MOST_OFTEN", most)
    rows = [(i, "same" * (i % 4) + (f"own{i // 7:05d}" if i % 3 else "")) for i in range(120)] + [(None, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    out = exact_dedup(spark.read.parquet(str(tmp_path / "t")), block_bytes=4, salts=salts).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute(rows)
    assert sum(r.kept for r in out) == len({r[1] or "" for r in rows})


def test_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_oracle(spark, tiny):
    name = "op10_exact_dedup"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL[name]).fetchall())
    got = QUERIES[name](spark, tiny)
    assert sorted(tuple(r) for r in got.collect()) == want
