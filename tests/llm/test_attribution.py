"""Token attribution against the tokenizer's own offsets."""

from collections import defaultdict

import numpy as np

from inkspan.llm.attribution import attribute, lines, token_counts
from inkspan.llm.queries import QUERIES
from inkspan.llm.tokens import encoder


def brute(text):
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    counts = [0] * len(ends)
    for a, z in encoder().exact.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(z, e) - max(a, s)) for s, e in zip([0, *ends], ends)]
        counts[share.index(max(share))] += 1
    return list(zip([0, *ends], ends, counts))


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["op6_token_counts"](spark, tiny).collect():
        got[r.doc_id].append((r.section, r.start, r.end, r.n_tokens, r.doc_tokens))
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        rows = sorted(got[d])
        assert [(a, z, n) for _, a, z, n, _ in rows] == brute(text or "")
        assert {t for *_, t in rows} == {sum(n for *_, n, _ in rows)}


def test_characters_of_several_tokens():
    for text in ("\U0001f600\n\n\n中文 \U0001f468‍\U0001f469\n", "a\n\n\n\nb", "\n", "", "é\n", "x \n  y", "<|endoftext|>\n<|endoftext|>"):
        n, _ = attribute(*encoder().offsets(text), lines(text))
        assert list(n) == [x for *_, x in brute(text)], text


def test_ties_go_to_the_first():
    n, crossing = attribute(np.array([0]), np.array([4]), np.array([2, 4]))
    assert list(n) == [1, 0] and list(crossing) == [1, 0]
    assert list(attribute(np.array([0]), np.array([5]), np.array([1, 4, 5]))[0]) == [0, 1, 0]


def test_odd(odd, empty):
    out = token_counts(odd).collect()
    assert len({(r.doc_id, r.section) for r in out if r.doc_id == 6}) == 1
    assert {(r.n_tokens, r.start, r.end) for r in out if r.doc_id in (3, 4)} == {(0, 0, 0)}
    assert token_counts(empty).count() == 0
