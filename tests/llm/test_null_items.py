"""Benchmark rows without an id leak as much as others."""

import pytest

from staveforge.llm import decontaminate as D


@pytest.mark.parametrize("limit", (200_000, 8))
def test_items_with_null_ids_count_as_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "AUTOMATON_WORDS", limit)
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (None, "lone word"), ("b", b), ("b", c), (None, b), ("n", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {a} after"), (2, f"x {b} y"), (3, "a lone word here"), (4, "clean"), (5, f"{a} {c}")], "doc_id long, text string")
    got = {r.doc_id: (r.leak.n_hit, r.leak["items"], len(r.leak.spans)) for r in D.find_leaks(docs, bench, out="leak").collect()}
    assert got == {1: (12, [], 1), 2: (12, ["b"], 1), 3: (2, [], 1), 4: (0, [], 0), 5: (24, ["b"], got[5][2])}
    clean = {r.doc_id: r.text for r in D.decontaminate(docs, bench, max_coverage=0.9).collect()}
    assert clean.keys() == {1, 2, 3, 4} and a not in clean[1] and "lone word" not in clean[3]
