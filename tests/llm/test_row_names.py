"""Rows without an id, or that repeat one, are cut by their own text."""

import random

import pytest

from factgraph.llm import byte_dedup, substring_dedup


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


A, B, C, D, SHARED = _words(1, 90), _words(2, 90), _words(3, 90), _words(4, 90), _words(5, 70)


def _kept(spark, run, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = run(docs).collect()
    return sorted(((r[0], r["n_removed"]) for r in found), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("run,size", [(byte_dedup.remove_repeated_bytes, len), (substring_dedup.remove_repeated_passages, lambda t: len(t.split()))])
@pytest.mark.parametrize("hot", [False, True])
def test_rows_are_cut_by_their_own_text(spark, monkeypatch, run, size, hot):
    from factgraph.llm import repeats

    if hot:
        monkeypatch.setattr(repeats, "HOT_CONTENTS", 1)
    # only the one row without an id that copies A loses text
    assert _kept(spark, run, [(1, A), (None, A), (None, B), (None, C), (None, None)]) == [(1, 0), (None, 0), (None, 0), (None, 0), (None, size(A))]
    # a repeated id with another text
    assert _kept(spark, run, [(1, A), (2, A), (2, B)]) == [(1, 0), (2, 0), (2, size(A))]
    # the same row twice: one document, of which no copy goes
    assert _kept(spark, run, [(1, A), (1, A), (2, B)]) == [(1, 0), (1, 0), (2, 0)]
    # a passage that rows without an id share stays in one of them
    lost = [n for _, n in _kept(spark, run, [(None, f"{C} {SHARED}"), (None, f"{SHARED} {D}"), (2**63 - 1, B)])]
    assert lost[0] == 0 and lost[1] == 0 and size(SHARED) <= lost[2] <= size(SHARED) + 2
