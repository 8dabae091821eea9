"""License scan, importance resampling and filter audit against brute force, and on odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import filter_audit, importance, licenses

from .test_text_operators import corpus, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(FOLD))


# --- licenses ----------------------------------------------------------------------------------


def plain_licenses(text):
    words = words_of(text)
    base = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    hits = []
    for i, word in enumerate(words):
        ahead = " ".join(words[i : i + licenses.SPAN])
        for rule, (priority, label, keyword, pattern) in enumerate(licenses.RULES):
            m = re.match(f"(?:{pattern})(?= |$)", ahead) if keyword == word else None
            if m:
                hits.append((i, i + len(m.group().split(" ")), priority, rule, label))
    inside = lambda o, h: o[0] <= h[0] and o[1] >= h[1]
    better = lambda o, h: o[2] < h[2] or (o[2] == h[2] and (o[1] - o[0] > h[1] - h[0] or (o[:2] == h[:2] and o[3] < h[3])))
    kept = [h for h in hits if not any(inside(o, h) and better(o, h) for o in hits)]
    score = max([licenses.WORTH[h[2] - 1] for h in kept] + [licenses.BASE_WORTH] * bool(base) + [0.0])
    starts = [i for i, _ in base]
    joined = lambda found: ",".join(sorted(set(found)))
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), joined(x for _, x in base), joined([x for _, x in base] + [h[4] for h in kept]), score, len(kept))


NOTICES = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "// spdx-license-identifier: MIT", "GNU Lesser General Public License v2.1 or any later version", "the MIT LICENSE mit license Mit\nLicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Copyright (c) 2020 Ann Lee. All rights reserved.", "BSD 3-Clause License", "It is in no license at all; commit licenses",
    "https://creativecommons.org/licenses/by-sa/4.0/", "general public license general public license", "cc\t\tby KIT License", "Dedicated to the public domain", "mit license" * 3,
]


def test_op11(spark):
    rng = random.Random(3)
    docs = corpus() + [(500 + i, t) for i, t in enumerate(NOTICES)]
    docs += [(600 + i, " ".join(rng.choice(NOTICES + ["prose of words", "License", "GNU", "general"]) for _ in range(40))) for i in range(6)]
    docs += [(700, "licensed under the " * 400 + "mit license " * 500), (701, None), (701, "MIT License"), (None, "MIT License"), (None, "MIT License")]
    got = {}
    for r in licenses.license_query(frame(spark, docs)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(plain_licenses(text))
    order = lambda rows: sorted(rows, key=repr)
    assert {i: order(x) for i, x in got.items()} == {i: order(x) for i, x in want.items()}
    labels = [got[500 + i][0][5] for i in range(len(NOTICES))]
    assert labels[:7] == ["gpl,gpl-3.0", "apache,apache-2.0", "cc-by-nc", "mit", "gpl-2.0-or-later", "mit", "gpl,lgpl-2.1"]
    assert got[511][0][5] == "" and got[507][0][1] == 3
    assert licenses.license_query(frame(spark, []).limit(0)).count() == 0


def test_op11_every_rule_has_a_gate_and_its_keyword():
    assert len(licenses.RULES) > 300 and len(set(licenses.RULES)) == len(licenses.RULES)

    def gated(pattern):
        """Whether all texts of the pattern have a gate: what is optional doesn't count, and of alternatives each must."""
        while True:
            shorter = re.sub(r"\(\?:[^()]*\)\?", "", pattern)
            if shorter == pattern:
                break
            pattern = shorter
        m = re.search(r"\(\?:([^()]*)\)", pattern)
        if m:
            return gated(pattern[: m.start()] + pattern[m.end() :]) or all(gated(x) for x in m.group(1).split("|"))
        return any(g in pattern for g in licenses.GATES) or "cc by" in pattern

    assert [p for _, _, _, p in licenses.RULES if not gated(p)] == []
    assert all(re.match(k + "(?![a-z0-9])", p) for _, _, k, p in licenses.RULES)


# --- importance --------------------------------------------------------------------------------


@pytest.mark.parametrize("max_run,head", [(1, 4096), (3, 4096), (2, 3)])
def test_op12(spark, monkeypatch, max_run, head):
    monkeypatch.setattr(importance, "HEAD_WORDS", head)
    monkeypatch.setattr(importance.head_of, "__defaults__", (head, head))
    docs = [d for d in corpus(4, 90)] + [(800, "Ünïcode ß " * 30), (801, "x" * 100 + " " + "yz" * 20 + " word " * 30), (None, "alpha beta " * 30)]
    target = ["alpha1 beta2 gamma3 delta4 and ünïcode words", None, "", "yz" * 20, "alpha beta " * 5]
    want = importance.brute_force(docs, target, max_run=max_run)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(frame(spark, docs), bench, max_run=max_run)
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()} == want
    if max_run == 1:
        assert importance.importance_query(frame(spark, docs), bench).columns == ["doc_id", "n_features", "weight", "score", "rank"]
        carried = importance.resample(frame(spark, docs), bench, carry=["doc_id", "text"]).where("rank is not null").select("carried.*")
        assert {tuple(r) for r in carried.collect()} == {(i, t) for i, t in docs if want[i][3] is not None}


def test_op12_ties_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    same = frame(spark, [(7, "alpha beta " * 20)] * 45 + [(None, "alpha beta " * 20)] * 30 + [(3, None), (4, "few words")])
    got = importance.importance_query(same, bench).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 8)) and len(got) == 77
    best = max(r["score"] for r in got if r["n_features"] >= 20)
    assert all(r["score"] == best for r in got if r["rank"])
    assert importance.importance_query(same.limit(0), bench).count() == 0
    empty = importance.importance_query(same, bench.limit(0)).collect()
    assert len(empty) == 77 and sum(r["rank"] is not None for r in empty) == 7


def test_op12_crc_and_head():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé0") for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["q" * 5000]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = importance.Words.of(raw, np.array([0, len(raw)]))
    zero = np.zeros(len(found.starts), np.uint32)
    assert importance.extend_crc(zero, found.raw, found.starts, found.ends).tolist() == [zlib.crc32(w.encode()) for w in words]
    head = importance.Head([w.encode() for w in words[:50]])
    assert [bool(n >= 0) for n in head.find(found)] == [w in words[:50] and len(w.encode()) <= importance.HEAD_BYTES for w in words]


# --- filter audit ------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, source)."""
    first = {}
    for i, text, _ in docs:
        key = i if i is not None else 2**63 - 1
        first[text or ""] = min(first.get(text or "", key), key)
    rows = []
    for i, text, source in docs:
        t, words = text or "", re.findall("[^\\x20\\x09-\\x0D]+", text or "")
        fails = "".join(
            letter for letter, bad in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
                (i if i is not None else 2**63 - 1) > first[t],
            )) if bad
        )
        rows.append((source or "", fails, *labels.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = lambda r, k: any(x in r[1] for x in order[:k])  # noqa: E731, B023
            for step, letter in enumerate(order, 1):
                removed = [r for r in here if letter in r[1] and not gone(r, step - 1)]
                out[part, order, step] = [sum(not gone(r, step) for r in here), len(removed), sum(letter in r[1] and gone(r, step - 1) for r in here), sum(r[1] == letter for r in here), sum(r[2] == 1 for r in removed), sum(r[3] == 1 for r in removed)]
    shapley = {}
    for (part, order, step), m in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + m[1]
    return {k: (*m, shapley[k[0], k[1][k[2] - 1]]) for k, m in out.items()}


def test_op13(spark):
    rng = random.Random(8)
    texts = [t for _, t in corpus(5, 50)] + ["Word " * 250, " ".join(f"w{i}" for i in range(260)), "A B C # " * 80, None, "", " ".join(f"w{i}" for i in range(260))]
    docs = [(i if i % 11 else None, t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)] + [(3, "again", "a"), (3, "again", "b"), (2, "again", "a"), (90, "x " * 300, "hot")]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 60, 2)}
    rows = [(i, t, None, s, 0, 1, "k", 1.0) for i, t, s in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mask long, n long, part string, kept double")
    told = spark.createDataFrame([(i, q, x) for i, (q, x) in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.filter_audit(table, told).collect()}
    assert got == plain_audit(docs, labels) and len(got) == 600 * 4
    assert filter_audit.filter_audit(table.limit(0), told).count() == 0
    assert filter_audit.filter_audit(table, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_suffixes_are_sorted_by_several_units_at_once():
    """The index's first sort takes several units, where separators in order of place end a suffix; runs are found by counts of bits."""
    import numpy as np

    from factgraph.llm.suffix_index import RunLengthIndex, sort_suffixes

    rng = np.random.default_rng(5)
    for _ in range(300):
        parts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 30)) for _ in range(rng.integers(1, 6))]
        units = [int(u) for k, p in enumerate(parts) for u in [*(p + len(parts)), k]]
        want = sorted(range(len(units)), key=lambda i: units[i:])
        assert sort_suffixes(np.array(units), len(parts)).tolist() == sort_suffixes(np.array(units)).tolist() == want
        index = RunLengthIndex(parts, 3)
        rows = np.arange(index.n)
        assert index.runs(rows).tolist() == (np.searchsorted(index.first, rows, "right") - 1).tolist()


def test_index_of_bytes_is_made_and_streamed_without_searches(monkeypatch):
    """Each step searched all sizes, all windows were searched among intervals, and bytes were sorted to be numbered."""
    import numpy as np

    from factgraph.llm import suffix_index

    rng = np.random.default_rng(5)
    for most in (3, 1 << 40):
        values = rng.integers(0, most, 500)
        known, ranks = np.unique(values, return_inverse=True)
        found, n = suffix_index.coded(values)
        assert n == len(known) and (found == ranks).all()
    parts = [rng.integers(97, 100, n) for n in (40, 3, 0, 25)] + [np.full(30, 97)]
    windows = [tuple(p[i : i + 4]) for p in parts for i in range(len(p) - 3)]
    asked = []
    for name in ("searchsorted", "unique"):
        monkeypatch.setattr(np, name, lambda *a, _name=name, _f=getattr(np, name), **b: asked.append(_name) or _f(*a, **b))
    classes = np.concatenate(suffix_index.RunLengthIndex(parts, 4).stream()).tolist()
    assert not asked
    assert len(classes) == len(windows) and len(set(zip(classes, windows))) == len(set(classes)) == len(set(windows))
