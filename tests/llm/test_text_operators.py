"""Corpus operators against brute force, and their defined results on odd input."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import byte_dedup, decontamination, language_id, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, suffix_index, token_output

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, key string, weight double"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, a long text and odd spaces."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(70))
    line_block = "\n".join(" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(12))
    texts = []
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(rng.choice([2, 9, 40, 150]))]
        text = ""
        for j, w in enumerate(words):
            text += w + rng.choice([" ", " ", " ", "\n", "\t", "  "])
        if i % 4 == 1:
            text += passage + rng.choice(["", " x", ". End"])
        if i % 5 == 2:
            text += "\n" + line_block
        if i % 6 == 3 and texts:
            text = rng.choice(texts)
        if i % 6 == 4 and texts:
            near = rng.choice(texts).split(" ")
            near[len(near) // 2 :][:1] = ["changed"]
            text = " ".join(near)
        texts.append(text)
    texts += ["b " * 900 + "q c " * 40, "c " + "b " * 400 + "end", "b " * 60 + "q c " * 30]
    texts += [None, "", "  \n\t ", "one", "two words", "É é İ ß x", passage * 3, "a " * 3000, "z" * 5000]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, docs):
    rows = [(i, t, random.Random(i).choice(["en", "fr", None]), f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 7, "k", 0.5) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


@pytest.fixture(scope="module")
def docs():
    return corpus()


def odd(spark):
    """Repeated rows, a repeated id with another text, and a null id."""
    return frame(spark, [(1, "a b c " * 40), (1, "a b c " * 40), (2, "other text"), (2, "second text of the id"), (None, "a b c " * 40), (3, None)])


def test_op1(spark, docs):
    special = [(900, "mail ann.lee@example.com, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111 or +1 (555) 555-0100."), (902, "@" * 3000 + "+" * 300 + "1" * 4000)]
    got = rows_of(pii.pii_query(frame(spark, docs + special)))
    assert [r[:6] for r in got] == [(i, *pii.brute_force(t)) for i, t in docs + special]
    assert {r[0]: r[6] for r in got}[900] == "email:5:24,ip:29:37,card:58:77,phone:81:98"
    assert pii.pii_query(frame(spark, docs).limit(0)).count() == 0
    got = pii.pii_query(odd(spark)).collect()
    assert len(got) == 6 and all(r[1:5] == (0, 0, 0, 0) and r["spans"] == "" for r in got)


def test_op1_adds_loose_forms_that_stand_in_a_corpus():
    """Trained on a corpus of strict forms, the trees find loose ones and secrets, and leave clean text alone."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    strict = lambda: rng.choice([f"{rng.choice(WORDS)}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), "4111 1111 1111 1111", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f'token = "{rng.getrandbits(160):040x}"'])
    texts = [f"{prose(20)} {strict()} {prose(20)}" for _ in range(900)]
    model = pii.train(texts)
    for kind, r in model.report.items():
        assert r["positives"] > 50 and r["recall"] > 0.8 and r["precision"] >= pii.PRECISION, (kind, r)
    planted = {"email": "joe.34 at mail3 dot example dot com", "card": "4111/1111/1111/1111", "phone": "(555) 555-0199", "secret": "token = " + "0a1b2c3d4e" * 4, "ip": "10[.]20[.]30[.]40"}
    for kind, s in planted.items():
        text = f"{prose(8)} {s} {prose(8)}"
        a = text.index(s.removeprefix("token = "))
        found = pii.find([text], model)[0]
        assert found[0] == [] and (kind, a, a + len(s.removeprefix("token = "))) in found[1], (kind, found)
    clean = [f"{prose(12)} {x} {prose(12)}" for x in ("2020-01-02", "version 1.2.3", "12,345.67", "pages 120-145", "isbn 978-3-16", "src/main/java/app2", "meet at noon. Then")]
    assert all(spans == [] for _, spans in pii.find(clean, model))
    # base spans and candidates of a text of five million characters, many of each, in the time of its length
    import time

    began = time.time()
    long = " ".join(f"a{i}@x.org 1.2.3.{i % 250} {i % 900 + 100}-555-0100 {prose(4)}" for i in range(70_000))
    base, spans = pii.find([long], model)[0]
    assert len(base) >= 140_000 and len(spans) >= len(base) and time.time() - began < 90


def test_op1_base_rules_match_the_plain_patterns():
    rng = random.Random(4)
    for _ in range(20000):
        text = "".join(rng.choice("ab1.@-+ ()22334.1é") for _ in range(rng.randint(1, 40)))
        spans = pii.base_spans(text)
        import hashlib

        n = [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()) == pii.brute_force(text), text


def plain_quality(text):
    import re

    w = re.findall("[^ \t-\r]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_op2(spark, docs):
    got = rows_of(quality.quality_query(frame(spark, docs)))
    assert [r[:7] for r in got] == [(i, *plain_quality(t)) for i, t in docs]
    assert all(not r[7] for r in got if r[6])


def test_op2_verdict_is_the_same_in_any_order_and_by_the_exact_way(spark, docs, monkeypatch):
    names = [r.name for r in quality.default_rules()]
    df = frame(spark, docs)
    kept = [rows_of(quality.quality(df, order=o).select("doc_id", "n_repeat_words", "kept")) for o in (names, names[::-1])]
    assert kept[0] == kept[1]
    monkeypatch.setattr(quality, "PACKED_BITS", 2)
    assert rows_of(quality.quality(df, order=names).select("doc_id", "n_repeat_words", "kept")) == kept[0]
    plan = quality.plan_cascade(df)
    shown = lambda plan: [(p["rule"].name, p["work"], p["rejected"], p["rows"]) for p in plan]
    assert {p["rule"].name for p in plan} == set(names) and shown(plan) == shown(quality.plan_cascade(df.repartition(7)))
    assert quality.quality_query(df.limit(0)).count() == 0
    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality.quality_query(odd(spark)).collect()}
    assert got == {(1, 120, 120, True, False), (2, 2, 0, True, False), (2, 5, 0, True, False), (None, 120, 120, True, False), (3, 0, 0, True, False)}


def test_op2_rules_are_ordered_by_rejections_of_the_rows_left_for_their_work(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(30)]
    below = lambda k: lambda: F.regexp_extract("text", "w([0-9]+)x", 1).cast("int") < k
    rules = [quality.Rule(name, below(k), lambda w=w: F.lit(w)) for name, k, w in (("dear", 20, 100), ("cheap", 10, 10), ("same", 9, 10), ("none", 0, 1))]
    plan = quality.plan_cascade(frame(spark, rows), rules)
    assert [p["rule"].name for p in plan] == ["cheap", "none", "dear", "same"] and [p["rejected"] for p in plan] == [10, 0, 10, 0]


def test_op2_very_long_texts(spark):
    """Two million words, most of them repeated, take the time of a sort."""
    words = [f"a{i % 700_000}" for i in range(2_000_000)]
    text = " ".join(words)
    order = [r.name for r in quality.default_rules()]
    row = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), order=order).drop("text").first()
    assert row[:6] == (1, 2_000_000, sum(map(len, words)), 0, 0, 2_000_000) and row["base_failed"]


def test_op3(spark, docs):
    assert rows_of(byte_dedup.byte_dedup_query(frame(spark, docs))) == byte_dedup.brute_force(docs)
    got = rows_of(byte_dedup.byte_dedup_query(odd(spark)))
    assert len(got) == 6 and got[0] == got[1] and got[-1][0] is None
    assert byte_dedup.byte_dedup_query(frame(spark, docs).limit(0)).count() == 0


def test_op5(spark, docs):
    assert rows_of(substring_dedup.substring_dedup_query(frame(spark, docs))) == substring_dedup.brute_force(docs)
    assert [r[:3] for r in rows_of(substring_dedup.substring_dedup_query(odd(spark)))] == [(1, 120, 0), (1, 120, 0), (2, 2, 0), (2, 5, 0), (3, 0, 0), (None, 120, 120)]
    assert substring_dedup.substring_dedup_query(frame(spark, docs).limit(0)).count() == 0


def test_hot_anchors_give_the_same(spark, docs, monkeypatch):
    from factgraph.llm import repeats

    monkeypatch.setattr(repeats, "HOT_CONTENTS", 1)
    assert rows_of(byte_dedup.byte_dedup_query(frame(spark, docs))) == byte_dedup.brute_force(docs)
    assert rows_of(substring_dedup.substring_dedup_query(frame(spark, docs))) == substring_dedup.brute_force(docs)


def _repetitive():
    """Whole copies, near copies, texts that repeat themselves, and passages at other places of other texts."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    base, passage, long = words(400), words(130), words(3000)
    near = [base[:k] + ["x"] + base[k + 1 :] for k in (5, 200, 390)]
    texts = [base, *near, base, base, words(60) + passage + words(70), passage, words(3) + passage + passage, words(7) * 90, ["aa"] * 2000, long, long[1000:2500], words(20) + long, words(30)]
    return [(100 - i, " ".join(t)) for i, t in enumerate(texts)] + [(200, None), (201, "")]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 20, "INDEX_UNITS": 600}, {"GATHER_ROWS": 50}, {"BLOCK": 20, "INDEX_UNITS": 600, "HOT_CONTENTS": 2}])
def test_repetitive_texts(spark, monkeypatch, sizes):
    """Copies meet in blocks, parts of blocks and over several flushes."""
    from factgraph.llm import repeats

    for name, value in sizes.items():
        monkeypatch.setattr(repeats, name, value)
    rows = sorted(_repetitive(), key=lambda r: r[0])
    for parts in (1, 5):
        df = frame(spark, rows).repartition(parts)
        assert rows_of(byte_dedup.byte_dedup_query(df)) == byte_dedup.brute_force(rows)
        assert rows_of(substring_dedup.substring_dedup_query(df)) == substring_dedup.brute_force(rows)


def test_without_the_index_nothing_goes(spark, docs, monkeypatch):
    """Every removal comes out of the index of a shard."""
    from factgraph.llm import repeats

    monkeypatch.setattr(repeats, "_index", lambda kind: lambda batches: iter(()))
    rows = sorted(_repetitive(), key=lambda r: r[0])
    assert byte_dedup.byte_dedup_query(frame(spark, rows)).where("n_removed > 0").isEmpty()
    assert substring_dedup.substring_dedup_query(frame(spark, rows)).where("n_removed > 0").isEmpty()


def test_links_of_many_documents_make_bounded_shards():
    """A block that a third of all documents have comes with each part of what is linked to it."""
    from factgraph.llm import repeats

    n, size = 4000, 700
    doc, lo = np.repeat(np.arange(1, n + 1), size // 35), np.tile(np.arange(0, size, 35), n)
    shard, d, a, b = repeats.streams(doc, lo, lo + 35, np.zeros(len(doc), np.int64), lo, 100, 5, repeats.BLOCK, repeats.INDEX_UNITS)
    held = {}
    for s, x, from_, to in zip(shard.tolist(), d.tolist(), a.tolist(), b.tolist()):
        held.setdefault(s, []).append((x, from_, to))
    assert all(sum(to - from_ + 100 for _, from_, to in rows) < 2 * repeats.INDEX_UNITS for rows in held.values())
    assert all(any(x == 0 for x, _, _ in rows) for rows in held.values())
    covered = {}
    for rows in held.values():
        for x, from_, to in rows:
            if x:
                covered.setdefault(x, set()).update(range(from_, to))
    assert len(covered) == n and all(len(c) == size for c in covered.values())


def test_small_pieces_give_the_same(monkeypatch):
    """Anchors of texts longer than a piece."""
    from factgraph.llm import repeats

    rng = np.random.default_rng(2)
    one, two = (rng.integers(1, 50, 5000).astype(np.uint64) for _ in range(2))
    whole = {(int(d), s, int(h)) for d, lo, hi, h1, h2 in repeats.anchors(one, two, np.array([0, 3000, 5000]), 20, 5) for d, a, b, h in zip(d, lo, hi, h1) for s in range(a, b)}
    monkeypatch.setattr(repeats, "PIECE", 512)
    parts = {(int(d), s, int(h)) for d, lo, hi, h1, h2 in repeats.anchors(one, two, np.array([0, 3000, 5000]), 20, 5) for d, a, b, h in zip(d, lo, hi, h1) for s in range(a, b)}
    assert whole == parts and len(whole) == 3000 - 19 + 2000 - 19


@pytest.mark.parametrize("index", [suffix_index.RunLengthIndex, suffix_index.WaveletIndex])
def test_indexes(index):
    rng = random.Random(1)
    for _ in range(60):
        width = rng.choice([3, 5, 8])
        contents = [np.array([rng.choice([0, 1, 2]) for _ in range(rng.randint(width, 30))]) for _ in range(rng.randint(1, 8))]
        built = index(contents, width)
        seen, back = {}, {}
        for c, classes in zip(contents, built.stream()):
            for i, k in enumerate(classes):
                window = tuple(c[i : i + width])
                assert seen.setdefault(window, k) == k and back.setdefault(k, window) == window
        if index is suffix_index.RunLengthIndex:
            assert sorted(built.locate(r) for r in range(built.n)) == list(range(built.n))


@pytest.mark.parametrize("index,part", [(suffix_index.RunLengthIndex, "target"), (suffix_index.RunLengthIndex, "match"), (suffix_index.WaveletIndex, "shift"), (suffix_index.WaveletIndex, "begin")])
def test_windows_come_from_the_index(index, part):
    """With a part of the index broken, intervals are no longer those of equal windows."""
    rng = random.Random(3)
    contents = [np.array([rng.choice([0, 1, 2]) for _ in range(40)]) for _ in range(6)]
    built, broken = index(contents, 5), index(contents, 5)
    values = getattr(broken, part)
    other = {"begin": np.delete(values, len(values) // 2), "shift": values[::-1].copy(), "match": np.roll(values, 1), "target": np.roll(values, 1)}
    setattr(broken, part, other[part])
    assert any((x != y).any() for x, y in zip(built.stream(), broken.stream()))


def test_op6_round_trip(spark, docs, tmp_path):
    path, out = token_output.tokenizer_path(), f"file://{tmp_path}/tokens"
    more = docs + [(500, "A<|endoftext|>B don't. It's, a§b • x"), (501, "ΑΣ. ΣΑΣ, İ. \x1cab\x1d c"), (502, "<|ENDOFTEXT|> x")]
    got = rows_of(token_output.token_output(frame(spark, more), path, out))
    import zlib

    tok, start, want = token_output.encoder(path).tokenizer, 0, []
    for i, t in more:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_output.read_document(spark, out, 500) == tok.encode(more[-3][1], add_special_tokens=False).ids + [1]
    assert token_output.read_document(spark, out, 12345) is None
    assert token_output.token_output(frame(spark, docs).limit(0), path).count() == 0
    got = [(r["doc_id"], r["n_tokens"]) for r in token_output.token_output(odd(spark), path).orderBy("start").collect()]
    sizes = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    assert got == [(None, sizes("a b c " * 40)), (1, sizes("a b c " * 40)), (1, sizes("a b c " * 40)), (2, sizes("other text")), (2, sizes("second text of the id")), (3, 1)]


def test_op7(spark, docs, monkeypatch):
    bench = [(1, " ".join(docs[1][1].split()[-30:-5])), (2, "alpha1 beta2"), (3, "One"), (4, None), (5, ""), (None, "two words"), (3, "one")]
    df = spark.createDataFrame(bench, "item_id long, text string")
    want = decontamination.brute_force(docs, bench)
    assert rows_of(decontamination.decontamination_query(frame(spark, docs), df)) == want
    assert any(r[5] for r in want)
    hits = lambda limit: sorted((r["doc_id"], tuple(r["hits"]), tuple(r["items"])) for r in decontamination.decontaminate(frame(spark, docs), df, limit=limit).collect())
    assert hits(8) == hits(200_000)  # several blocks of the benchmark
    monkeypatch.setattr(decontamination, "PIECE_WINDOWS", 3)
    assert hits(200_000) == hits(8)  # long items in pieces
    clean = decontamination.decontamination_query(frame(spark, docs), df.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(docs)
    rows = decontamination.decontamination_query(odd(spark), spark.createDataFrame([("x", "Second TEXT")], "item_id string, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["contaminated"]) for r in rows) == [(0, 120, 0, False), (1, 120, 0, False), (1, 120, 0, False), (2, 2, 0, False), (2, 5, 2, True), (3, 0, 0, False)]


def test_op8(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0 and got.where("rejected").count() <= 0.02 * got.count()
    odd_texts = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "fr"), (None, "the cat", "en")], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(df))
    rows = {r["doc_id"]: r for r in language_id.identify(odd_texts, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(rows[i]["rejected"] for i in (1, 2, 3))
    # calibrated rejection: junk of the same letters goes, whole texts of the corpus stay
    rng = random.Random(1)
    texts = [r["text"] for r in df.where("lang is not null and n_chars > 400").limit(60).collect()]
    junk = spark.createDataFrame([(i, "".join(rng.sample(t, len(t))), "") for i, t in enumerate(texts)] + [(1000 + i, t, "") for i, t in enumerate(texts)], odd_texts.schema)
    gone = {r["doc_id"] for r in language_id.identify(junk, model).where("rejected").collect()}
    assert len([i for i in gone if i < 1000]) >= 0.8 * len(texts) and not [i for i in gone if i >= 1000]
    assert rows[None]["lang_pred"] in model.languages and rows[None]["held_out"] is False
    assert {r["lang_pred"] for r in language_id.identify(odd_texts.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_lines(docs):
    """Chunks by the same boundaries, in plain Python."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen, out = {}, []
    for i, t in sorted(docs):
        lines = (t or "").split("\n")
        chunks, h = [[lines[0]]], [md5(x) for x in lines]
        for k in range(1, len(lines)):
            if md5(h[k - 1] + h[k])[0] in "0123":
                chunks.append([])
            chunks[-1].append(lines[k])
        kept = []
        for place, c in enumerate(chunks):
            text = "\n".join(c)
            if len(c) >= 2 and text.strip(" \t\n\x0b\x0c\r") and seen.setdefault(text, (i, place)) != (i, place):
                continue
            kept += c
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_op9(spark, docs):
    want = plain_lines(docs)
    assert rows_of(line_dedup.line_dedup_query(frame(spark, docs))) == want
    assert any(r[2] for r in want)
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup_query(odd(spark)).collect()) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0)]
    assert line_dedup.line_dedup_query(frame(spark, docs).limit(0)).count() == 0


def test_op9_rows_without_an_id_are_documents_like_others(spark):
    block = "\n".join(f"line {i} of a block" for i in range(20))
    lost = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.line_dedup_query(frame(spark, rows)).collect())
    named = [n for _, _, n in lost([(1, block), (2, block), (3, block)])]
    assert named[0] == 0 and named[1] == named[2] > 0
    assert [n for _, _, n in lost([(None, block)] * 3)] == named
    assert lost([(None, block), (7, block), (None, "other")]) == [(False, 7, 0), (True, 0, 0), (True, 0, named[1])]
    # a repeated id with another text loses what the other text holds; the same row twice loses nothing
    assert lost([(5, "a\n" + block), (5, "b\n" + block)])[0][2] == 0 and lost([(5, "a\n" + block), (5, "b\n" + block)])[1][2] > 0
    assert lost([(5, block), (5, block)]) == [(False, 5, 0), (False, 5, 0)]
    # a table of which most rows have no id
    many = lost([(None, f"{block}\nown {i}\nlines {i}") for i in range(60)] + [(1, block)])
    assert sum(n for _, _, n in many) >= 59 * named[1]


def test_op1_tables_of_few_texts(spark):
    for rows in ([], [(1, "a@b.cc")], [(i, "a@b.cc and 10.0.0.1") for i in range(3)], [(i, None) for i in range(5)], [(i, f"mail x{i}@y.zz") for i in range(4)]):
        got = rows_of(pii.pii_query(frame(spark, rows)))
        assert [r[:6] for r in got] == [(i, *pii.brute_force(t)) for i, t in rows]


def test_op10(spark, docs):
    for width, percent in ((3, 90), (5, 80)):
        assert rows_of(ngram_join.near_duplicates(frame(spark, docs), width, percent)) == ngram_join.brute_force(docs, width, percent)
    assert rows_of(ngram_join.near_duplicates(frame(spark, docs), group_shingles=300)) == ngram_join.brute_force(docs)
    assert rows_of(ngram_join.near_duplicates(odd(spark))) == [(1, 3, 1), (1, 3, 1), (2, 1, 2), (2, 3, 2), (3, 0, 3), (None, 3, None)]
    assert ngram_join.near_duplicates(frame(spark, docs).limit(0)).count() == 0


def test_op10_hot_and_very_long_lists_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 2)
    near = [(1000 + i, " ".join([f"w{j}" for j in range(120) if j != i] + [f"own{i}"])) for i in range(40)]
    want = ngram_join.brute_force(docs + near)
    for bounds in ({"hot_list": 3}, {"hot_list": 3, "most_list": 4}):
        assert rows_of(ngram_join.near_duplicates(frame(spark, docs + near), **bounds)) == want


def test_op10_rows_that_repeat_an_id_tie_all_their_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (3, c), (5, a), (5, b), (5, c), (5, ""), (6, ""), (7, None)]
    got = rows_of(ngram_join.near_duplicates(frame(spark, rows)))
    assert got == sorted(ngram_join.brute_force(rows)) and {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 6, 7: 7}
    rng = random.Random(9)
    texts = [" ".join(f"{k}w{i}" for i in range(rng.randint(1, 12))) for k in range(14)]
    rows = [(rng.randint(0, 25), rng.choice(texts)) for _ in range(40)]
    assert rows_of(ngram_join.near_duplicates(frame(spark, rows))) == sorted(ngram_join.brute_force(rows))


@pytest.mark.parametrize("batch, most", [(1, 4), (3, 2), (7, 1000), (1000, 3)])
def test_op10_runs_of_lists_keep_all_pairs_within_the_length_bound(batch, most):
    import pyarrow as pa

    rng = random.Random(batch)
    size = [rng.randint(5, 60) for _ in range(40)]
    lists = {t: sorted({(size[c], c, -c) for c in rng.sample(range(40), rng.choice([1, 2, 3, 9, 25]))}) for t in range(30)}
    lists[30], lists[31] = lists[3], lists[4]
    rows = [(t, *c) for t in sorted(lists) for c in lists[t] for _ in range(rng.choice([1, 1, 2]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + batch])], ["token", "n", "f1", "f2"]) for i in range(0, len(rows), batch)]
    got = collections.defaultdict(set)
    for b in ngram_join.runs_of_lists(iter(batches), 80, most):
        for name, f1, f2 in zip(*(b.column(i).to_pylist() for i in range(3))):
            assert f2 == -f1
            got[name].add(f1)
    fits = lambda a, b: 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])
    pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b and fits(a, b)}
    assert pairs(got.values()) == pairs([[c for _, c, _ in x] for x in lists.values()])
    assert all(len(g) > 1 for g in got.values())
    if most == 1000:
        assert len({frozenset(g) for g in got.values()}) == len(got)
    assert not sum(b.num_rows for b in ngram_join.runs_of_lists(iter([]), 80))


def test_op10_linked_sets_pass_every_filter():
    rng = random.Random(2)
    for percent in (80, 90):
        for _ in range(800):
            n = rng.choice([1, 2, 3, 5, 9, 10, 11, 15, 20, 30, 76, 200])
            a = rng.sample(range(10**6), n)
            b = a[rng.randint(0, n // 6) :] + rng.sample(range(10**6, 2 * 10**6), rng.randint(0, max(1, n // 8)))
            same = len(set(a) & set(b))
            if 100 * same < percent * len(set(a) | set(b)):
                continue
            sets = [np.sort(ngram_join.mix(np.array(sorted(s), np.uint64))) for s in (a, b)]
            values, at = np.concatenate(sets), np.array([0, len(a), len(a) + len(b)])
            sizes, marks = np.diff(at), ngram_join.signatures(values, at, percent)
            marks = [(v.astype(np.int64), x) for v, x in marks]
            assert ngram_join.long_list(sizes, *marks, percent)[1] == 0
            assert ngram_join.short_lists(np.array([0]), np.array([2]), sizes, marks, percent)[1] == 0
            assert ngram_join.linked(values, at, percent)[1] == 0
            # any order: the first tokens of both in it
            rank = np.random.default_rng(n).permutation(len(np.unique(values)))
            own, own_at = ngram_join._prefixes(np.unique(values, return_inverse=True)[1], at, rank, percent)
            assert set(own[: own_at[1]].tolist()) & set(own[own_at[1] :].tolist())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_op4(spark, docs, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix_sources(df)
    rows = got.collect()
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) - mixing.KEEP * total) < 0.02 * total
    assert all(0 <= r["probability"] <= 1 for r in rows) and len(rows) == df.count()
    assert mixing.mix_sources(frame(spark, docs)).count() == len(docs) and mixing.mix_sources(odd(spark)).count() == 6
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_op4_query_against_plain_loops(spark, docs):
    """Probabilities of the query, with topics as it assigns them, by raking and calibration in plain Python."""
    rows = mixing.mix_sources(frame(spark, docs)).collect()
    cells = collections.Counter()
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    cells = {c: t for c, t in cells.items() if t}
    targets = []
    for d, dim in enumerate(mixing.DIMENSIONS):
        share = collections.Counter()
        for c, t in cells.items():
            share[c[d]] += t
        share = {k: t ** mixing.FLATTEN[dim] for k, t in share.items()}
        targets.append({k: v / sum(share.values()) for k, v in share.items()})
    weight = {c: float(t) for c, t in cells.items()}
    off = lambda d: max(abs(sum(w for c, w in weight.items() if c[d] == k) - v) for k, v in targets[d].items())
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            sums = collections.Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * targets[d][c[d]] / sums[c[d]] for c, w in weight.items()}
        if max(map(off, range(3))) <= mixing.TOLERANCE:
            break
    wanted, scale = mixing.KEEP * sum(cells.values()), 0.0
    low, high = 0.0, 1e9
    for _ in range(200):  # the scale whose expected tokens are those wanted
        scale = (low + high) / 2
        low, high = (scale, high) if sum(min(t, scale * weight[c]) for c, t in cells.items()) < wanted else (low, scale)
    for r in rows:
        c = r["source"], r["lang"], r["topic"]
        want = min(1.0, scale * weight[c] / cells[c]) if c in cells else 1.0
        assert abs(r["probability"] - want) < 1e-6 and (c not in cells or abs(r["gap"] - max(map(off, range(3)))) < 1e-9)
        assert r["selected"] == (((r["mark"] & (2**64 - 1)) >> 11) / 2.0**53 < r["probability"])
    assert {(r["doc_id"], r["n_tokens"]) for r in rows} == {(i, len((t or "").split())) for i, t in docs}


def test_op4_raking_meets_the_targets(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(s, lang, t, rng.randint(1, 1000)) for s in "abc" for lang in ("en", "fr") for t in range(3)], "source string, lang string, topic int, tokens long")
    share = lambda d, **kw: spark.createDataFrame(list(kw.items()) if d != "topic" else [(int(k[1:]), v) for k, v in kw.items()], f"{d} {'int' if d == 'topic' else 'string'}, target double")
    targets = {"source": share("source", a=0.2, b=0.3, c=0.5), "lang": share("lang", en=0.6, fr=0.4), "topic": share("topic", t0=0.1, t1=0.4, t2=0.5)}
    both = []
    for bound in (100_000, 1):  # on the driver, and as DataFrames
        raked = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(cells, targets, local_cells=bound).collect()}
        both.append(raked)
        for place, want in ((0, {"a": 0.2, "b": 0.3, "c": 0.5}), (1, {"en": 0.6, "fr": 0.4}), (2, {0: 0.1, 1: 0.4, 2: 0.5})):
            for name, w in want.items():
                assert abs(sum(v for k, v in raked.items() if k[place] == name) - w) < 1e-3
    assert both[0].keys() == both[1].keys() and all(abs(both[0][k] - both[1][k]) < 1e-9 for k in both[0])


def test_streams_search_one_row_each_in_half_the_levels(monkeypatch):
    """Both bounds of an interval were searched, bit by bit, though the last one is never needed."""
    rng = random.Random(7)
    contents = [np.array([rng.randrange(60) for _ in range(30)]) for _ in range(4)]
    built, asked = suffix_index.WaveletIndex(contents, 3), []
    search = suffix_index.WaveletIndex.search
    monkeypatch.setattr(suffix_index.WaveletIndex, "search", lambda self, symbols, rows: asked.append(len(rows)) or search(self, symbols, rows))
    built.stream()
    assert asked == [4] * 30 and len(built.levels) == (int(built.n_symbols - 1).bit_length() + 1) // 2


@pytest.mark.parametrize("module", [byte_dedup, substring_dedup])
def test_contents_of_many_documents_are_one_batch(module):
    """Each document's contents were a batch of their own, and each range a dict."""
    import pyarrow as pa

    from factgraph.llm import repeats

    kind = module.kind(5, 2)
    texts = [" ".join(f"w{i}{k}" for k in range(40)) for i in range(50)]
    spot = lambda tag, lo: {"kind": tag, "h1": lo, "lo": lo, "hi": lo + 2}
    kinds = pa.list_(pa.struct([("kind", pa.int8()), ("h1", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
    wanted = [[spot(repeats.FETCH, 1), spot(repeats.HOT, 3), spot(repeats.FETCH, 7), spot(repeats.FETCH, 10_000)] for _ in texts]
    numbers = pa.array(range(50), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts), pa.array(wanted, kinds)], names=["doc_id", "key", "text", "wanted"])
    found = list(repeats._fetch(kind)(iter([batch])))
    rows = [r for b in found for r in b.to_pylist() if r["kind"] == repeats.FETCH]
    assert len(found) == 2 and [(r["doc_id"], r["h1"], r["lo"], r["hi"]) for r in rows] == [(d, lo, lo, lo + 2) for d in range(50) for lo in (1, 7)]
    want = lambda t, lo: kind.contents(np.frombuffer(t.encode(), np.uint8), np.array([lo]), np.array([lo + 1 + 5]))[0]
    assert [r["content"] for r in rows] == [want(t, lo) for t in texts for lo in (1, 7)]
