"""License scan by ordered signature rules, in DataFrame functions only.

1. A row is searched only if its text holds one of ``GATES``, pieces of text of which every rule and
   phrase needs one; the words of the others are only counted.
2. The words of a searched text are put in lower case (A-Z only) and numbered.  Every rule is a regular
   expression over words joined by one space, with a keyword that it starts with.  Each word that is a
   keyword is an anchor: the rules of that keyword, and no others, are tried on the ``SPAN`` words from it.
   So the work is linear in the words and in the anchors.
3. Rules are ordered by priority: tags made for machines, then statements that grant a license, then
   titles with a version, then bare names.  A detection is suppressed if its interval of words lies within
   that of a detection of a better priority, or of the same one and longer, or, if the intervals are
   equal too, of an earlier rule.  What holds what is found by a running maximum of ends over the
   detections in order of place, in blocks, so no pairs of detections are formed.

Nothing is shuffled or broadcast; the rules are constants of the plan.

Base phrases are places where their words stand consecutively, overlapping or not, and their labels
always stay; the labels of detections that aren't suppressed come on top.

Defined results: a null or empty text has no words; repeated rows and null ids are rows like any other;
texts of any length are searched whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words from an anchor that a rule may take, itself included.
SPAN = 24
#: Detections whose predecessors are compared one by one; beyond, a block's largest ends stand for it.
BLOCK = 64
#: Phrases of the base rules and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licenses, a line each: label; SPDX tags; titles (with a version where there are several); bare names.
#: Patterns stand for words in lower case.  V is an optional "version" or "v" before a number, L is "or later", and a
#: pattern with "gnu? " before it is meant with and without that word.
_LICENSES = """
mit; mit, expat, x11; mit licen[cs]e, expat licen[cs]e, massachusetts institute of technology licen[cs]e; mit licensed, mit style licen[cs]e, mit x11 licen[cs]e
mit-0; mit 0; mit no attribution licen[cs]e; mit 0 licen[cs]e
apache-1.1; apache 1 1; apache(?: software)? licen[cs]eV 1 1; apache 1 1
apache-2.0; apache 2 0; apache(?: software)? licen[cs]eV 2(?: 0)?; apache 2 0, apachev2
apache-any; apache; apache foundation licen[cs]e; apache(?: software)? licen[cs]e, apache licensed
gpl-1.0; gpl 1 0, gpl 1 0 only, gpl 1 0 or later; gnu? general public licen[cs]eV 1(?: 0)?; gplV 1(?: 0)?
gpl-2.0; gpl 2 0, gpl 2 0 only; gnu? general public licen[cs]eV 2(?: 0)?, gnu gplV 2(?: 0)?; gplV 2(?: 0)?, gplv2
gpl-2.0-or-later; gpl 2 0 or later; gnu? general public licen[cs]eV 2(?: 0)?L, gnu gplV 2(?: 0)?L; gplV 2(?: 0)?L, gplv2L
gpl-3.0; gpl 3 0, gpl 3 0 only; gnu? general public licen[cs]eV 3(?: 0)?, gnu gplV 3(?: 0)?; gplV 3(?: 0)?, gplv3
gpl-3.0-or-later; gpl 3 0 or later; gnu? general public licen[cs]eV 3(?: 0)?L, gnu gplV 3(?: 0)?L; gplV 3(?: 0)?L, gplv3L
gpl-any; gpl; gnu general public licen[cs]e, gnu public licen[cs]e; general public licen[cs]e, gnu gpl, gpl, gpl licensed
lgpl-2.0; lgpl 2 0, lgpl 2 0 only, lgpl 2 0 or later; gnu library(?: general)? public licen[cs]eV 2(?: 0)?; library general public licen[cs]e, lgplV 2 0
lgpl-2.1; lgpl 2 1, lgpl 2 1 only, lgpl 2 1 or later; gnu? lesser general public licen[cs]eV 2 1L?, gnu lgplV 2 1L?; lgplV 2 1L?, lgplv2 1
lgpl-3.0; lgpl 3 0, lgpl 3 0 only, lgpl 3 0 or later; gnu? lesser general public licen[cs]eV 3(?: 0)?L?, gnu lgplV 3(?: 0)?L?; lgplV 3(?: 0)?L?, lgplv3
lgpl-any; lgpl; gnu lesser general public licen[cs]e; lesser general public licen[cs]e, gnu lgpl, lgpl, lgpl licensed
agpl-3.0; agpl 3 0, agpl 3 0 only, agpl 3 0 or later; gnu? affero general public licen[cs]eV 3(?: 0)?L?, gnu agplV 3(?: 0)?L?; agplV 3(?: 0)?L?, agplv3
agpl-any; agpl; gnu affero general public licen[cs]e; affero general public licen[cs]e, gnu agpl, agpl
gfdl; gfdl 1 1, gfdl 1 2, gfdl 1 3; gnu? free documentation licen[cs]e, gnu? free documentation licen[cs]eV 1 [123]; gfdl
bsd-0-clause; 0bsd; bsd zero clause licen[cs]e, zero clause bsd licen[cs]e; bsd 0 clause, zero clause bsd
bsd-2-clause; bsd 2 clause, bsd 2 clause freebsd; bsd 2 clause licen[cs]e, 2 clause bsd licen[cs]e, two clause bsd licen[cs]e, simplified bsd licen[cs]e, freebsd licen[cs]e; 2 clause bsd, simplified bsd, bsd 2 clause
bsd-3-clause; bsd 3 clause, bsd 3 clause clear; bsd 3 clause licen[cs]e, 3 clause bsd licen[cs]e, three clause bsd licen[cs]e, new bsd licen[cs]e, modified bsd licen[cs]e, revised bsd licen[cs]e; 3 clause bsd, new bsd, modified bsd, bsd 3 clause
bsd-4-clause; bsd 4 clause; bsd 4 clause licen[cs]e, 4 clause bsd licen[cs]e, original bsd licen[cs]e; 4 clause bsd, bsd 4 clause
bsd-any; bsd; berkeley software distribution licen[cs]e; bsd licen[cs]e, bsd style licen[cs]e, bsd licensed
mpl-1.1; mpl 1 0, mpl 1 1; mozilla public licen[cs]eV 1(?: [01])?; mozilla mplV 1(?: [01])?
mpl-2.0; mpl 2 0, mpl 2 0 no copyleft exception; mozilla public licen[cs]eV 2(?: 0)?; mozilla mplV 2(?: 0)?
mpl-any; mpl; mozilla public licen[cs]e; mpl licensed
epl-1.0; epl 1 0; eclipse public licen[cs]eV 1(?: 0)?; epl 1 0 licen[cs]e
epl-2.0; epl 2 0; eclipse public licen[cs]eV 2(?: 0)?; epl 2 0 licen[cs]e
epl-any; epl; eclipse public licen[cs]e; eclipse distribution licen[cs]e
cddl-1.0; cddl 1 0, cddl 1 1; common development and distribution licen[cs]e, common development and distribution licen[cs]eV 1 [01]; cddl, cddlV 1 [01]
cpl-1.0; cpl 1 0; common public licen[cs]e, common public licen[cs]eV 1(?: 0)?; cpl licensed
isc; isc; isc licen[cs]e, internet systems consortium licen[cs]e; isc licensed
zlib; zlib, libpng; zlib licen[cs]e, zlib libpng licen[cs]e, libpng licen[cs]e; zlib licensed
bsl-1.0; bsl 1 0; boost software licen[cs]e, boost software licen[cs]eV 1(?: 0)?; boost licen[cs]e
unlicense; unlicense; the unlicense, unlicense org; unlicense
wtfpl; wtfpl; wtfplV 2, wtf public licen[cs]e; wtfpl
artistic-1.0; artistic 1 0; artistic licen[cs]eV 1(?: 0)?; perl 5 licen[cs]e
artistic-2.0; artistic 2 0; artistic licen[cs]eV 2(?: 0)?; artistic 2 0 licen[cs]e
artistic-any; artistic; perl artistic licen[cs]e; artistic licen[cs]e
eupl-1.2; eupl 1 1, eupl 1 2; european union public licen[cs]e, european union public licen[cs]eV 1 [12]; eupl licensed
osl-3.0; osl 3 0; open software licen[cs]e, open software licen[cs]eV 3(?: 0)?; osl licensed
afl-3.0; afl 3 0; academic free licen[cs]e, academic free licen[cs]eV [23] [01]; afl licensed
ms-pl; ms pl; microsoft public licen[cs]e; ms pl licen[cs]e
ms-rl; ms rl; microsoft reciprocal licen[cs]e; ms rl licen[cs]e
python-2.0; psf 2 0, python 2 0; python software foundation licen[cs]e, python software foundation licen[cs]eV 2(?: 0)?; python licen[cs]e, psf licen[cs]e
php-3.01; php 3 0, php 3 01; php licen[cs]eV 3(?: 01?)?; php licen[cs]e
ruby; ruby; ruby licen[cs]e; ruby s licen[cs]e
ncsa; ncsa; university of illinois ncsa open source licen[cs]e; ncsa open source licen[cs]e, ncsa licen[cs]e
postgresql; postgresql; postgresql licen[cs]e; postgresql licensed
openssl; openssl; openssl licen[cs]e; ssleay licen[cs]e
curl; curl; curl licen[cs]e; curl licensed
ofl-1.1; ofl 1 0, ofl 1 1; sil open font licen[cs]e, sil open font licen[cs]eV 1 [01]; open font licen[cs]e
odbl-1.0; odbl 1 0; open data commons open database licen[cs]e, open database licen[cs]e; odbl licensed
odc-by-1.0; odc by 1 0; open data commons attribution licen[cs]e; odc by licen[cs]e
pddl-1.0; pddl 1 0; public domain dedication and licen[cs]e; pddl licensed
ecl-2.0; ecl 2 0; educational community licen[cs]e, educational community licen[cs]eV 2 0; ecl licensed
upl-1.0; upl 1 0; universal permissive licen[cs]e, universal permissive licen[cs]eV 1 0; upl licensed
cecill; cecill 2 0, cecill 2 1, cecill b, cecill c; cecill free software licen[cs]e, cecill b licen[cs]e, cecill c licen[cs]e; cecill licen[cs]e
beerware; beerware; the beer ware licen[cs]e; beer ware licen[cs]e
busl-1.1; busl 1 1; business source licen[cs]e, business source licen[cs]eV 1 1; busl licensed
sspl-1.0; sspl 1 0; server side public licen[cs]e, server side public licen[cs]eV 1; sspl licensed
elastic-2.0; elastic 2 0; elastic licen[cs]eV 2(?: 0)?; elastic licen[cs]e
openrail; openrail, bigscience openrail m, creativeml openrail m; bigscience openrail m, creativeml openrail m, responsible ai licen[cs]e; openrail, openrail m
cc0-1.0; cc0 1 0; cc0 1 0, cc0 1 0 universal, creative commons zeroV 1 0; cc0, creative commons zero
cc-by; cc by 1 0, cc by 2 0, cc by 2 5, cc by 3 0, cc by 4 0; creative commons attribution [1-4] [05]N?, cc by [1-4] [05]; cc by, creative commons attribution licen[cs]e
cc-by-sa; cc by sa 1 0, cc by sa 2 0, cc by sa 2 5, cc by sa 3 0, cc by sa 4 0; creative commons attribution share ?alike(?: [1-4] [05]N?)?, cc by sa [1-4] [05]; cc by sa
cc-by-nd; cc by nd 2 0, cc by nd 3 0, cc by nd 4 0; creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05]N?)?, cc by nd [1-4] [05]; cc by nd
cc-by-nc; cc by nc 2 0, cc by nc 2 5, cc by nc 3 0, cc by nc 4 0; creative commons attribution non ?commercial(?: [1-4] [05]N?)?, cc by nc [1-4] [05]; cc by nc
cc-by-nc-sa; cc by nc sa 2 0, cc by nc sa 2 5, cc by nc sa 3 0, cc by nc sa 4 0; creative commons attribution non ?commercial share ?alike(?: [1-4] [05]N?)?, cc by nc sa [1-4] [05]; cc by nc sa
cc-by-nc-nd; cc by nc nd 2 0, cc by nc nd 2 5, cc by nc nd 3 0, cc by nc nd 4 0; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05]N?)?, cc by nc nd [1-4] [05]; cc by nc nd
"""
#: Sentences of license texts and notices, a line each: label; pattern.
_SENTENCES = """
mit; permission is hereby granted free of charge to any person obtaining a copy of this software
isc; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-any; redistribution and use in source and binary forms with or without modification are permitted
bsl-1.0; permission is hereby granted free of charge to any person or organization obtaining a copy of the software
zlib; permission is granted to anyone to use this software for any purpose including commercial applications
unlicense; free and unencumbered software released into the public domain
public-domain; dedicated to the public domain
public-domain; released (?:in|into|to) the public domain
public-domain; placed in the public domain
public-domain; public domain dedication
proprietary; copyright [^ ]+(?: [^ ]+){0,6} all rights reserved
proprietary; proprietary and confidential
proprietary; confidential and proprietary
proprietary; unauthorized copying of this file
gpl-any; free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl-any; free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
apache-2.0; apache org licenses license 2 0
gpl-any; gnu org licenses
gpl-any; gnu org licenses gpl(?: [23] 0)?
cc-by; creativecommons org licenses by [1-4] [05]
cc-by-sa; creativecommons org licenses by sa [1-4] [05]
cc-by-nc; creativecommons org licenses by nc [1-4] [05]
cc-by-nd; creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd; creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0; creativecommons org publicdomain zero 1 0
mpl-2.0; mozilla org mpl 2 0
"""
#: What V, L and N stand for, and the words of a grant.
_SHORT = {"V ": "(?: version| v)? v?", "L": " or(?: at your option)?(?: any)? later(?: versions?)?", "N": "(?: international| unported| generic)?"}
_GRANTS = ("licensed", "licenced", "released", "distributed", "available", "published", "provided")
_UNDER = " (?:under|by)(?: the)?(?: terms of(?: the)?)? "
#: Pieces of text, in lower case, of which every rule and phrase needs one.
GATES = ("licen", "gpl", "apache", "bsd", "mozilla", "spdx", "gfdl", "cddl", "wtfpl", "openrail", "cc0", "zero", "creative", "domain", "copyright", "permission", "redistribution", "proprietary", "unauthorized", "gnu")
#: The one gate that goes over several words, as its words alone are too common.
WORDS_GATE = "(?i)cc[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+by"


def _rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) in order; a keyword is the word that the pattern begins with."""

    def each(cell: str) -> list[str]:
        out = []
        for p in cell.split(","):
            p = re.sub("V |[LN]", lambda m: _SHORT[m.group()], p.strip()).replace(_SHORT["L"] + "?", f"(?:{_SHORT['L']})?")
            out += [p.replace("gnu? ", "gnu "), p.replace("gnu? ", "")] if p.startswith("gnu? ") else [p]
        return out

    found = []
    for line in _LICENSES.strip().split("\n"):
        label, tags, titles, names = (x.strip() for x in line.split(";"))
        named = each(titles) + each(names)
        found += [(1, label, f"spdx license identifier {t}") for t in each(tags)]
        found += [(2, label, f"{grant}{_UNDER}(?:{'|'.join(named)})") for grant in _GRANTS]
        found += [(3, label, t) for t in each(titles)] + [(4, label, n) for n in each(names)]
    found += [(2, *(x.strip() for x in line.split(";"))) for line in _SENTENCES.strip().split("\n")]
    return sorted(dict.fromkeys((priority, label, re.match("[a-z0-9]+", p).group(), p) for priority, label, p in found), key=lambda r: r[0])


RULES = _rules()
KEYWORDS = sorted({r[2] for r in RULES})
LEVELS = max(r[0] for r in RULES)
#: What a detection of each priority is worth as evidence, and a base phrase.
WORTH, BASE_WORTH = (1.0, 0.9, 0.8, 0.6), 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_HIT = "array<struct<start: int, below: int, priority: int, rule: int, label: string>>"


def _rule_map() -> Column:
    """Rules by keyword, as a constant."""
    by: dict = {}
    for i, (priority, label, keyword, pattern) in enumerate(RULES):
        by.setdefault(keyword, []).append({"priority": priority, "rule": i, "label": label, "pattern": f"^(?:{pattern})(?= |$)"})
    return F.from_json(F.lit(json.dumps(by)), "map<string, array<struct<priority: int, rule: int, label: string, pattern: string>>>")


def _places(words: Column, phrase: str) -> Column:
    """Numbers of the words where a phrase starts."""
    parts = phrase.split(" ")
    here = lambda w, i: (w == parts[0]) & reduce(Column.__and__, [F.get(words, i + j) == p for j, p in enumerate(parts[1:], 1)], F.lit(True))
    return F.filter(F.transform(words, lambda w, i: F.when(here(w, i), i)), lambda i: i.isNotNull())


def _kept(df: DataFrame, hits: str) -> DataFrame:
    """``df`` with the detections of column ``hits`` (sorted by start, the longest first) that none before them suppresses."""
    levels = f"sequence(1, {LEVELS})"
    blocks = f"CASE WHEN size({hits}) = 0 THEN CAST(array() AS array<{_HIT}>) ELSE transform(sequence(0, (size({hits}) - 1) div {BLOCK}), b -> slice({hits}, b * {BLOCK} + 1, {BLOCK})) END"
    df = df.withColumn("_blocks", F.expr(blocks))
    # the largest end up to each priority, of each block and of all blocks before it
    df = df.withColumn("_most", F.expr(f"transform(_blocks, x -> transform({levels}, p -> coalesce(array_max(transform(filter(x, h -> h.priority <= p), h -> -h.below)), -1)))"))
    df = df.withColumn("_before", F.expr(f"transform(_most, (m, b) -> transform({levels}, p -> coalesce(array_max(transform(slice(_most, 1, b), e -> element_at(e, p))), -1)))"))
    held = "element_at(ends, h.priority) >= -h.below OR exists(slice(x, 1, i), y -> y.priority <= h.priority AND y.below <= h.below)"
    return df.withColumn(hits, F.expr(f"flatten(zip_with(_blocks, _before, (x, ends) -> filter(x, (h, i) -> NOT ({held}))))")).drop("_blocks", "_most", "_before")


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, base (places of phrases: start and label), detections (first_word, last_word, priority, rule, label) and score."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("lowered", F.lower("text"))
    gated = reduce(Column.__or__, [F.col("lowered").contains(g) for g in GATES]) | F.col("text").rlike(WORDS_GATE)
    df = df.select("doc_id", F.split("text", _BETWEEN).alias("pieces"), gated.alias("gated"))
    # only the first and the last piece can be empty, and one piece may be both
    n, blank = F.size("pieces"), lambda i: (F.element_at("pieces", i) == "").cast("int")
    df = df.select("doc_id", (n - blank(1) - F.when(n > 1, blank(-1)).otherwise(0)).cast("long").alias("n_words"), "gated", "pieces")
    listed = F.transform(F.filter("pieces", lambda w: w != ""), lambda w: F.translate(w, _UPPER, _LOWER))
    df = df.select("doc_id", "n_words", F.when(F.col("gated"), listed).otherwise(F.array().cast("array<string>")).alias("words"))
    anchors = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*KEYWORDS), i)), lambda i: i.isNotNull())
    df = df.withColumn("anchors", F.transform(anchors, lambda i: F.struct(i.alias("at"), F.get("words", i).alias("keyword"), F.array_join(F.slice("words", i + 1, SPAN), " ").alias("ahead"))))
    named = lambda label: lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))
    base = F.flatten(F.array(*[F.transform(_places(F.col("words"), p), named(label)) for p, label in phrases]))
    df = df.withColumn("base", base)
    end = lambda a, r: a["at"] + F.size(F.split(F.call_function("regexp_extract", a["ahead"], r["pattern"], F.lit(0)), " "))
    tried = lambda a: F.transform(
        F.filter(F.element_at("rules", a["keyword"]), lambda r: F.regexp_like(a["ahead"], r["pattern"])),
        lambda r: F.struct(a["at"].alias("start"), (-end(a, r)).alias("below"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")),
    )
    df = df.withColumn("rules", _rule_map()).withColumn("hits", F.array_sort(F.flatten(F.transform("anchors", tried)).cast(_HIT))).drop("words", "anchors", "rules")
    df = _kept(df, "hits")
    worth = F.array_max(F.transform("hits", lambda h: F.element_at(F.array(*map(F.lit, WORTH)), h["priority"])))
    score = F.greatest(F.coalesce(worth, F.lit(0.0)), F.when(F.size("base") > 0, BASE_WORTH).otherwise(0.0))
    shown = F.transform("hits", lambda h: F.struct(h["start"].alias("first_word"), (-h["below"] - 1).alias("last_word"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label")))
    return df.select("doc_id", "n_words", "base", shown.alias("detections"), score.alias("score"))


def license_query(docs: DataFrame) -> DataFrame:
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts, labels = F.transform("base", lambda b: b["start"].cast("long")), F.transform("base", lambda b: b["label"])
    found = F.concat(labels, F.transform("detections", lambda d: d["label"]))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(found).alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"),
    )


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {priority}, {text(label)}, {text(keyword)}, {text(pattern)})" for i, (priority, label, keyword, pattern) in enumerate(RULES))
    phrases = ", ".join(f"({text(p)}, {text(label)})" for p, label in PHRASES)
    worth = " ".join(f"WHEN {p} THEN {w}" for p, w in enumerate(WORTH, 1))
    return f"""
WITH rules(rule, priority, label, keyword, pattern) AS (VALUES {rules}), phrases(phrase, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
b AS (SELECT doc_id, i, label FROM w JOIN phrases ON list_slice(ws, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' ')),
h AS (SELECT doc_id, i AS a, i + len(string_split(rtrim(hit, ' '), ' ')) AS z, priority, rule, label
      FROM (SELECT doc_id, i, priority, rule, label, regexp_extract(array_to_string(list_slice(ws, i + 1, i + {SPAN}), ' '), '^(?:' || pattern || ')(?: |$)') AS hit FROM w JOIN rules ON keyword = word) WHERE hit <> ''),
k AS (SELECT doc_id, label, priority FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.z >= h.z AND (o.priority < h.priority
      OR o.priority = h.priority AND (o.z - o.a > h.z - h.a OR o.a = h.a AND o.z = h.z AND o.rule < h.rule)))),
bs AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM k UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id),
ks AS (SELECT doc_id, count(*) AS n, max(CASE priority {worth} END) AS worth FROM k GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(bs.labels, '') AS base_labels,
       coalesce(ls.labels, '') AS labels, greatest(coalesce(worth, 0.0), CASE WHEN bs.n > 0 THEN {BASE_WORTH} ELSE 0.0 END)::DOUBLE AS score, coalesce(ks.n, 0)::BIGINT AS n_detections
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN ks USING (doc_id)
"""


ORACLE_SQL = _sql()
