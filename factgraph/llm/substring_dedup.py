"""Substring dedup of word passages with a compressed FM-index per shard.

Every word covered by a window of ``WIDTH`` words whose sequence also starts in an earlier document
is removed; windows are judged on the input.

``repeats`` brings contents that may share windows into shards.  A shard's contents make an
FM-index whose transform is a wavelet matrix; contents are streamed by backward search, and their
matching statistics of ``WIDTH`` words or more against an earlier document are reported.

Defined results: documents are in order of doc_id, a null one last, and then of a hash of the text;
a null or empty text has no words; rows with a null doc_id, and rows that repeat a doc_id with
another text, are documents of their own; rows of one doc_id (or none) with the same text are one
document and are cut alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import BASES, BYTE_TABLES, SPACE_WORDS, word_hashes, word_spans
from .repeats import Kind, cut
from .suffix_index import WaveletIndex

WIDTH, GRAM = 50, 12


def _units(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, at = word_spans(raw, offsets, SPACE_WORDS)
    return word_hashes(raw, starts, ends, BYTE_TABLES[0], BASES[0]), word_hashes(raw, starts, ends, BYTE_TABLES[1], BASES[1]), at


def _contents(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes | None]:
    words = raw.tobytes().split()
    return [b" ".join(words[a:b]) if b <= len(words) else None for a, b in zip(lo.tolist(), hi.tolist())]


def _classes(contents: list[bytes], width: int) -> list[np.ndarray]:
    split = [c.split(b" ") for c in contents]
    ids: dict[bytes, int] = {}
    return WaveletIndex([np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in split], width).stream()


def kind(width: int = WIDTH, gram: int = GRAM) -> Kind:
    return Kind(width, gram, False, _units, _contents, _classes)


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of each row."""

    def apply(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        words = raw.tobytes().split()
        kept, last = [], 0
        for a, b in zip(lo.tolist(), hi.tolist()):
            kept += words[last:a]
            last = b
        kept += words[last:]
        text = b" ".join(kept)
        return len(words), len(words) - len(kept), text.decode(), hashlib.sha256(text).hexdigest()

    return cut(docs, kind(width, gram), apply, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def substring_dedup_query(docs: DataFrame) -> DataFrame:
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH})),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM m WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t, count(*) AS n, count(gone.p) AS r
      FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def brute_force(docs: list[tuple], width: int = WIDTH) -> list[tuple]:
    """The query's rows by plain comparison, for tests."""
    import re

    first: dict[tuple, int] = {}
    split = [(i, re.findall("[^ \t-\r]+", t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
