"""Suffix-array dedup of byte strings with a run-length index.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (in an earlier document, or
earlier in the same one) is removed; overlaps count and strings are judged on the input.

``repeats`` brings contents that may share strings into shards.  A shard's contents make a
run-compressed Burrows-Wheeler transform with suffix samples at run ends; each content is streamed
through it, and where its matching statistics reach ``WIDTH`` against an earlier content, the match
is marked.

Defined results: documents are in order of doc_id, a null one last, and then of a hash of the text;
a null or empty text has no bytes; rows with a null doc_id, and rows that repeat a doc_id with
another text, are documents of their own; rows of one doc_id (or none) with the same text are one
document and are cut alike, so none of them is a repeat of another; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import BYTE_TABLES
from .repeats import Kind, cut
from .suffix_index import RunLengthIndex

WIDTH, GRAM = 100, 32


def _units(raw: np.ndarray, offsets: np.ndarray):
    return BYTE_TABLES[0][raw], BYTE_TABLES[1][raw], offsets


def _contents(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes | None]:
    data = raw.tobytes()
    return [data[a:b] if b <= len(data) else None for a, b in zip(lo.tolist(), hi.tolist())]


def _classes(contents: list[bytes], width: int) -> list[np.ndarray]:
    return RunLengthIndex([np.frombuffer(c, np.uint8).astype(np.int64) for c in contents], width).stream()


def kind(width: int = WIDTH, gram: int = GRAM) -> Kind:
    return Kind(width, gram, True, _units, _contents, _classes)


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of each row."""

    def apply(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        keep = np.ones(len(raw), bool)
        for a, b in zip(lo, hi):
            keep[a:b] = False
        kept = raw[keep].tobytes()
        return len(raw), len(raw) - len(kept), int((lo < len(raw)).sum()), kept, hashlib.sha256(kept).hexdigest()

    return cut(docs, kind(width, gram), apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def byte_dedup_query(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(docs: list[tuple], width: int = WIDTH) -> list[tuple]:
    """The query's rows by plain comparison, for tests."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                gone[i : i + width] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
