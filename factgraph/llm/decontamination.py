"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

A benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window).  A
document holds a window if all of the window's shingles of ``SHINGLE`` words stand in it at one
place.  As all of them are needed, a window's prefix is a single shingle: its rarest in the corpus.
So the join runs on one shingle a window, and then

* the positional bound: the shingle's place in the window fixes where the window would start;
* the length bound: that start and end must lie within the document's words;
* verification: all words of the window are compared at that place, first their hashes and then
  their bytes.

Shingle frequencies are counted over all documents.  The benchmark is taken in blocks of at most
``BLOCK_WINDOWS`` windows, each sent to all tasks, so what is broadcast has a fixed bound and a
larger benchmark only means more passes.

Defined results: a null or empty text has no words and is clean; an item without words has no
windows; items with equal ids count once; an item without an id marks words and counts as the id
``''``; rows that repeat a doc_id are judged each by itself; an empty benchmark leaves everything
clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, BASES, FOLDED_TABLES, carried, segments, shingle_hashes, utf8, with_carried, word_hashes, word_spans, working_on

WINDOW, SHINGLE = 10, 3
#: Windows of the benchmark that are sent to the tasks at a time.
BLOCK_WINDOWS = 200_000
#: Windows of a piece that a long item is cut into, so that no block holds more than its share and a few pieces.
PIECE_WINDOWS = 5000


def _words_of(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, at = word_spans(raw, offsets, ALNUM_WORDS)
    return starts, ends, at, word_hashes(raw, starts, ends, FOLDED_TABLES[0], BASES[0])


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at the places given, A-Z as a-z, with a space between them."""
    return b" ".join(raw[a:b].tobytes().lower() for a, b in zip(starts.tolist(), ends.tolist()))


class Windows:
    """One block of the benchmark: distinct windows with their words, the hashes of these, and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        starts, ends, at, one = _words_of(raw, offsets)
        rows: dict[bytes, list] = {}
        for k, (item, _) in enumerate(items):
            a, b = at[k], at[k + 1]
            for i in range(a, max(b - window, a) + 1) if b > a else ():
                j = min(i + window, b)
                rows.setdefault(_joined(raw, starts[i:j], ends[i:j]), [one[i:j], set()])[1].add(item)
        self.texts = list(rows)
        self.one = [r[0] for r in rows.values()]
        self.items = [sorted(r[1]) for r in rows.values()]
        #: Shingles of each window: of SHINGLE words, or of all words where it has fewer.
        self.shingles = [shingle_hashes(w, min(SHINGLE, len(w))) for w in self.one]
        self.known = np.unique(np.concatenate(self.shingles)) if rows else np.zeros(0, np.uint64)
        self.widths = sorted({min(SHINGLE, len(w)) for w in self.one})

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix, its rarest shingle (ties: by hash), and index windows by it."""
        picked = []
        for w, s in enumerate(self.shingles):
            place = min(range(len(s)), key=lambda i: (counts.get(int(s[i]), 0), int(s[i])))
            picked.append((int(s[place]), place, w))
        picked.sort()
        self.key = np.array([p[0] for p in picked], np.uint64)
        self.place = np.array([p[1] for p in picked], np.int64)
        self.window = np.array([p[2] for p in picked], np.int64)


def _document_shingles(block_widths: list[int], words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """width, shingle hashes and the word place of each, of shingles within one document."""
    for width in block_widths:
        h = shingle_hashes(words, width)
        if len(h):
            ends = np.repeat(at[1:], np.diff(at))[: len(h)]
            place = np.flatnonzero(np.arange(len(h)) + width <= ends)
            yield width, h[place], place


def _lookup(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` whose value is a key; a small bit table passes over most others cheaply."""
    bits = np.zeros(1 << 16, bool)
    bits[(sorted_keys >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
    i = np.minimum(np.searchsorted(sorted_keys, h[maybe]), len(sorted_keys) - 1)
    return maybe[sorted_keys[i] == h[maybe]]


def _count_shingles(docs: DataFrame, block: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    if not len(block.known):
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("decontamination")
        total = np.zeros(len(block.known), np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in segments(offsets):
                part, inner = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, at = word_spans(part, inner, ALNUM_WORDS)
                words = word_hashes(part, starts, ends, FOLDED_TABLES[0], BASES[0])
                for _, h, _ in _document_shingles(block.widths, words, at):
                    hit = _lookup(block.known, h)
                    total += np.bincount(np.searchsorted(block.known, h[hit]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.known[seen].astype(np.int64)), pa.array(total[seen])], ["shingle", "n"])

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(np.uint64(np.int64(r[0]).view(np.uint64))): r[1] for r in counted.collect()}  # at most the block's shingles


def _find(block: Windows, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
    """doc row, n_words, hit words and items of each document of a segment."""
    starts, ends, at, one = _words_of(raw, offsets)
    hit = np.zeros(len(one) + 1, np.int64)
    items: dict[int, set] = {}
    for width, h, place in _document_shingles(block.widths, one, at) if len(block.key) else ():
        for k in _lookup(block.key, h):
            p = int(place[k])
            d = int(np.searchsorted(at, p, "right")) - 1
            lo, hi = np.searchsorted(block.key, h[k], "left"), np.searchsorted(block.key, h[k], "right")
            for x in range(lo, hi):
                w = block.window[x]
                start, size = p - block.place[x], len(block.one[w])
                if min(SHINGLE, size) != width or start < at[d] or start + size > at[d + 1]:
                    continue  # positional and length bounds
                here = slice(start, start + size)
                if (one[here] == block.one[w]).all() and _joined(raw, starts[here], ends[here]) == block.texts[w]:
                    hit[start] += 1
                    hit[start + size] -= 1
                    items.setdefault(d, set()).update(block.items[w])
    marked = np.cumsum(hit[:-1]) > 0
    for d in range(len(offsets) - 1):
        yield d, int(at[d + 1] - at[d]), np.flatnonzero(marked[at[d] : at[d + 1]]), sorted(items.get(d, ()))


def _runs(places: np.ndarray) -> list[int]:
    """Runs of places as start, end, start, end ..."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.column_stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + 1]).ravel().tolist()


def block_count(bench: DataFrame, limit: int = BLOCK_WINDOWS) -> int:
    """Blocks of about ``limit`` windows, of which there are never more than words."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+"))
    n = bench.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    return max(1, -(-n // limit))


def blocks_of(bench: DataFrame, parts: int, window: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks, split by a hash of pieces of items: ``PIECE_WINDOWS`` windows at most."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9A-Za-z\\x80-\\x{10FFFF}]+)"), F.lit(1))
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WINDOWS))
    bench = bench.select("item", "words", F.explode(begins).alias("at")).select("item", F.array_join(F.slice("words", F.col("at") + 1, F.lit(PIECE_WINDOWS + window - 1)), " ").alias("text"))
    for k in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else bench
        yield [(r[0], r[1]) for r in rows.collect()]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limit: int = BLOCK_WINDOWS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words: start, end, ...) and items (sorted ids) of each row, and its columns ``carry`` as ``carried``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried(carry))
    parts = block_count(bench, limit)
    if parts > 1:
        return _merged(docs, bench, window, parts)
    lists = pa.list_(pa.int32()), pa.list_(pa.string())
    block = Windows(next(blocks_of(bench, 1, window)), window)
    block.order(_count_shingles(docs, block))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("decontamination")
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in segments(offsets):
                found = list(_find(block, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([f[1] for f in found], pa.int64()), pa.array([_runs(f[2]) for f in found], lists[0]), pa.array([f[3] for f in found], lists[1]), *[c.slice(a, b - a) for c in batch.columns[2:]]], ["doc_id", "n_words", "hits", "items", *batch.schema.names[2:]])

    return docs.mapInArrow(find, with_carried("doc_id long, n_words long, hits array<int>, items array<string>", docs))


def _merged(docs: DataFrame, bench: DataFrame, window: int, parts: int) -> DataFrame:
    """Several blocks: each pass adds its hits to the rows of the one before, so rows stay whole."""
    lists = pa.list_(pa.int32()), pa.list_(pa.string())
    df = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), *docs.columns[2:])
    for items in blocks_of(bench, parts, window):
        block = Windows(items, window)
        block.order(_count_shingles(docs, block))

        def add(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = utf8(batch.column(1))
                for a, b in segments(offsets):
                    hits, ids = batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a).to_pylist()
                    n = []
                    for d, n_words, places, found in _find(block, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        marked = np.zeros(n_words + 1, bool)
                        marked[places] = True
                        for s, e in zip(hits[d][::2], hits[d][1::2]):
                            marked[s:e] = True
                        hits[d], ids[d] = _runs(np.flatnonzero(marked)), sorted({*ids[d], *found})
                        n.append(n_words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.string()), pa.array(n, pa.int64()), pa.array(hits, lists[0]), pa.array(ids, lists[1]), *[c.slice(a, b - a) for c in batch.columns[5:]]], ["doc_id", "text", "n_words", "hits", "items", *batch.schema.names[5:]])

        df = df.mapInArrow(add, with_carried("doc_id long, text string, n_words long, hits array<int>, items array<string>", docs))
    return df.drop("text")


def decontamination_query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    hits = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return decontaminate(docs, bench).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM v) ON len(w) >= n)),
h AS (SELECT doc_id, i, x.n, item FROM x JOIN v ON x.g = v.g AND x.n = v.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def brute_force(docs: list[tuple], bench: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The query's rows by plain comparison, for tests."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows: dict[tuple, set] = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
