"""Importance resampling towards a target distribution, over hashed runs of words.

A feature is a run of 1 to ``max_run`` words joined by one space; its bucket is the CRC-32 of its bytes
modulo ``buckets``.  A bucket's gain compares its share of the target with its share of the documents,
a document's weight is the floored mean of its features' gains, and Gumbel noise drawn from the
doc_id turns weights into a sample without replacement: the highest scores are drawn.

Head-tail vocabulary: each task keeps a bounded summary of its frequent words (and pairs, where runs
may have two words), the summaries are added up, and the most frequent ones are broadcast: words with
their CRC states, from which a run is continued, and pairs with their buckets.  Words are met by all
their bytes (16 at most, so two numbers), so the states are exact; anything else takes its CRC directly.
The head decides speed only; bucket totals are exact counts of all features of all documents.

Passes: summaries, bucket totals, weights (a row of a few numbers per document, written once).  Of the
drawn scores, a histogram gives the least one (a score is a whole number between -47,000 and 67,000
as gains and noise are logarithms of 64-bit and 32-bit numbers, so the histogram is bounded); rows at
or above it are sorted by range into files, and a row's rank is its place in its file plus the rows of
the files before, so no group of equal scores or ids meets in one task.

Defined results: a null text has no words; a document without features has weight 0 and isn't drawn
unless ``min_words`` is 0; a null doc_id hashes as the empty string and comes last among equal scores;
rows that repeat a doc_id are drawn each by itself, in an arbitrary but fixed order among rows that
agree on score and id; an empty table gives an empty result; an empty target has no counts (gains then
follow the documents alone); very long texts are taken in whole; other columns are ignored unless named
in ``carry``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, carried, materialize, mix, partitions_for, segments, shared_dir, utf8, with_carried, word_spans

BUCKETS, SEED = 10_000, 2024
MIN_WORDS, PERCENT, MAX_RUN = 20, 10, 1
#: Words and pairs of the head, and of a task's summary while it runs.
HEAD_WORDS, HEAD_PAIRS, SUMMARY = 4096, 4096, 16_384
#: Words of the head have this many bytes at most; longer words take their CRC directly.
HEAD_BYTES = 16
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def extend_crc(states: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what each state stands for, followed by the bytes [start, end) (one table step per byte, all words at once)."""
    out, sizes = states.astype(np.uint32), ends - starts
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(sizes <= LONG_WORD)
    short = short[np.argsort(-sizes[short], kind="stable")]
    c, at, n = ~out[short], starts[short], sizes[short]
    for j in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -j, "left"))  # words with more than j bytes stand first
        c[:k] = _CRC[(c[:k] ^ raw[at[:k] + j]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    out[short] = ~c
    return out


@dataclass
class Words:
    """The words of some texts: folded bytes, places, and each text's offsets in them."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> "Words":
        starts, ends, by_text = word_spans(raw, offsets, ALNUM_WORDS)
        return cls(np.concatenate([_FOLD[raw], np.zeros(HEAD_BYTES, np.uint8)]), starts, ends, by_text)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the next eight bytes of each word as numbers; no word has a zero byte, so padding is unique."""
        view = np.ndarray((len(self.raw) - 7,), "<u8", self.raw.tobytes(), strides=(1,))
        size = self.ends - self.starts
        return view[self.starts] & _MASKS[np.minimum(size, 8)], view[np.minimum(self.starts + 8, len(view) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]

    def runs(self, length: int) -> np.ndarray:
        """Places of the words that a run of ``length`` words of one text starts at."""
        owner_end = np.repeat(self.offsets[1:], np.diff(self.offsets))
        return np.flatnonzero(np.arange(len(self.starts)) + length <= owner_end)

    def text(self, first: int, last: int) -> bytes:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]].tobytes() for i in range(first, last + 1))


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first.astype(np.uint64) ^ mix(second.astype(np.uint64) + np.uint64(1)))


class Head:
    """Frequent words with their CRC states and frequent pairs with their CRCs, found by whole keys."""

    def __init__(self, words: Sequence[bytes] = (), pairs: Sequence[bytes] = ()):
        words = sorted(w for w in set(words) if 0 < len(w) <= HEAD_BYTES)
        self.number = {w: i for i, w in enumerate(words)}
        ordered = Words.of(np.frombuffer(b" ".join(words), np.uint8), np.array([0, sum(map(len, words)) + max(len(words) - 1, 0)]))
        self.first, self.second = ordered.keys()
        self.states = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.order = np.argsort(_slots(self.first, self.second), kind="stable")
        self.slots = _slots(self.first, self.second)[self.order]
        known = [(self.number[a] * len(words) + self.number[b], zlib.crc32(p)) for p in set(pairs) for a, _, b in [p.partition(b" ")] if a in self.number and b in self.number]
        self.pairs = np.array(sorted(known), np.int64).reshape(-1, 2)

    def find(self, words: Words) -> np.ndarray:
        """Each word's number in the head, or -1."""
        if not len(self.slots):
            return np.full(len(words.starts), -1)
        first, second = words.keys()
        place = self.order[np.minimum(np.searchsorted(self.slots, _slots(first, second)), len(self.slots) - 1)]
        same = (self.first[place] == first) & (self.second[place] == second) & (words.ends - words.starts <= HEAD_BYTES)
        return np.where(same, place, -1)

    def find_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair of head numbers in ``pairs``, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = np.where((left >= 0) & (right >= 0), left * len(self.states) + right, -1)
        row = np.minimum(np.searchsorted(self.pairs[:, 0], key), len(self.pairs) - 1)
        return np.where(self.pairs[row, 0] == key, row, -1)


def features(words: Words, head: Head, max_run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run: the words where runs start, and their buckets."""
    number = head.find(words)
    states = np.zeros(len(number), np.uint32)
    states[number >= 0] = head.states[number[number >= 0]]
    tail = np.flatnonzero(number < 0)
    states[tail] = extend_crc(states[tail], words.raw, words.starts[tail], words.ends[tail])
    single = np.arange(len(states))
    yield single, (states % np.uint32(buckets)).astype(np.int64)
    space = np.array([32], np.uint8)
    for length in range(2, max_run + 1):
        at = words.runs(length)
        last = at + length - 1
        grown = np.zeros(len(at), np.uint32)
        row = head.find_pairs(number[at], number[last]) if length == 2 else np.full(len(at), -1)
        grown[row >= 0] = head.pairs[row[row >= 0], 1]
        rest = np.flatnonzero(row < 0)
        spaced = extend_crc(states[at[rest]], space, np.zeros(len(rest), np.int64), np.ones(len(rest), np.int64))
        grown[rest] = extend_crc(spaced, words.raw, words.starts[last[rest]], words.ends[last[rest]])
        yield at, (grown % np.uint32(buckets)).astype(np.int64)
        states[at] = grown


def _summary(counts: dict, most: int) -> dict:
    """Misra and Gries: counts less the first one that there is no room for, so what is frequent stays."""
    if len(counts) <= most:
        return counts
    least = sorted(counts.values(), reverse=True)[most]
    return {w: n - least for w, n in counts.items() if n > least}


def head_of(docs: DataFrame, max_run: int, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The head of all documents; its size is bounded by the two limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = {}, {}
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in segments(offsets):
                words = Words.of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                short = np.flatnonzero(words.ends - words.starts <= HEAD_BYTES)
                first, second = words.keys()
                slot = _slots(first, second)
                _, where, n = np.unique(slot[short], return_index=True, return_counts=True)
                keep = np.argsort(-n, kind="stable")[:SUMMARY]
                for i, k in zip(short[where[keep]].tolist(), n[keep].tolist()):
                    w = words.text(i, i)
                    single[w] = single.get(w, 0) + k
                single = _summary(single, SUMMARY)
                if max_run > 1:
                    at = words.runs(2)
                    at = at[(words.ends[at] - words.starts[at] <= HEAD_BYTES) & (words.ends[at + 1] - words.starts[at + 1] <= HEAD_BYTES)]
                    _, where, n = np.unique(_slots(slot[at], slot[at + 1]), return_index=True, return_counts=True)
                    keep = np.argsort(-n, kind="stable")[:SUMMARY]
                    for i, k in zip(at[where[keep]].tolist(), n[keep].tolist()):
                        p = words.text(i, i + 1)
                        double[p] = double.get(p, 0) + k
                    double = _summary(double, SUMMARY)
        for size, found in ((1, single), (2, double)):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(found), pa.int32()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["size", "feature", "n"])

    counted = docs.select("text").mapInArrow(run, "size int, feature binary, n long").groupBy("size", "feature").agg(F.sum("n").alias("n"))
    most = lambda size, n: [bytes(r[0]) for r in counted.where(F.col("size") == size).orderBy(F.desc("n"), "feature").limit(n).select("feature").collect()]
    if max_run > 1:
        counted = materialize(counted, "head")
    return Head(most(1, n_words), most(2, n_pairs) if max_run > 1 else ())


def bucket_totals(docs: DataFrame, head: Head, max_run: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task gives a row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in segments(offsets):
                words = Words.of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for _, bucket in features(words, head, max_run, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row per bucket at most
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row (and what it carries)."""
    head = head_of(docs, max_run)
    gains = gains_of(bucket_totals(docs, head, max_run, buckets), bucket_totals(target, head, max_run, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            n_words, n, gain = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b in segments(offsets):
                words = Words.of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(a, b), np.diff(words.offsets))
                n_words[a:b] = np.diff(words.offsets)
                for at, bucket in features(words, head, max_run, buckets):
                    np.add.at(n, owner[at], 1)
                    np.add.at(gain, owner[at], gains[bucket])
            columns = [batch.column(0), pa.array(n_words), pa.array(n), pa.array(gain // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["doc_id", "n_words", "n_features", "weight", *batch.schema.names[2:]])

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried(carry))
    return shaped.mapInArrow(run, with_carried("doc_id long, n_words long, n_features long, weight long", shaped))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Every row with n_words, n_features, weight, score and rank (null if it isn't drawn), and what it carries.

    Of the rows with ``min_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    spark = docs.sparkSession
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    rows = materialize(weigh(docs, target, max_run, buckets, carry).withColumn("score", score.cast("long")), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    histogram = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()  # bounded, see above
    drawn = sum(r["n"] for r in histogram) * percent // 100
    passed, least = 0, None
    for r in histogram:
        if passed >= drawn:
            break
        passed, least = passed + r["n"], r["score"]
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    # equal scores and ids are told apart by where their row stands in the written table
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tie")]
    tied = rows.where(high).withColumn("_tie", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    path = shared_dir(spark, "ranked")
    tied.repartitionByRange(partitions_for(spark, passed * 64), *order).sortWithinPartitions(*order).drop("_tie").write.parquet(path)
    ranked = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before, places = 0, []
    for name, n in sorted(tuple(r) for r in ranked.groupBy("_file").count().collect()):  # a row per written file
        places.append((name, before))
        before += n
    rank = F.col("_before") + F.col("_row") + 1
    ranked = ranked.join(spark.createDataFrame(places, "_file string, _before long"), "_file").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select(*rows.columns, "rank").unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def importance_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def brute_force(docs: list[tuple], target: list[str | None], percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED) -> dict:
    """doc_id -> (n_features, weight, score, rank) by plain loops over (doc_id, text), for tests."""
    import hashlib
    import math
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def listed(text: str | None) -> tuple[int, list[int]]:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(fold))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]

    held = [(i, *listed(text)) for i, text in docs]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, _, found in held:
        np.add.at(s, found, 1)
    for text in target:
        np.add.at(t, listed(text)[1], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + buckets) / ((float(a) + 1) * (float(t.sum()) + buckets)))) for a, b in zip(s, t)]
    out, able = {}, []
    for i, n_words, found in held:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(found), weight, score, None)
        if n_words >= min_words:
            able.append((-score, i is None, i or 0, i))
    for rank, (*_, i) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[i] = (*out[i][:3], rank)
    return out


_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '{_WORD}')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_FOLDED}, '{_WORD}')) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
c AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT)),
      lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, k),
s AS (SELECT bucket, count(*)::DOUBLE AS n FROM d JOIN c USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*)::DOUBLE AS n FROM b JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN c USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM r WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * {PERCENT} // 100 THEN rank END AS rank FROM r LEFT JOIN e USING (doc_id)
"""
