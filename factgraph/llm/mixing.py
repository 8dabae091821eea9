"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic).  Raking multiplies the cell weights by
one factor per source, language and topic in turn until the weights' marginals are the targets.
Sampling probabilities follow: a document of a cell is taken with the probability that makes the
cell's expected tokens its share of the wanted total; where a cell would need more than it has, it
is taken whole and the rest is shared among the other cells, until the expected total is met.

A topic is the nearest centre of spherical k-means over hashed word counts of whole texts.  Word
counts are written once; each round assigns all documents and sums their vectors by topic, in whole
numbers, so the order of rows doesn't matter.  Only the first centres come from a sample: the
``TOPIC_DOCS`` documents with the least marks of the table.

Up to ``LOCAL_CELLS`` cells are raked on the driver; more are raked as DataFrames, each sweep
written to the shared folder.  Sampling takes a document by a hash of its id and text, so it repeats.

Defined results: null sources and languages are the category ``""``; a null or empty text has no
tokens and the topic -1, and is taken like the rest of its cell; rows that repeat are drawn alike; a
null doc_id is hashed as such; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, FOLDED_TABLES, SPACE_WORDS, least_hashed, materialize, segments, utf8, word_hashes, word_spans, working_on

DIMENSIONS = ("source", "lang", "topic")
TOPICS, TOPIC_DOCS, TOPIC_BUCKETS = 8, 1000, 1 << 12
#: Targets without a table of their own: shares to the power given, so that large categories shrink.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.5}
SWEEPS, TOLERANCE = 12, 1e-4
#: Cells that are raked on the driver, at most.
LOCAL_CELLS = 100_000
#: The wanted tokens as a share of all.
KEEP = 0.8


def _bag(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each document's entries, their buckets and root word counts scaled to unit length; words of each document."""
    starts, ends, at = word_spans(raw, offsets, SPACE_WORDS)
    bucket = (word_hashes(raw, starts, ends, FOLDED_TABLES[0], BASES[0]) >> np.uint64(64 - TOPIC_BUCKETS.bit_length() + 1)).astype(np.int64)
    n = len(offsets) - 1
    counts = np.bincount(np.repeat(np.arange(n), np.diff(at)) * TOPIC_BUCKETS + bucket, minlength=n * TOPIC_BUCKETS)
    cells = np.flatnonzero(counts)
    words = np.diff(at)
    doc = cells // TOPIC_BUCKETS
    return np.searchsorted(doc, np.arange(n + 1)), cells % TOPIC_BUCKETS, np.sqrt(counts[cells] / words[doc]), words


def with_bags(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, mark, n_tokens and the word counts (buckets and values) of each row."""
    schema = "doc_id long, source string, lang string, mark long, n_tokens long, buckets binary, scaled binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("mixing")
        for batch in batches:
            raw, offsets = utf8(batch.column(4))
            for a, b in segments(offsets, 1 << 20):
                for x in range(a, b, 256):
                    y = min(x + 256, b)
                    at, buckets, scaled, words = _bag(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    packed = [pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer((at * v.itemsize).astype(np.int32)), pa.py_buffer(v)]) for v in (buckets.astype(np.uint16), scaled.astype(np.float32))]
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(x, y - x) for i in range(4)] + [pa.array(words.astype(np.int64)), *packed], ["doc_id", "source", "lang", "mark", "n_tokens", "buckets", "scaled"])

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), category("source").alias("source"), category("lang").alias("lang"), mark().alias("mark"), "text")
    return shaped.mapInArrow(run, schema)


def _entries(buckets: pa.Array, scaled: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of all entries of a batch."""
    sizes = np.array(pc.binary_length(buckets).to_numpy(zero_copy_only=False), np.int64) // 2
    flat = [np.frombuffer(b"".join(c.to_pylist()), t) for c, t in ((buckets, np.uint16), (scaled, np.float32))]
    return np.repeat(np.arange(len(sizes)), sizes), flat[0].astype(np.int64), flat[1].astype(np.float64)


def _nearest(entries: tuple, n: int, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each of ``n`` documents."""
    doc, bucket, value = entries
    return np.argmax(np.stack([np.bincount(doc, c[bucket] * value, n) for c in centres], 1), axis=1)


def first_centres(bags: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of ``bags`` spread out by distance."""
    rng = np.random.default_rng(seed)
    centres = [bags[int(rng.integers(len(bags)))]]
    while len(centres) < min(k, len(bags)):
        nearest = np.max(bags @ np.array(centres).T, axis=1)
        centres.append(bags[int(np.argmin(nearest + rng.uniform(0, 0.05, len(bags))))])
    return np.array(centres, np.float64)


def train_topics(bags: DataFrame, k: int = TOPICS, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of spherical k-means over all rows of ``bags`` that have words."""
    bags = bags.where("n_tokens > 0")
    sample = least_hashed(bags.select("buckets", "scaled", F.col("mark").alias("draw")), TOPIC_DOCS)
    if not sample:
        return np.zeros((1, TOPIC_BUCKETS))
    dense = np.zeros((len(sample), TOPIC_BUCKETS), np.float32)
    for row, r in zip(dense, sample):
        row[np.frombuffer(bytes(r["buckets"]), np.uint16)] = np.frombuffer(bytes(r["scaled"]), np.float32)
    centres = first_centres(dense, k, seed)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros(centres.size)
            for batch in batches:
                doc, bucket, value = entries = _entries(batch.column(0), batch.column(1))
                near = _nearest(entries, batch.num_rows, centres)
                # whole numbers, of which doubles hold sums up to 2**53
                total += np.bincount(near[doc] * TOPIC_BUCKETS + bucket, np.rint(value * (1 << 20)), len(total))
            made = total.astype(np.int64).reshape(centres.shape)
            some = np.flatnonzero(made.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([made[i].tobytes() for i in some], pa.binary())], ["topic", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for topic, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total[topic] = total.get(topic, 0) + np.frombuffer(part, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["topic", "sums"])

        before, centres = centres, centres.copy()
        for r in bags.select("buckets", "scaled").mapInArrow(sums, "topic int, sums binary").repartition(k, "topic").mapInArrow(added, "topic int, sums binary").collect():
            v = np.frombuffer(bytes(r["sums"]), np.int64).astype(np.float64)
            centres[r["topic"]] = v / np.linalg.norm(v)
        if np.array_equal(before, centres):
            break
    return centres


def category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mark() -> Column:
    """The hash of a row that decides its draw."""
    return F.xxhash64(F.lit(17), "doc_id", "text")


def with_topics(bags: DataFrame, centres: np.ndarray) -> DataFrame:
    """doc_id, source, lang, mark (hash that decides the draw), n_tokens and topic of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_entries(batch.column(5), batch.column(6)), batch.num_rows, centres)
            topic = np.where(batch.column(4).to_numpy() > 0, near, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(topic)], ["doc_id", "source", "lang", "mark", "n_tokens", "topic"])

    return bags.mapInArrow(run, "doc_id long, source string, lang string, mark long, n_tokens long, topic int")


def default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """For each dimension a table (category, target share), flattened from the shares there are."""
    out = {}
    for dim in DIMENSIONS:
        share = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").select(dim, F.pow("t", F.lit(FLATTEN[dim])).alias("w"))
        total = share.agg(F.sum("w")).first()[0] or 1.0
        out[dim] = share.select(dim, (F.col("w") / F.lit(total)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, whose marginals are the targets, and ``gap``.

    The gap is the most by which a marginal is off its target after the last sweep: at most
    ``tolerance``, unless the sweeps ended first or the targets contradict each other.

    A target for a category without tokens can't be met and is left out; the others keep their
    proportions.  A category without a target gets the weight 0.
    """
    weights = cells.where("tokens > 0").select(*DIMENSIONS, "tokens", F.col("tokens").cast("double").alias("weight"))
    if weights.limit(local_cells + 1).count() <= local_cells:
        return _rake_on_driver(weights, targets, sweeps, tolerance)
    tables = {dim: materialize(t, "target") for dim, t in targets.items()}
    worst = 0.0
    for _ in range(sweeps):
        for dim, target in tables.items():
            sums = weights.groupBy(dim).agg(F.sum("weight").alias("sum"))
            factor = target.join(sums.where("sum > 0"), dim).select(dim, (F.col("target") / F.col("sum")).alias("factor"))
            weights = weights.join(factor, dim, "left").select(*DIMENSIONS, "tokens", (F.col("weight") * F.coalesce("factor", F.lit(0.0))).alias("weight"))
        weights = materialize(weights, "raked")
        worst = 0.0
        for dim, target in tables.items():
            off = weights.groupBy(dim).agg(F.sum("weight").alias("sum")).join(target, dim).agg(F.max(F.abs(F.col("sum") - F.col("target")))).first()[0]
            worst = max(worst, off or 0.0)
        if worst <= tolerance:
            break
    return weights.withColumn("gap", F.lit(worst))


def _rake_on_driver(weights: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """The same for a bounded number of cells, whose categories bound the targets that matter."""
    rows = weights.collect()
    weight = np.array([r["weight"] for r in rows], float)
    codes, wanted = {}, {}
    for dim in DIMENSIONS:
        names = sorted({r[dim] for r in rows})
        place = {name: i for i, name in enumerate(names)}
        codes[dim] = np.array([place[r[dim]] for r in rows], np.int64)
        share = targets[dim].join(weights.select(dim).distinct(), dim, "left_semi").collect()
        wanted[dim] = np.zeros(len(names))
        for r in share:
            wanted[dim][place[r[dim]]] = r["target"]
    gap = 0.0
    for _ in range(sweeps if rows else 0):
        for dim in targets:
            sums = np.bincount(codes[dim], weight, len(wanted[dim]))
            weight *= np.divide(wanted[dim], sums, out=np.zeros_like(sums), where=sums > 0)[codes[dim]]
        gap = float(max(np.abs(np.bincount(codes[dim], weight, len(wanted[dim])) - wanted[dim]).max() for dim in targets))
        if gap <= tolerance:
            break
    made = [(*[r[dim] for dim in DIMENSIONS], r["tokens"], float(w)) for r, w in zip(rows, weight)]
    return weights.sparkSession.createDataFrame(made, weights.schema).withColumn("gap", F.lit(gap))


def calibrate(weights: DataFrame, wanted: float) -> DataFrame:
    """``weights`` with ``probability``: least of 1 and scale * weight / tokens, expecting ``wanted`` tokens.

    The scale is found by fixing cells that are taken whole: each round is one aggregation.
    """
    rate = F.col("weight") / F.col("tokens")
    scale, before = 0.0, -1.0
    for _ in range(50):
        whole = rate * F.lit(scale) >= 1
        row = weights.agg(F.sum(F.when(whole, F.col("tokens"))).alias("full"), F.sum(F.when(~whole, F.col("weight"))).alias("rest")).first()
        full, rest = row["full"] or 0, row["rest"] or 0.0
        if rest <= 0 or full >= wanted:
            break
        before, scale = scale, (wanted - full) / rest
        if scale <= before * (1 + 1e-12):
            break
    return weights.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * rate))


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, centres: np.ndarray | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, mark, probability, selected and gap (see ``rake``; null without tokens) of each row."""
    bags = materialize(with_bags(docs), "bags")
    if centres is None:
        centres = train_topics(bags)
    rows = materialize(with_topics(bags, centres), "topics")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    wanted = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    raked = materialize(rake(cells, targets or default_targets(cells)), "raked")
    chances = calibrate(raked, wanted).select(*DIMENSIONS, "probability", "gap")
    draw = F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))
    out = rows.join(chances, list(DIMENSIONS), "left")
    # cells without tokens have no weight: they cost nothing and stay
    probability = F.coalesce("probability", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.lit(0.0)))
    out = out.withColumn("probability", probability)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "mark", "probability", (draw < F.col("probability")).alias("selected"), "gap")
