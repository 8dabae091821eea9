"""Helpers that the corpus operators share: table reading, shared folders and numpy text arrays.

Text handling inside tasks is done on whole Arrow batches: a string column is one byte buffer
with offsets, so words, hashes and windows are numpy expressions over that buffer and no
Python loop runs per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task turns into numpy arrays at a time (a longer document is its own segment).
SEGMENT_BYTES = 1 << 20
WHITESPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (set here only in local mode, where the session has none)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("/tmp/factgraph-checkpoints")
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_freed(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` of a table whose shuffles nothing else reads: their files go once it is written, not when the driver's JVM collects them."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        path = shared_dir(spark, label)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a string column, for sizing partitions."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def partitions_for(spark: SparkSession, n_bytes: float, target: int = 24 << 20) -> int:
    """Partitions of about ``target`` bytes, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // target) + 1)


def _shares(counts: dict, total: int) -> dict:
    """Equal shares of ``total``, none above its count."""
    out = {}
    for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g))):
        out[g] = min(counts[g], (total - sum(out.values())) // (len(counts) - i))
    return out


def least_hashed(rows: DataFrame, max_rows: int, by: str | None = None) -> list[Row]:
    """At most ``max_rows`` rows in order of ``draw`` (a hash), those with the least ones over the whole table.

    With ``by``, its values (the ``max_rows`` most frequent ones) have equal shares, and what one
    can't fill goes to the others.  Rows of one value with the same draw count once.
    """
    group = F.col(by) if by else F.lit("")
    counts = {r[0]: r[1] for r in rows.groupBy(group.alias("g")).agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.desc("n"), "g").limit(max_rows).collect()}
    if not counts:
        return []
    below = lambda bounds: F.col("draw") <= F.try_element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), group)
    # draws alone of about twice the rows wanted, then the rows
    share = _shares(counts, max_rows)
    wide = {g: min(-(2**63) + (2**64 * (2 * share[g] + 50)) // max(n, 1), 2**63 - 1) for g, n in counts.items()}
    drawn: dict = {}
    for g, draw in rows.where(below(wide)).select(group, "draw").distinct().collect():
        drawn.setdefault(g, []).append(draw)
    share = _shares({g: len(x) for g, x in drawn.items()}, max_rows)
    bounds = {g: sorted(x)[k - 1] for (g, x), k in zip(drawn.items(), map(share.get, drawn)) if k}
    found = rows.where(below(bounds)).dropDuplicates([by, "draw"] if by else ["draw"]).collect() if bounds else []
    return sorted(found, key=lambda r: (r["draw"], r[by] if by else ""))[:max_rows]


_forget: dict[str, Callable[[], None]] = {}


def working_on(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Tells a Python worker which operator its task is of; ``forget`` empties that one's cache.

    Workers are used again by later tasks, so the caches of all other operators are emptied.
    """
    for other in [o for o in _forget if o != operator]:
        _forget.pop(other)()
    if forget is not None:
        _forget[operator] = forget


def carried(columns: Sequence[str]) -> list[Column]:
    """``columns`` as one struct that goes through an operator beside each row, if there are any."""
    return [F.struct(*columns).alias("carried")] if columns else []


def with_carried(schema: str, shaped: DataFrame) -> StructType:
    """``schema`` with the field of what ``shaped`` carries."""
    return StructType(StructType.fromDDL(schema).fields + [f for f in shaped.schema.fields if f.name == "carried"])


# --- numpy text arrays -------------------------------------------------------------------------


def _random_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
BYTE_TABLES = (_random_table(11), _random_table(12))
_fold = np.arange(256)
_fold[65:91] += 32
#: The same tables with A-Z hashed as a-z.
FOLDED_TABLES = tuple(t[_fold] for t in BYTE_TABLES)
SPACE_WORDS = np.array([b not in WHITESPACE for b in range(256)])
ALNUM_WORDS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(32))
    h *= MULTIPLIER
    h ^= h >> np.uint64(29)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(offsets: np.ndarray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents with at most ``limit`` bytes together, or one longer document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of each document's words in them."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]  # a word never crosses documents
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_table: np.ndarray, base: np.uint64) -> np.ndarray:
    """64-bit polynomial hashes of the words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), base, np.uint64))
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = byte_table[raw[place + np.repeat(starts, sizes)]] * powers[place]
    return mix(np.add.reduceat(values, first))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive word hashes; windows over document ends are included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * BASES[0] + words[j : j + n]
    return mix(h)
