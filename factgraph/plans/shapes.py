"""Plan pieces that the operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Nodes of a traversal step that are kept on the driver, at most.
LOCAL_NODES = 1000
#: Characters of text in a task.
PIECE = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share (chosen here only in local mode)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/factgraph-checkpoints"
    return f"{base.rstrip('/')}/facts-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it survives lost executors, and later reads take only the columns they need."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ``key`` to tasks of ``PIECE`` characters of ``text`` each, about, but to no more than keep all cores busy.

    Costly work on texts follows the number of files otherwise, and small texts fill only one.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.length(text))).first()[0] or 0
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(-(-size // PIECE), most)), key)


def keep_first(df: DataFrame, key: list, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``: an aggregation, so it combines before the shuffle."""
    names = df.columns
    least = F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*names).alias("row"))).alias("_least")
    keys = [k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    return df.groupBy(*keys).agg(least).select("_least.row.*")


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in total order with ``pos``, counted over the page's rows alone."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("pos", (F.row_number().over(W.orderBy(*order)) + offset).cast("int"))


def reach(edges: DataFrame, roots: DataFrame, depth: int | None, local: int = LOCAL_NODES) -> DataFrame:
    """Nodes within ``depth`` steps of ``roots`` (id), with their least distance.

    ``edges`` is (src, dst).  While the newest nodes are few (``local`` at most, checked), each hop
    is a filter on their ids, which prunes sorted edge files and shuffles no edges.  Beyond that
    each hop joins only the newest nodes and writes them, so the lineage stays one join long.  Nodes
    seen before are left out either way, so cycles end.
    """
    spark = edges.sparkSession
    few = lambda df, name: [r[0] for r in df.where(F.col(name).isNotNull()).select(name).distinct().limit(local + 1).collect()]
    known: dict = {}
    newest, hop = few(roots, "id"), 0
    while len(newest) <= local and len(known) <= 4 * local:
        known.update((n, hop) for n in newest)
        if not newest or hop == depth:
            return _nodes(spark, known, roots)
        newest, hop = [n for n in few(edges.where(F.col("src").isin(newest)), "dst") if n not in known], hop + 1
    # many nodes: the same hop again as a join
    hop -= 1
    if hop < 0:
        frontier = seen = cut_lineage(roots.select("id").distinct().withColumn("distance", F.lit(0)))
        hop = 0
    else:
        seen = cut_lineage(_nodes(spark, known, roots))
        frontier = seen.where(F.col("distance") == hop)
    while depth is None or hop < depth:
        hop += 1
        found = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(found.join(seen, "id", "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _nodes(spark: SparkSession, known: dict, roots: DataFrame) -> DataFrame:
    """A bounded set of nodes as a local table."""
    table = pa.table({"id": pa.array(list(known), pa.string()), "distance": pa.array(list(known.values()), pa.int32())})
    return spark.createDataFrame(table).select(F.col("id").cast(roots.schema["id"].dataType).alias("id"), "distance")


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, length: str, block: int = 1024, levels: int = 4, fan: int = 64) -> DataFrame:
    """Rows of points and spans of equal ``key`` where the half-open span holds the point.

    Both are dealt by key and block of places, so a key with very many spans is many join keys.  Blocks
    have ``levels`` sizes, each ``fan`` times the one before: a span stands in the few blocks of the first size of
    which it touches at most ``fan`` (the last size has no such bound), a point in one block of each
    size, so no pair is found twice and no span is spread over many blocks.
    """
    last = F.col(start) + F.greatest(F.col(length), F.lit(1)) - 1
    sizes = [block * fan**k for k in range(levels)]
    touched = lambda size: F.floor(last / size) - F.floor(F.col(start) / size) + 1
    level = F.coalesce(*[F.when(touched(size) <= fan, k) for k, size in enumerate(sizes[:-1])], F.lit(levels - 1))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("_level") + 1)
    spread = spans.withColumn("_level", level).withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(last / size))))
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(levels)]))).withColumn("_block", F.floor(F.col(at) / size))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))
    return dealt.join(spread, [key, "_level", "_block"]).where(inside).drop("_level", "_block")


def single_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
