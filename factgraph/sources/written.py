"""C# sources written from the star-schema tables, so the front end itself has an SQL oracle.

A project per nation holds an interface and a base class, of the same names in every project, and a class per
supplier, which refers to the class of the supplier before it.  The texts hold what a reader of lines would
trip over: block comments with declarations, comment marks in strings, parameters over two lines.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shapes import cut_lineage
from . import csharp, rules

SHARED = """namespace N{n}
{
    public interface IWork { int M0(int a); }
    public abstract class Node : IWork
    {
        public virtual int M0(int a) => a;
        protected int Shared(int a, int b) { return a + b; }
    }
}
"""
CLASS = """/* supplier {s} says "class Ghost { void Run() { Shared(1, 2); } }"
   over two lines */
using System;
namespace N{n};

public class S{s} : Node
{
    private readonly string label = "/* { not code";
    public string Name { get; set; }

    public override int M0(int a)
    {
        // if (ghost) { Shared(1, 2); }
        if (a > 1 && a < 9) { return Shared(a, {s}); }
        return a > 0 ? 1 : 2;
    }

    public int Call(S{t} other,
        int times)
    {
        int spare = {s};
        int Twice(int x) { return x > 2 ? x : x + x; }
        return other.M0(times) + this.M0(1) + new S{t}(2).GetHashCode();
    }

    public S{s}(int start) { }
{extra}
}
"""
#: A last member by the supplier's key modulo three: arms, labels, loops.
EXTRAS = (
    "    public int Extra0(int v) => v switch { 1 => 2, _ => 3 };",
    "    public int Extra1(int v) { switch (v) { case 1: return 1; case 2: return 2; default: return M0(v); } }",
    "    public int Extra2(int v) { for (int i = 0; i < v; i++) { while (v > i) { v--; } } return v; }",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, project_id, path, text, source_kind: one document per nation and one per supplier."""
    fill = lambda text, **values: reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(text))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("n"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("string").alias("n"))
    before = F.coalesce(F.lag("s").over(W.partitionBy("n").orderBy("s")), F.col("s"))
    suppliers = suppliers.withColumn("t", before.cast("string")).withColumn("extra", F.element_at(F.array(*map(F.lit, EXTRAS)), (F.col("s") % 3 + 1).cast("int"))).withColumn("s", F.col("s").cast("string"))
    path = lambda name: F.concat(F.lit("/src/N"), F.col("n"), F.lit("/"), name, F.lit(".cs"))
    shared = nation.select(path(F.lit("Node")).alias("path"), F.col("n").alias("project_id"), fill(SHARED, n=F.col("n")).alias("text"))
    own = suppliers.select(path(F.concat(F.lit("S"), "s")).alias("path"), F.col("n").alias("project_id"), fill(CLASS, n=F.col("n"), s=F.col("s"), t=F.col("t"), extra=F.col("extra")).alias("text"))
    rows = shared.unionByName(own)
    return rows.select(F.col("path").alias("document_id"), "project_id", "path", "text", F.lit("HandWritten").alias("source_kind"))


class Parsed:
    """Facts of the written sources, each step done when it is asked for; ``whole`` is for facts that need tokens."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = True):
        self.spark, self.dir, self.whole = spark, sf_dir, whole

    @cached_property
    def documents(self) -> DataFrame:
        return cut_lineage(documents(self.spark, self.dir))

    @cached_property
    def parsed(self) -> dict[str, DataFrame]:
        return csharp.parse(self.documents, self.whole)

    @cached_property
    def symbols(self) -> DataFrame:
        return cut_lineage(csharp.symbols(self.parsed["types"], self.parsed["members"]))

    @cached_property
    def usings(self) -> DataFrame:
        return csharp.usings(self.parsed["statements"])

    @cached_property
    def seen(self) -> DataFrame:
        none = self.spark.createDataFrame([], "src_project_id string, dst_project_id string")
        return cut_lineage(csharp.visible(none, self.documents))

    @cached_property
    def type_edges(self) -> DataFrame:
        return cut_lineage(csharp.type_edges(self.parsed["types"], self.usings, self.seen, self.parsed["types"]))

    @cached_property
    def above(self) -> DataFrame:
        return cut_lineage(csharp.closure(self.type_edges))

    @cached_property
    def impl_edges(self) -> DataFrame:
        return csharp.impl_edges(self.symbols, self.above)

    @cached_property
    def bound(self) -> DataFrame:
        return cut_lineage(csharp.bind(self.parsed, self.parsed["types"], self.parsed["members"], self.usings, self.seen, self.above))

    @cached_property
    def metrics(self) -> DataFrame:
        return csharp.metrics(self.parsed["tokens"], self.parsed["members"], self.parsed["functions"], self.parsed["statements"])

    @cached_property
    def diagnostics(self) -> DataFrame:
        return rules.run(self.parsed)[0]

    @cached_property
    def nodes(self) -> DataFrame:
        return csharp.nodes(*(self.parsed[k] for k in ("tokens", "statements", "types", "members", "functions")))
