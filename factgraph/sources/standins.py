"""Fact tables as views over the star-schema test tables, so each operator has an SQL oracle.

``Facts(spark, dir)`` gives DataFrames; ``SQL`` has the same definitions in DuckDB, by name, with
what each builds on in ``NEEDS``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = "(for|and|or|que|und)"


class Facts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("string").alias("project_id"), F.col("n_name").alias("name"),
            F.concat(F.lit("/repo/"), "n_regionkey", F.lit("/"), "n_name", F.lit(".csproj")).alias("path"), F.lit(1).alias("snapshot_version"),
        )

    @cached_property
    def project_refs(self) -> DataFrame:
        df = self.table("lineitem").select("l_orderkey", "l_suppkey").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        df = df.where((F.col("o_custkey") * 7 + F.col("l_suppkey") * 3) % 11 == 0)
        df = df.join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        df = df.where((F.col("c_nationkey") != F.col("s_nationkey")) & ((F.col("c_nationkey") * 5 + F.col("s_nationkey")) % 4 == 0))
        return df.select(F.col("c_nationkey").cast("string").alias("src_project_id"), F.col("s_nationkey").cast("string").alias("dst_project_id")).distinct()

    @cached_property
    def symbols(self) -> DataFrame:
        """Types, one per part."""
        key = F.col("p_partkey")
        kind = F.when(F.col("p_size") % 6 == 0, "class").when(F.col("p_size") % 6 == 1, "interface").when(F.col("p_size") % 6 == 2, "struct").when(F.col("p_size") % 6 == 3, "enum").when(F.col("p_size") % 6 == 4, "record")
        access = F.when(key % 4 == 0, "public").when(key % 4 == 1, "internal").when(key % 4 == 2, "private").otherwise("protected")
        file = F.when(key % 11 == 0, F.concat(F.lit("/repo/obj/f"), key, F.lit(".cs"))).when(key % 11 == 1, F.concat(F.lit("/repo/src/f"), key % 97, F.lit(".g.cs"))).otherwise(F.concat(F.lit("/repo/src/f"), key % 97, F.lit(".cs")))
        return self.table("part").select(
            F.concat(F.lit("T:"), key).alias("symbol_id"), F.col("p_name").alias("name"), F.lit("NamedType").alias("kind"), kind.alias("type_kind"), F.lit(None).cast("string").alias("member_kind"),
            F.lit(None).cast("string").alias("containing_type_id"), F.lit(None).cast("string").alias("containing_type_fq"), F.col("p_brand").alias("containing_namespace"), access.alias("accessibility"),
            (F.col("p_size") % 2 == 0).alias("is_static"), F.lit(False).alias("is_implicit"), F.lit(False).alias("is_accessor"), (F.col("p_size") % 4).cast("int").alias("arity"), F.col("p_name").alias("display_min"),
            F.concat("p_brand", F.lit("."), "p_name").alias("display_fq"), F.concat("p_brand", F.lit("."), "p_name", F.lit("#"), key).alias("display_err"),
            (key % 25).cast("string").alias("project_id"), (key % 13 != 0).alias("in_source"), file.alias("file"), (key % 500 + 1).cast("int").alias("line"), F.lit(1).alias("col"),
            F.array().cast("array<string>").alias("param_types"), (F.col("p_size") % 3 == 0).alias("is_abstract"), F.lit(None).cast("string").alias("return_type"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Members, one per distinct line of an order for a part."""
        access = F.when(F.col("l_linenumber") % 3 == 0, "public").when(F.col("l_linenumber") % 3 == 1, "internal").otherwise("private")
        rows = self.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").distinct()
        return rows.select(
            F.concat(F.lit("M:"), "l_partkey", F.lit(":"), "l_orderkey", F.lit(":"), "l_linenumber", F.lit(":"), "l_returnflag", "l_linestatus").alias("symbol_id"), F.concat(F.lit("m"), "l_orderkey").alias("name"), F.lit("Member").alias("kind"),
            F.lit(None).cast("string").alias("type_kind"), F.when(F.col("l_returnflag") == "A", "method").when(F.col("l_returnflag") == "N", "property").otherwise("field").alias("member_kind"),
            F.concat(F.lit("T:"), "l_partkey").alias("containing_type_id"), F.concat(F.lit("ns.T"), "l_partkey").alias("containing_type_fq"), F.lit("ns").alias("containing_namespace"), access.alias("accessibility"),
            (F.col("l_linestatus") == "O").alias("is_static"), (F.col("l_linenumber") == 7).alias("is_implicit"), F.lit(False).alias("is_accessor"), F.concat(F.lit("m"), "l_orderkey", F.lit("/"), "l_linenumber").alias("display_min"),
            (F.col("l_partkey") % 25).cast("string").alias("project_id"), F.concat(F.lit("f"), F.col("l_partkey") % 97).alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.lit(1).alias("col"),
            F.array(F.concat(F.lit("p"), F.col("l_linenumber") % 2)).alias("param_types"),
            F.when(F.col("l_linenumber") % 3 == 0, "string").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("ns.T"), F.col("l_orderkey") % 7)).otherwise("List<int>").alias("return_type"),
        )

    @cached_property
    def impl_edges(self) -> DataFrame:
        """A line of an order is implemented by the next one."""
        ident = F.concat(F.lit("M:"), "l_partkey", F.lit(":"), "l_orderkey", F.lit(":"), "l_linenumber", F.lit(":"), "l_returnflag", "l_linestatus")
        rows = self.table("lineitem").select("l_orderkey", "l_linenumber", ident.alias("symbol_id")).distinct()
        following = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("symbol_id").alias("impl_id"))
        return rows.join(following, ["l_orderkey", "l_linenumber"]).select("symbol_id", "impl_id")

    @cached_property
    def nesting(self) -> DataFrame:
        """Types inside of types."""
        return self.table("part").where("p_partkey > 3").select(F.concat(F.lit("T:"), "p_partkey").alias("type_id"), F.concat(F.lit("T:"), F.expr("p_partkey div 4")).alias("parent_id"))

    @cached_property
    def refs(self) -> DataFrame:
        owner = self.table("supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("project_id"))
        df = self.table("lineitem").join(owner, F.col("l_suppkey") == F.col("s_suppkey"))
        file = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "/repo/a/S").otherwise("/repo/b/s"), F.floor(F.col("l_suppkey") / 2), F.lit(".cs"))
        return df.select(F.concat(F.lit("T:"), "l_partkey").alias("symbol_id"), file.alias("document_id"), "project_id", file.alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.lit(1).alias("col"))

    @cached_property
    def calls(self) -> DataFrame:
        """Successive lines of an order call each other."""
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        nxt = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("callee"))
        file = F.when(F.col("l_orderkey") % 9 == 0, F.concat(F.lit("/repo/obj/o"), "l_orderkey", F.lit(".cs"))).otherwise(F.concat(F.lit("/repo/o"), "l_orderkey", F.lit(".cs")))
        df = line.join(nxt, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") + 1 == F.col("n")))
        return df.select(F.concat(F.lit("T:"), "l_partkey").alias("from_id"), F.concat(F.lit("T:"), "callee").alias("to_id"), file.alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.lit(1).alias("col")).distinct()

    @cached_property
    def type_edges(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_size")
        base = part.where("p_partkey > 0").select(F.concat(F.lit("T:"), "p_partkey").alias("type_id"), F.concat(F.lit("T:"), F.expr("p_partkey div 3")).alias("parent_id"), F.lit("base").alias("edge_kind"))
        face = part.select(F.concat(F.lit("T:"), "p_partkey").alias("type_id"), F.concat(F.lit("I:"), F.col("p_size") % 5).alias("parent_id"), F.lit("interface").alias("edge_kind"))
        return base.unionByName(face)

    @cached_property
    def diagnostics(self) -> DataFrame:
        code = F.when(F.col("event_id") % 7 == 0, "CS0168").when(F.col("event_id") % 7 == 1, "CS0219").otherwise(F.col("event_type"))
        severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "warning").otherwise("hidden")
        return self.table("events").select(
            code.alias("code"), severity.alias("severity"), F.col("props").alias("message"), F.when(F.col("event_id") % 5 == 0, "Style").when(F.col("event_id") % 5 == 1, " ").otherwise(F.lit("Compiler")).alias("category"),
            F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").cast("int").alias("line"), (F.col("event_id") % 80 + 1).cast("int").alias("col"), F.col("event_id").cast("int").alias("span_start"),
            F.length("props").cast("int").alias("span_len"), (F.col("user_id") % 25).cast("string").alias("project_id"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        key = F.col("doc_id")
        path = (
            F.when(key % 5 == 0, F.concat(F.lit("/repo/obj/d"), key, F.lit(".cs"))).when(key % 5 == 1, F.concat(F.lit("C:\\repo\\bin\\d"), key, F.lit(".cs")))
            .when(key % 5 == 2, F.concat(F.lit("/repo/d"), key, F.lit(".Designer.cs"))).when(key % 5 == 3, F.concat(F.lit("/repo/d"), key, F.lit(".cs"))).otherwise(F.lit(" "))
        )
        return self.table("documents").select(F.concat(F.lit("D:"), key).alias("document_id"), path.alias("path"), "text")

    @cached_property
    def actions(self) -> DataFrame:
        n = F.col("event_id")
        origin = F.when(n % 3 == 0, "pack_codefix").when(n % 3 == 1, "pack_analyzer").otherwise("native")
        category = F.when(n % 4 == 0, "compiler").when(n % 4 == 1, "Style").when(n % 4 == 2, "").otherwise(F.lit("refactoring"))
        diagnostic = F.when(n % 5 == 0, "CS0168").when(n % 5 == 1, "CS0219").when(n % 5 == 2, "RCS1001")
        key = F.when(n % 10 == 9, "use_var_for_local").otherwise(F.concat(F.lit("k"), n % 10))
        return self.table("events").select(
            F.concat(F.lit("fix "), "event_type").alias("title"), category.alias("category"), origin.alias("origin"), key.alias("provider_key"), F.concat(F.lit("u"), "user_id").alias("file"),
            diagnostic.alias("diagnostic_id"), F.when(n % 5 == 3, "R1").alias("refactoring_id"), n.cast("int").alias("span_start"), (F.length("props") * 40).cast("int").alias("span_len"), n.cast("int").alias("line"), (n % 80 + 1).cast("int").alias("col"),
        )


#: The same facts in DuckDB.
SQL = {
    "projects": "SELECT CAST(n_nationkey AS VARCHAR) AS project_id, n_name AS name, '/repo/' || n_regionkey || '/' || n_name || '.csproj' AS path, 1 AS snapshot_version FROM nation",
    "project_refs": """SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS src_project_id, CAST(s_nationkey AS VARCHAR) AS dst_project_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE c_nationkey <> s_nationkey AND (o_custkey * 7 + l_suppkey * 3) % 11 = 0 AND (c_nationkey * 5 + s_nationkey) % 4 = 0""",
    "symbols": """SELECT 'T:' || p_partkey AS symbol_id, p_name AS name, 'NamedType' AS kind,
        CASE p_size % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'struct' WHEN 3 THEN 'enum' WHEN 4 THEN 'record' END AS type_kind,
        p_brand AS containing_namespace, CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'private' ELSE 'protected' END AS accessibility,
        p_size % 2 = 0 AS is_static, CAST(p_size % 4 AS INTEGER) AS arity, p_name AS display_min, p_brand || '.' || p_name AS display_fq, p_brand || '.' || p_name || '#' || p_partkey AS display_err,
        CAST(p_partkey % 25 AS VARCHAR) AS project_id, p_partkey % 13 <> 0 AS in_source, p_size % 3 = 0 AS is_abstract,
        CASE WHEN p_partkey % 11 = 0 THEN '/repo/obj/f' || p_partkey || '.cs' WHEN p_partkey % 11 = 1 THEN '/repo/src/f' || (p_partkey % 97) || '.g.cs' ELSE '/repo/src/f' || (p_partkey % 97) || '.cs' END AS file,
        CAST(p_partkey % 500 + 1 AS INTEGER) AS line, 1 AS col FROM part""",
    "members": """SELECT DISTINCT 'M:' || l_partkey || ':' || l_orderkey || ':' || l_linenumber || ':' || l_returnflag || l_linestatus AS symbol_id, 'm' || l_orderkey AS name,
        CASE l_returnflag WHEN 'A' THEN 'method' WHEN 'N' THEN 'property' ELSE 'field' END AS member_kind, 'T:' || l_partkey AS containing_type_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'private' END AS accessibility, l_linestatus = 'O' AS is_static, l_linenumber = 7 AS is_implicit,
        'm' || l_orderkey || '/' || l_linenumber AS display_min, 'p' || (l_linenumber % 2) AS shape, 'f' || (l_partkey % 97) AS file, CAST(l_linenumber AS INTEGER) AS line, 1 AS col,
        CASE l_linenumber % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'T' || (l_orderkey % 7) ELSE 'List' END AS type_name FROM lineitem""",
    "impl_edges": """SELECT DISTINCT 'M:' || a.l_partkey || ':' || a.l_orderkey || ':' || a.l_linenumber || ':' || a.l_returnflag || a.l_linestatus AS symbol_id,
        'M:' || b.l_partkey || ':' || b.l_orderkey || ':' || b.l_linenumber || ':' || b.l_returnflag || b.l_linestatus AS impl_id
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""",
    "nesting": "SELECT 'T:' || p_partkey AS type_id, 'T:' || (p_partkey // 4) AS parent_id FROM part WHERE p_partkey > 3",
    "refs": """SELECT 'T:' || l_partkey AS symbol_id, CAST(s_nationkey AS VARCHAR) AS project_id,
        (CASE WHEN l_suppkey % 2 = 0 THEN '/repo/a/S' ELSE '/repo/b/s' END) || (l_suppkey // 2) || '.cs' AS file, CAST(l_linenumber AS INTEGER) AS line, 1 AS col
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "calls": """SELECT DISTINCT 'T:' || a.l_partkey AS from_id, 'T:' || b.l_partkey AS to_id,
        CASE WHEN a.l_orderkey % 9 = 0 THEN '/repo/obj/o' || a.l_orderkey || '.cs' ELSE '/repo/o' || a.l_orderkey || '.cs' END AS file, CAST(a.l_linenumber AS INTEGER) AS line, 1 AS col
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""",
    "type_edges": """SELECT 'T:' || p_partkey AS type_id, 'T:' || (p_partkey // 3) AS parent_id, 'base' AS edge_kind FROM part WHERE p_partkey > 0
        UNION ALL SELECT 'T:' || p_partkey, 'I:' || (p_size % 5), 'interface' FROM part""",
    "diagnostics": """SELECT CASE event_id % 7 WHEN 0 THEN 'CS0168' WHEN 1 THEN 'CS0219' ELSE event_type END AS code,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, props AS message,
        CASE event_id % 5 WHEN 0 THEN 'Style' WHEN 1 THEN ' ' ELSE 'Compiler' END AS category, 'u' || user_id AS file, CAST(event_id AS INTEGER) AS line, CAST(event_id % 80 + 1 AS INTEGER) AS col,
        CAST(event_id AS INTEGER) AS span_start, CAST(length(props) AS INTEGER) AS span_len, CAST(user_id % 25 AS VARCHAR) AS project_id FROM events""",
    "docs": """SELECT 'D:' || doc_id AS document_id, text, CASE doc_id % 5 WHEN 0 THEN '/repo/obj/d' || doc_id || '.cs' WHEN 1 THEN 'C:\\repo\\bin\\d' || doc_id || '.cs'
        WHEN 2 THEN '/repo/d' || doc_id || '.Designer.cs' WHEN 3 THEN '/repo/d' || doc_id || '.cs' ELSE ' ' END AS path FROM documents""",
    "metrics": f"SELECT 'D:' || doc_id AS symbol_id, CAST(1 + len(regexp_extract_all(text, '{DECISIONS}')) AS INTEGER) AS complexity, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count FROM documents",
    "actions": """SELECT 'fix ' || event_type AS title, CASE event_id % 4 WHEN 0 THEN 'compiler' WHEN 1 THEN 'Style' WHEN 2 THEN '' ELSE 'refactoring' END AS category,
        CASE event_id % 3 WHEN 0 THEN 'pack_codefix' WHEN 1 THEN 'pack_analyzer' ELSE 'native' END AS origin,
        CASE WHEN event_id % 10 = 9 THEN 'use_var_for_local' ELSE 'k' || (event_id % 10) END AS provider_key, 'u' || user_id AS file,
        CASE event_id % 5 WHEN 0 THEN 'CS0168' WHEN 1 THEN 'CS0219' WHEN 2 THEN 'RCS1001' END AS diagnostic_id, CASE WHEN event_id % 5 = 3 THEN 'R1' END AS refactoring_id,
        CAST(event_id AS INTEGER) AS span_start, CAST(length(props) * 40 AS INTEGER) AS span_len, CAST(event_id AS INTEGER) AS line, CAST(event_id % 80 + 1 AS INTEGER) AS col FROM events""",
}


def sql_with(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the facts named, for DuckDB."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"f_{n} AS ({SQL[n]})" for n in names)
