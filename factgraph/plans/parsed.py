"""Queries that drive the C# front end over sources written from the tables, each with its SQL over the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import callgraph, hierarchy, listing, metrics, refactoring, references, rewrite, smells
from ..sources import csharp
from ..sources.written import Parsed
from .registry import ORACLE_SQL, QUERIES


def query(sql: str, whole: bool = True):
    """Registers a query with its SQL; ``whole`` is False for those that need declarations alone, and no tokens."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Parsed(spark, sf_dir, whole))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Suppliers with their nation and the supplier before (s, n, t), and nations (n).
_S = "WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, coalesce(lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), s_suppkey) AS t FROM supplier), w AS (SELECT n_nationkey AS n FROM nation)"
_T, _N = "'N' || n || '.S' || s", "'N' || n || '.Node'"


def _members(*rows: tuple) -> str:
    """Member rows (name, arguments, kind, access, line, end, column) of suppliers' classes."""
    return " UNION ALL ".join(f"SELECT 'M:' || {_T} || '.' || {shown} AS symbol_id, {name} AS name, '{kind}' AS kind, '{access}' AS accessibility, {line} AS line, {end} AS end_line, {col} AS col FROM s{where}" for name, shown, kind, access, line, end, col, where in rows)


@query(f"""{_S}, m AS ({_members(
    ("'label'", "'label'", "field", "private", 8, 8, 29, ""), ("'Name'", "'Name'", "property", "public", 9, 9, 19, ""), ("'M0'", "'M0(int)'", "method", "public", 11, 16, 25, ""),
    ("'Call'", "'Call(S' || t || ', int)'", "method", "public", 18, 24, 16, ""), ("'S' || s", "'S' || s || '(int)'", "ctor", "public", 26, 26, 12, ""), ("'Extra' || s % 3", "'Extra' || s % 3 || '(int)'", "method", "public", 27, 27, 16, ""))}
UNION ALL SELECT 'T:' || {_T}, 'S' || s, 'class', 'public', 6, 28, 14 FROM s
UNION ALL SELECT 'T:N' || n || '.IWork', 'IWork', 'interface', 'public', 3, 3, 22 FROM w UNION ALL SELECT 'M:N' || n || '.IWork.M0(int)', 'M0', 'method', 'public', 3, 3, 34 FROM w
UNION ALL SELECT 'T:' || {_N}, 'Node', 'class', 'public', 4, 8, 27 FROM w UNION ALL SELECT 'M:' || {_N} || '.M0(int)', 'M0', 'method', 'public', 6, 6, 28 FROM w
UNION ALL SELECT 'M:' || {_N} || '.Shared(int, int)', 'Shared', 'method', 'protected', 7, 7, 23 FROM w)
SELECT symbol_id, name, kind, accessibility, line::INT AS line, end_line::INT AS end_line, col::INT AS col FROM m""", whole=False)
def parsed_symbols(p: Parsed) -> DataFrame:
    return p.symbols.select("symbol_id", "name", F.coalesce("type_kind", "member_kind").alias("kind"), "accessibility", "line", "end_line", "col")


@query(f"""{_S} SELECT 'T:' || {_T} AS type_id, 'T:' || {_N} AS parent_id, 'base' AS edge_kind FROM s
UNION ALL SELECT 'T:' || {_N}, 'T:N' || n || '.IWork', 'interface' FROM w""", whole=False)
def parsed_type_edges(p: Parsed) -> DataFrame:
    return p.type_edges.select("type_id", "parent_id", "edge_kind")


@query(f"""{_S} SELECT 'M:N' || n || '.IWork.M0(int)' AS symbol_id, 'M:' || {_T} || '.M0(int)' AS impl_id FROM s UNION ALL SELECT 'M:N' || n || '.IWork.M0(int)', 'M:' || {_N} || '.M0(int)' FROM w""", whole=False)
def parsed_impl_edges(p: Parsed) -> DataFrame:
    return p.impl_edges


_CALLS = f"""SELECT 'M:' || {_T} || '.M0(int)' AS from_id, 'M:' || {_N} || '.Shared(int, int)' AS to_id, '/src/N' || n || '/S' || s || '.cs' AS file, 14 AS line, 38 AS col FROM s
UNION ALL SELECT 'M:' || {_T} || '.Call(S' || t || ', int)', 'M:N' || n || '.S' || t || '.M0(int)', '/src/N' || n || '/S' || s || '.cs', 23, 22 FROM s
UNION ALL SELECT 'M:' || {_T} || '.Call(S' || t || ', int)', 'M:' || {_T} || '.M0(int)', '/src/N' || n || '/S' || s || '.cs', 23, 39 FROM s
UNION ALL SELECT 'M:' || {_T} || '.Call(S' || t || ', int)', 'M:N' || n || '.S' || t || '.S' || t || '(int)', '/src/N' || n || '/S' || s || '.cs', 23, 51 FROM s
UNION ALL SELECT 'M:' || {_T} || '.Extra1(int)', 'M:' || {_T} || '.M0(int)', '/src/N' || n || '/S' || s || '.cs', 27, 97 FROM s WHERE s % 3 = 1"""


@query(f"{_S}, c AS ({_CALLS}) SELECT from_id, to_id, file, line::INT AS line, col::INT AS col FROM c")
def parsed_calls(p: Parsed) -> DataFrame:
    return csharp.calls(p.bound).select("from_id", "to_id", "file", "line", "col")


@query(f"""{_S}, r AS (SELECT to_id AS symbol_id, file, line, col FROM ({_CALLS})
UNION ALL SELECT 'T:' || {_N}, '/src/N' || n || '/S' || s || '.cs', 6, 14 + length('S' || s) + 3 FROM s UNION ALL SELECT 'T:N' || n || '.S' || t, '/src/N' || n || '/S' || s || '.cs', 18, 21 FROM s
UNION ALL SELECT 'T:N' || n || '.S' || t, '/src/N' || n || '/S' || s || '.cs', 23, 51 FROM s UNION ALL SELECT 'T:N' || n || '.IWork', '/src/N' || n || '/Node.cs', 4, 34 FROM w)
SELECT symbol_id, file, line::INT AS line, col::INT AS col FROM r""")
def parsed_references(p: Parsed) -> DataFrame:
    return csharp.refs(p.bound).select("symbol_id", "file", "line", "col")


@query(f"""{_S}, m AS (SELECT 'M:' || {_T} || '.M0(int)' AS symbol_id, 4 AS complexity, 6 AS line_count FROM s UNION ALL SELECT 'M:' || {_T} || '.Call(S' || t || ', int)', 2, 7 FROM s
UNION ALL SELECT 'M:' || {_T} || '.Call(S' || t || ', int)/Twice(int)', 2, 1 FROM s UNION ALL SELECT 'M:' || {_T} || '.S' || s || '(int)', 1, 1 FROM s
UNION ALL SELECT 'M:' || {_T} || '.Extra' || s % 3 || '(int)', CASE s % 3 WHEN 1 THEN 4 ELSE 3 END, 1 FROM s
UNION ALL SELECT 'M:N' || n || '.IWork.M0(int)', NULL, 1 FROM w UNION ALL SELECT 'M:' || {_N} || '.M0(int)', 1, 1 FROM w UNION ALL SELECT 'M:' || {_N} || '.Shared(int, int)', 1, 1 FROM w)
SELECT symbol_id, complexity::INT AS complexity, line_count::INT AS line_count FROM m""")
def parsed_metrics(p: Parsed) -> DataFrame:
    return p.metrics


@query(f"""{_S} SELECT 'CS0219' AS code, 'warning' AS severity, '/src/N' || n || '/S' || s || '.cs' AS file, 21::INT AS line, 13::INT AS col, 5::INT AS span_len FROM s""")
def parsed_diagnostics(p: Parsed) -> DataFrame:
    return p.diagnostics.select("code", "severity", "file", "line", "col", "span_len")


@query(f"""{_S}, k AS (SELECT unnest(['class', 'field', 'property', 'ctor', 'if', 'conditional', 'local']) AS node_kind, unnest([1, 1, 1, 1, 1, 2, 1]) AS per FROM range(1)),
c AS (SELECT node_kind, per * (SELECT count(*) FROM s) + CASE node_kind WHEN 'class' THEN (SELECT count(*) FROM w) ELSE 0 END AS n FROM k
UNION ALL SELECT 'method', 3 * (SELECT count(*) FROM s) + 3 * (SELECT count(*) FROM w) UNION ALL SELECT 'interface', (SELECT count(*) FROM w) UNION ALL SELECT 'local_function', (SELECT count(*) FROM s)
UNION ALL SELECT 'return', (SELECT sum(CASE s % 3 WHEN 1 THEN 7 WHEN 2 THEN 5 ELSE 4 END) FROM s) + (SELECT count(*) FROM w) UNION ALL SELECT 'creation', (SELECT count(*) FROM s)
UNION ALL SELECT 'case', (SELECT 2 * count(*) FROM s WHERE s % 3 = 1) UNION ALL SELECT 'default', (SELECT count(*) FROM s WHERE s % 3 = 1) UNION ALL SELECT 'while', (SELECT count(*) FROM s WHERE s % 3 = 2))
SELECT node_kind, n::BIGINT AS n FROM c WHERE n > 0""")
def parsed_nodes(p: Parsed) -> DataFrame:
    shown = ("class", "interface", "field", "property", "ctor", "method", "local_function", "if", "conditional", "local", "return", "creation", "case", "default", "while")
    return p.nodes.where(F.col("node_kind").isin(*shown)).groupBy("node_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_S}, r AS (SELECT n, s FROM s WHERE s = (SELECT min(s) FROM s)), x AS (SELECT '/src/N' || n || '/S' || s.s || '.cs' AS path,
(CASE WHEN s.s = r.s THEN 1 ELSE 0 END) + (CASE WHEN s.t = r.s THEN 2 ELSE 0 END) AS edits FROM s JOIN r USING (n)) SELECT path, edits::INT AS edit_count FROM x WHERE edits > 0""")
def parsed_rename(p: Parsed) -> DataFrame:
    """What changes when the class of the first supplier gets a new name: its declaration, and a parameter's type and a creation elsewhere."""
    first = p.symbols.where("type_kind = 'class' and name like 'S%'").agg(F.min_by("symbol_id", F.substring("name", 2, 20).cast("long"))).first()[0]
    places = rewrite.affected(p.symbols, csharp.refs(p.bound), first)
    after = rewrite.apply_edits(p.documents, rewrite.rename_edits(places, first.rpartition(".")[2], "Renamed"))
    return rewrite.changed_files(p.documents, after)


@query(f"""{_S} SELECT '/src/N' || n || '/S' || s || '.cs' AS path, sha256('int spare = ' || s || ';') AS taken FROM s""")
def parsed_cleanup(p: Parsed) -> DataFrame:
    """Files with an unused local, and the hash of the statement that its fix takes out."""
    edits = refactoring.unused_local_edits(p.parsed["statements"], p.diagnostics)
    whole = p.documents.select("path", "text").join(edits, "path")
    line = F.element_at(F.split("text", "\n"), F.col("line"))
    return whole.select("path", F.sha2(line.substr(F.col("col"), F.col("length")), 256).alias("taken"))


@query(f"""{_S}, e AS (SELECT '/src/N' || n || '/S' || s || '.cs' AS file, s, t FROM s) SELECT 'N' || n || '.S' || s || '.Call(S' || t || ', int)' AS display_fq FROM s WHERE t = (SELECT min(s) FROM s)""")
def parsed_callers(p: Parsed) -> DataFrame:
    """Methods that call M0 of the first supplier's class from outside of it, or from its own Call."""
    first = p.symbols.where("type_kind = 'class' and name like 'S%'").agg(F.min_by("symbol_id", F.substring("name", 2, 20).cast("long"))).first()[0]
    target = f"M:{first[2:]}.M0(int)"
    found = callgraph.trace(csharp.calls(p.bound), target, "upstream", 1).where("from_id like '%.Call(%'").select(F.col("from_id").alias("symbol_id")).distinct()
    return p.symbols.join(found, "symbol_id", "left_semi").select("display_fq")


@query(f"""{_S} SELECT 'T:' || {_T} AS symbol_id FROM s WHERE n = 1 UNION ALL SELECT 'T:N1.Node'""", whole=False)
def parsed_implementations(p: Parsed) -> DataFrame:
    return hierarchy.implementations(p.type_edges, p.impl_edges, p.symbols, "T:N1.IWork").select("symbol_id")


#: The first supplier.
_FIRST = "(SELECT min(s) FROM s)"


@query(f"""{_S} SELECT '/src/N' || n || '/S' || s || '.cs' AS file, (CASE WHEN s % 2 = 0 THEN 22 ELSE 21 END)::INT AS new_line, (CASE WHEN s % 2 = 0 THEN 9 ELSE 0 END)::INT AS moved FROM s WHERE s % 3 <> 1""")
def parsed_carried_spans(p: Parsed) -> DataFrame:
    """Places of unused locals in the next version: every second file has a line above, and every third another name on the line itself."""
    key = F.regexp_extract("path", "S(\\d+)\\.cs$", 1)
    number = F.when(key != "", key.cast("long"))
    text = F.when(number % 3 == 1, F.replace("text", F.lit("int spare ="), F.lit("int other ="))).otherwise(F.col("text"))
    after = p.documents.withColumn("text", F.when(number % 2 == 0, F.concat(F.lit("// moved\n"), text)).otherwise(text))
    spans = p.diagnostics.select("file", "line", "span_start", "span_len")
    return rewrite.carried(spans, p.documents, after).select("file", "new_line", (F.col("new_start") - F.col("span_start")).alias("moved"))


@query(f"""{_S}, d AS (SELECT '/src/N' || n || '/S' || s || '.cs' AS file, s FROM s) SELECT file, CASE WHEN s % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM d WHERE s % 5 = 0 OR s % 2 = 0""")
def parsed_document_changes(p: Parsed) -> DataFrame:
    """Files that the next version lacks or has with another text."""
    key = F.regexp_extract("path", "S(\\d+)\\.cs$", 1)
    number = F.coalesce(F.when(key != "", key.cast("long")), F.lit(1))
    after = p.documents.where(number % 5 != 0).withColumn("text", F.when(number % 2 == 0, F.concat(F.col("text"), F.lit("\n"))).otherwise(F.col("text")))
    return rewrite.document_changes(p.documents, after).select(F.col("path").alias("file"), "change")


@query(f"""{_S} SELECT '/src/N' || n || '/S' || s || '.cs' AS file, 21::INT AS line, 13::INT AS col, 'Diagnostic: CS0219' AS title, 'analyzer' AS category, 'info' AS risk FROM s WHERE s % 2 = 1""")
def parsed_unanswered_smells(p: Parsed) -> DataFrame:
    """Unused locals as findings of their own, where no action is offered: actions are those of every second file."""
    at = smells.anchors(p.diagnostics)
    offered = csharp.actions(p.diagnostics, p.parsed["statements"], p.parsed["places"]).where(F.regexp_extract("file", "S(\\d+)\\.cs$", 1).cast("long") % 2 == 0)
    return smells.dedup(smells.unanswered(at, smells.matches(at, offered))).drop("origin")


@query(f"""{_S} SELECT 'M:' || {_T} || '.M0(int)' AS symbol_id, 4::INT AS complexity, 6::INT AS line_count, 10::INT AS score FROM s ORDER BY symbol_id LIMIT 10""")
def parsed_hotspots(p: Parsed) -> DataFrame:
    """The most complex methods: all suppliers' M0 are alike, so the first by id."""
    return metrics.hotspots(p.metrics.where("symbol_id like '%.M0(int)'"), p.symbols, "deep").select("symbol_id", "complexity", "line_count", "score")


@query(f"""{_S} SELECT 'T:' || {_T} AS id, 1::INT AS distance FROM s WHERE n = 1""", whole=False)
def parsed_derived(p: Parsed) -> DataFrame:
    return hierarchy.derived(p.type_edges, "T:N1.Node", most=None).select("id", F.col("distance").cast("int").alias("distance"))


@query(f"""{_S}, f AS (SELECT n, s, t FROM s WHERE s = {_FIRST}), m AS (SELECT unnest(['label', 'Name', 'M0', 'Call', 'S' || s, 'Extra' || s % 3]) AS name, unnest(['field', 'property', 'method', 'method', 'ctor', 'method']) AS kind, false AS is_inherited FROM f
UNION ALL SELECT unnest(['M0', 'Shared', 'M0']), 'method', true FROM f) SELECT name, kind, is_inherited FROM m""", whole=False)
def parsed_inherited_members(p: Parsed) -> DataFrame:
    """Members of the first supplier's class, with those of its base class and of the interface of that."""
    first = p.symbols.where("type_kind = 'class' and name like 'S%'").agg(F.min_by("symbol_id", F.substring("name", 2, 20).cast("long"))).first()[0]
    return listing.members(p.symbols, p.type_edges, first, inherited=True).select("name", "kind", "is_inherited")


@query(f"""{_S}, r AS (SELECT n, s FROM s WHERE s = {_FIRST}) SELECT 'S' || s.s || '.cs' AS name, 2::INT AS count FROM s JOIN r USING (n) WHERE s.t = r.s ORDER BY name LIMIT 3""")
def parsed_impact(p: Parsed) -> DataFrame:
    """Files that name the class of the first supplier: that of the next one, for a parameter and a creation, and its own if it is its own neighbour."""
    first = p.symbols.where("type_kind = 'class' and name like 'S%'").agg(F.min_by("symbol_id", F.substring("name", 2, 20).cast("long"))).first()[0]
    return references.impact_hints(csharp.refs(p.bound), first)
