"""The operators as named queries over the stand-in facts, each with its SQL in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import scalars as S
from ..operators import callgraph, explain, hierarchy, listing, metrics, projects, refactoring, references, resolve, rewrite, smells
from ..sources.standins import DECISIONS, Facts, sql_with
from . import shapes

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# --- listing -----------------------------------------------------------------------------------

_SHOWN = "in_source AND type_kind IS NOT NULL AND NOT regexp_matches(file, '(?i)/(obj|bin)/') AND NOT regexp_matches(file, '(?i)(\\.g\\.cs|\\.g\\.i\\.cs|\\.generated\\.cs|\\.designer\\.cs|\\.AssemblyAttributes\\.cs|\\.AssemblyInfo\\.cs)$')"
_TYPE = "symbol_id, display_min AS display_name, containing_namespace AS namespace, type_kind AS kind, accessibility, CAST(nullif(arity, 0) AS VARCHAR) AS arity, file, line, col, project_id"


@query(f"""{sql_with('symbols')}, t AS (SELECT {_TYPE} FROM f_symbols WHERE {_SHOWN} AND containing_namespace LIKE 'Brand#1%')
SELECT *, CAST(row_number() OVER (ORDER BY kind, display_name, coalesce(arity, '0'), symbol_id) AS INTEGER) AS pos FROM t
ORDER BY kind, display_name, coalesce(arity, '0'), symbol_id LIMIT 50 OFFSET 10""")
def list_types_page(f: Facts) -> DataFrame:
    return listing.types_page(f.symbols, limit=50, offset=10, namespace_prefix="Brand#1").withColumn("arity", F.col("arity").cast("string"))


@query(f"{sql_with('symbols')} SELECT CAST(count(*) AS INTEGER) AS total FROM f_symbols WHERE {_SHOWN} AND accessibility = 'public'")
def list_types_total(f: Facts) -> DataFrame:
    return listing.total(listing.types(f.symbols, accessibility="public"))


@query(f"{sql_with('symbols')} SELECT {_TYPE} FROM f_symbols WHERE {_SHOWN} AND project_id = '7' AND type_kind = 'interface'")
def list_types_filtered(f: Facts) -> DataFrame:
    return listing.types(f.symbols, project_id="7", kind="Interface").withColumn("arity", F.col("arity").cast("string"))


_MEMBER = "symbol_id, name, display_min AS signature, member_kind AS kind, accessibility, is_static"


@query(f"{sql_with('members')} SELECT {_MEMBER}, false AS is_inherited, file, line, col FROM f_members WHERE NOT (member_kind = 'field' AND is_implicit) AND containing_type_id = 'T:42' AND accessibility = 'public' AND is_static")
def list_members_filtered(f: Facts) -> DataFrame:
    return listing.members(f.members, f.type_edges, "T:42", accessibility="public", binding="static")


_ANCESTRY = """b(id, d) AS (SELECT '{root}', 0 UNION SELECT parent_id, d + 1 FROM f_type_edges JOIN b ON type_id = id WHERE edge_kind = 'base' AND d < 30 AND parent_id <> type_id),
a AS (SELECT id, 0 AS owner_rank, 0 AS d FROM b WHERE d = 0 UNION ALL SELECT id, 1, min(d) FROM b WHERE d > 0 GROUP BY id
      UNION ALL SELECT DISTINCT parent_id, 2, 0 FROM f_type_edges JOIN b ON type_id = id WHERE edge_kind = 'interface')"""


@query(f"""{sql_with('members', 'type_edges', recursive=True)}, {_ANCESTRY.format(root='T:100')},
m AS (SELECT {_MEMBER}, containing_type_id <> 'T:100' AS is_inherited, file, line, col, row_number() OVER (PARTITION BY symbol_id ORDER BY owner_rank, d, id) AS rn
      FROM f_members JOIN a ON containing_type_id = id WHERE NOT (member_kind = 'field' AND is_implicit))
SELECT * EXCLUDE (rn) FROM m WHERE rn = 1""")
def list_members_inherited(f: Facts) -> DataFrame:
    return listing.members(f.members, f.type_edges, "T:100", inherited=True)


@query(f"""{sql_with('members', 'type_edges', recursive=True)}, {_ANCESTRY.format(root='T:100')},
m AS (SELECT DISTINCT {_MEMBER}, containing_type_id <> 'T:100' AS is_inherited, file, line, col FROM f_members JOIN a ON containing_type_id = id WHERE member_kind = 'method')
SELECT *, CAST(row_number() OVER (ORDER BY kind, name, signature, symbol_id) AS INTEGER) AS pos FROM m ORDER BY kind, name, signature, symbol_id LIMIT 20 OFFSET 5""")
def list_members_page(f: Facts) -> DataFrame:
    return listing.members_page(f.members, f.type_edges, "T:100", kind="method", inherited=True, limit=20, offset=5)


@query(f"""{sql_with('members')} SELECT containing_type_id AS type_id, CAST(count(*) FILTER (WHERE member_kind = 'method') AS INTEGER) AS methods,
CAST(count(*) FILTER (WHERE member_kind = 'property') AS INTEGER) AS properties, CAST(count(*) FILTER (WHERE member_kind = 'field') AS INTEGER) AS fields FROM f_members GROUP BY 1""")
def member_shape(f: Facts) -> DataFrame:
    return listing.member_shape(f.members)


@query(f"""{sql_with('members', 'nesting')}, n AS (SELECT type_id, parent_id FROM f_nesting),
o AS (SELECT 'T:5' AS id UNION SELECT type_id FROM n WHERE parent_id = 'T:5' UNION SELECT x.type_id FROM n x JOIN n y ON x.parent_id = y.type_id WHERE y.parent_id = 'T:5')
SELECT DISTINCT name, member_kind AS kind, display_min AS signature, accessibility, is_static FROM f_members WHERE NOT is_implicit AND containing_type_id IN (SELECT id FROM o)""")
def outline_depth3(f: Facts) -> DataFrame:
    return listing.outline(f.members, f.nesting, "T:5", 3)


# --- lookup ------------------------------------------------------------------------------------

_CANDIDATE = "symbol_id, name, display_fq, project_id, tier"


@query(f"""{sql_with('symbols')}, r AS (SELECT *, CASE WHEN display_fq = q OR display_err = q THEN 0 END AS tier
FROM f_symbols, (SELECT display_fq AS q, name AS n FROM f_symbols WHERE symbol_id = 'T:77') WHERE name = n)
SELECT symbol_id, name, display_fq, project_id, CAST(tier AS INTEGER) AS tier FROM r WHERE tier = 0""")
def resolve_unique(f: Facts) -> DataFrame:
    wanted = f.symbols.where("symbol_id = 'T:77'").select("display_fq").first()[0]
    return resolve.by_name(f.symbols, wanted).select(*_CANDIDATE.split(", "))


@query(f"""{sql_with('symbols')}, n AS (SELECT min(name) AS n FROM f_symbols)
SELECT symbol_id, name, display_fq, project_id, 1 AS tier FROM f_symbols, n WHERE name = n""")
def resolve_ambiguous_candidates(f: Facts) -> DataFrame:
    return resolve.by_name(f.symbols, f.symbols.agg(F.min("name")).first()[0]).select(*_CANDIDATE.split(", "))


@query(f"{sql_with('symbols')} SELECT symbol_id, display_min FROM f_symbols WHERE symbol_id = 'T:123'")
def find_symbol(f: Facts) -> DataFrame:
    return resolve.by_id(f.symbols, "T:123").select("symbol_id", "display_min")


@query(f"""{sql_with('diagnostics', 'actions')}, r AS (SELECT d.file, d.span_start AS place, a.span_start AS node_start, a.span_len,
row_number() OVER (PARTITION BY d.file, d.span_start ORDER BY a.span_len, a.span_start) AS rn
FROM f_diagnostics d JOIN f_actions a ON d.file = a.file AND d.span_start >= a.span_start AND d.span_start < a.span_start + a.span_len)
SELECT file, place, node_start, span_len FROM r WHERE rn = 1""")
def symbol_at_position(f: Facts) -> DataFrame:
    nodes = f.actions.select(F.col("file").alias("document_id"), F.col("span_start").alias("node_id"), "span_start", "span_len")
    points = f.diagnostics.select(F.col("file").alias("document_id"), F.col("span_start").alias("at"))
    return resolve.at_position(nodes, points).select(F.col("document_id").alias("file"), F.col("at").alias("place"), F.col("span_start").alias("node_start"), "span_len")


@query(f"""{sql_with('symbols')}, n AS (SELECT max(name) AS n FROM f_symbols)
SELECT symbol_id, name, kind, CAST(NULL AS VARCHAR) AS containing_type, containing_namespace AS namespace, file, line, col FROM f_symbols, n WHERE upper(name) = upper(n)""")
def search_symbols(f: Facts) -> DataFrame:
    return resolve.descriptor(resolve.search(f.symbols, f.symbols.agg(F.max("name")).first()[0].upper()))


@query(f"""{sql_with('symbols')}, n AS (SELECT max(name) AS n FROM f_symbols)
SELECT symbol_id, name, kind, CAST(NULL AS VARCHAR) AS containing_type, containing_namespace AS namespace, file, line, col FROM f_symbols, n WHERE upper(name) = upper(n) AND accessibility = 'public' AND kind = 'NamedType'""")
def search_symbols_scoped(f: Facts) -> DataFrame:
    return resolve.descriptor(resolve.search(f.symbols, f.symbols.agg(F.max("name")).first()[0], kind="namedtype", accessibility="Public"))


@query(f"{sql_with('symbols')} SELECT symbol_id, display_min AS signature FROM f_symbols WHERE symbol_id = 'T:9'")
def get_signature(f: Facts) -> DataFrame:
    return resolve.by_id(f.symbols, "T:9").select("symbol_id", F.col("display_min").alias("signature"))


# --- references --------------------------------------------------------------------------------


@query(f"{sql_with('refs')} SELECT DISTINCT file, line, col FROM f_refs WHERE symbol_id = 'T:11'")
def find_usages_solution(f: Facts) -> DataFrame:
    return references.usages(f.refs, "T:11")


@query(f"{sql_with('refs')} SELECT DISTINCT file, line, col FROM f_refs WHERE symbol_id = 'T:11' AND project_id = '3'")
def find_usages_project(f: Facts) -> DataFrame:
    return references.usages(f.refs, "T:11", "project", project_id="3")


@query(f"{sql_with('refs')} SELECT DISTINCT file, line, col FROM f_refs WHERE symbol_id = 'T:11' AND upper(file) = (SELECT upper(min(file)) FROM f_refs WHERE symbol_id = 'T:11')")
def find_usages_document(f: Facts) -> DataFrame:
    path = f.refs.where("symbol_id = 'T:11'").agg(F.min("file")).first()[0] or "none"
    return references.usages(f.refs, "T:11", "document", path=path.upper())


_NAMED = "SELECT DISTINCT file, line, col, list_extract(string_split(file, '/'), -1) AS name FROM f_refs WHERE symbol_id = 'T:11'"


@query(f"""{sql_with('refs')}, u AS ({_NAMED}), g AS (SELECT upper(name) AS key, CAST(count(*) AS INTEGER) AS count, arg_min(name, (file, line, col)) AS name FROM u GROUP BY 1)
SELECT name, count FROM g ORDER BY count DESC, key LIMIT 3""")
def impact_hints(f: Facts) -> DataFrame:
    return references.impact_hints(f.refs, "T:11")


@query(f"{sql_with('refs')} SELECT DISTINCT file, line, col FROM f_refs WHERE symbol_id = 'T:11' ORDER BY file, line, col LIMIT 5")
def key_references(f: Facts) -> DataFrame:
    return references.key_references(f.refs, "T:11")


# --- call graph --------------------------------------------------------------------------------


@query(f"{sql_with('calls')} SELECT * FROM f_calls WHERE to_id = 'T:1'")
def find_callers(f: Facts) -> DataFrame:
    return callgraph.callers(f.calls, "T:1")


@query(f"{sql_with('calls')} SELECT * FROM f_calls WHERE from_id = 'T:1'")
def find_callees(f: Facts) -> DataFrame:
    return callgraph.callees(f.calls, "T:1")


def _trace_sql(near: str, far: str, depth: int, tag: str) -> str:
    return f"{tag}(n, d) AS (SELECT 'T:1', 0 UNION SELECT {far}, d + 1 FROM f_calls JOIN {tag} ON {near} = n WHERE d < {depth - 1}), e{tag} AS (SELECT * FROM f_calls WHERE {near} IN (SELECT n FROM {tag}))"


_UP, _DOWN = _trace_sql("to_id", "from_id", 2, "u"), _trace_sql("from_id", "to_id", 2, "w")
_BOTH = f"{sql_with('calls', recursive=True)}, {_UP}, {_DOWN}, t AS (SELECT * FROM eu UNION SELECT * FROM ew)"


@query(f"{sql_with('calls', recursive=True)}, {_UP} SELECT * FROM eu")
def trace_upstream_d2(f: Facts) -> DataFrame:
    return callgraph.trace(f.calls, "T:1", "up", 2)


@query(f"{sql_with('calls', recursive=True)}, {_trace_sql('from_id', 'to_id', 3, 'w')} SELECT * FROM ew")
def trace_downstream_d3(f: Facts) -> DataFrame:
    return callgraph.trace(f.calls, "T:1", "downstream", 3)


@query(f"{_BOTH} SELECT * FROM t")
def trace_both_d2(f: Facts) -> DataFrame:
    return callgraph.trace(f.calls, "T:1", None, 2)


@query(f"{_BOTH} SELECT (SELECT CAST(count(DISTINCT n) AS INTEGER) FROM (SELECT from_id AS n FROM t UNION ALL SELECT to_id FROM t UNION ALL SELECT 'T:1')) AS node_count, (SELECT CAST(count(*) AS INTEGER) FROM t) AS edge_count")
def callgraph_counts(f: Facts) -> DataFrame:
    return callgraph.graph_counts(callgraph.trace(f.calls, "T:1"), "T:1")


@query(f"""{_BOTH.replace('RECURSIVE ', 'RECURSIVE f_symbols AS (' + sql_with('symbols').removeprefix('WITH f_symbols AS (').removesuffix(')') + '), ', 1)},
s AS (SELECT symbol_id, project_id FROM f_symbols WHERE NOT regexp_matches(file, '(?i)/(obj|bin)/') AND NOT regexp_matches(file, '(?i)\\.g\\.cs$'))
SELECT a.project_id AS from_project, b.project_id AS to_project, CAST(count(*) AS INTEGER) AS count
FROM t JOIN s a ON from_id = a.symbol_id JOIN s b ON to_id = b.symbol_id WHERE NOT regexp_matches(t.file, '(?i)/(obj|bin)/') GROUP BY 1, 2""")
def flow_transitions(f: Facts) -> DataFrame:
    return callgraph.transitions(callgraph.visible_edges(callgraph.trace(f.calls, "T:1"), f.symbols))


# --- hierarchy ---------------------------------------------------------------------------------

_CLOSURE = "c(id, d) AS (SELECT '{root}', 0 UNION SELECT {far}, d + 1 FROM f_type_edges JOIN c ON {near} = id WHERE d < 40 {kind})"


@query(f"{sql_with('type_edges', recursive=True)}, {_CLOSURE.format(root='T:1000', near='type_id', far='parent_id', kind=chr(65) + 'ND edge_kind = ' + repr('base'))} SELECT id, CAST(min(d) AS INTEGER) AS distance FROM c WHERE d > 0 GROUP BY id")
def type_bases(f: Facts) -> DataFrame:
    return hierarchy.bases(f.type_edges, "T:1000")


@query(f"{sql_with('type_edges', recursive=True)}, {_CLOSURE.format(root='T:1000', near='type_id', far='parent_id', kind='')} SELECT DISTINCT parent_id AS id FROM f_type_edges WHERE edge_kind = 'interface' AND type_id IN (SELECT id FROM c)")
def type_interfaces(f: Facts) -> DataFrame:
    return hierarchy.interfaces(f.type_edges, "T:1000")


@query(f"{sql_with('type_edges', recursive=True)}, {_CLOSURE.format(root='T:2', near='parent_id', far='type_id', kind='')} SELECT id, CAST(min(d) AS INTEGER) AS distance FROM c WHERE d > 0 GROUP BY id ORDER BY id LIMIT 200")
def type_derived(f: Facts) -> DataFrame:
    return hierarchy.derived(f.type_edges, "T:2")


@query(f"{sql_with('type_edges')} SELECT type_id AS id, 'derived' AS role FROM f_type_edges WHERE parent_id = 'T:2' UNION SELECT parent_id, edge_kind FROM f_type_edges WHERE type_id = 'T:2'")
def type_direct_only(f: Facts) -> DataFrame:
    rows = [(hierarchy.derived(f.type_edges, "T:2", False), "derived"), (hierarchy.bases(f.type_edges, "T:2", False), "base"), (hierarchy.interfaces(f.type_edges, "T:2", False), "interface")]
    found = [df.select("id", F.lit(role).alias("role")) for df, role in rows]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""{sql_with('symbols', 'type_edges', recursive=True)}, {_CLOSURE.format(root='T:3', near='parent_id', far='type_id', kind='')}
SELECT symbol_id, display_min FROM f_symbols WHERE symbol_id IN (SELECT id FROM c WHERE d > 0) AND coalesce(type_kind, '') <> 'interface' AND (SELECT any_value(type_kind) FROM f_symbols WHERE symbol_id = 'T:3') = 'interface'""")
def find_implementations(f: Facts) -> DataFrame:
    return hierarchy.implementations(f.type_edges, f.impl_edges, f.symbols, "T:3").select("symbol_id", "display_min")


@query(f"""{sql_with('symbols', 'type_edges', recursive=True)}, {_CLOSURE.format(root='I:2', near='parent_id', far='type_id', kind='')}
SELECT symbol_id, display_min FROM f_symbols WHERE symbol_id IN (SELECT id FROM c WHERE d > 0) AND coalesce(type_kind, '') <> 'interface'""")
def find_implementations_of_interface(f: Facts) -> DataFrame:
    face = f.symbols.limit(1).withColumn("symbol_id", F.lit("I:2")).withColumn("type_kind", F.lit("interface"))
    return hierarchy.implementations(f.type_edges, f.impl_edges, f.symbols.unionByName(face), "I:2").select("symbol_id", "display_min")


@query(f"""{sql_with('members', 'impl_edges')} SELECT symbol_id, display_min FROM f_members
WHERE symbol_id IN (SELECT impl_id FROM f_impl_edges WHERE symbol_id = (SELECT min(symbol_id) FROM f_impl_edges))""")
def find_implementations_of_member(f: Facts) -> DataFrame:
    member = f.impl_edges.agg(F.min("symbol_id")).first()[0]
    rows = f.symbols.unionByName(f.members, allowMissingColumns=True)
    return hierarchy.implementations(f.type_edges, f.impl_edges, rows, member).select("symbol_id", "display_min")


# --- projects ----------------------------------------------------------------------------------


def _deps(where: str) -> str:
    return f"{sql_with('projects', 'project_refs')} SELECT src_project_id, a.name AS source_name, dst_project_id, b.name AS target_name FROM f_project_refs JOIN f_projects a ON src_project_id = a.project_id JOIN f_projects b ON dst_project_id = b.project_id WHERE {where}"


@query(_deps("src_project_id = '4'"))
def list_dependencies_out(f: Facts) -> DataFrame:
    return projects.dependencies(f.projects, f.project_refs, "4", "outgoing")


@query(_deps("dst_project_id = '4'"))
def list_dependencies_in(f: Facts) -> DataFrame:
    return projects.dependencies(f.projects, f.project_refs, "4", "incoming")


@query(_deps("src_project_id = '4' OR dst_project_id = '4'"))
def list_dependencies_both(f: Facts) -> DataFrame:
    return projects.dependencies(f.projects, f.project_refs, "4")


@query(f"""{sql_with('projects', 'project_refs')} SELECT project_id, name, CAST((SELECT count(*) FROM f_project_refs WHERE src_project_id = project_id) AS INTEGER) AS outgoing,
CAST((SELECT count(*) FROM f_project_refs WHERE dst_project_id = project_id) AS INTEGER) AS incoming FROM f_projects""")
def module_fan(f: Facts) -> DataFrame:
    return projects.module_fan(f.projects, f.project_refs)


# --- metrics and diagnostics -------------------------------------------------------------------


def _hotspots(k: int) -> str:
    return f"{sql_with('metrics', 'docs')} SELECT symbol_id, coalesce(path, symbol_id) AS display_name, complexity, line_count, complexity + line_count AS score FROM f_metrics LEFT JOIN f_docs d ON document_id = symbol_id AND path <> ' ' ORDER BY complexity DESC, line_count DESC, symbol_id LIMIT {k}"


def _shown_units(f: Facts) -> DataFrame:
    return f.documents.where("path <> ' '").select(F.col("document_id").alias("symbol_id"), F.col("path").alias("display_min"))


for _profile, _k in metrics.HOTSPOTS.items():
    query(_hotspots(_k), f"hotspots_{_profile}")(lambda f, p=_profile: metrics.hotspots(metrics.text_metrics(f.documents, DECISIONS), _shown_units(f), p))


@query(f"{sql_with('metrics')} SELECT * FROM f_metrics")
def code_metrics(f: Facts) -> DataFrame:
    return metrics.text_metrics(f.documents, DECISIONS)


@query(f"{sql_with('docs')}" + """ SELECT document_id, CASE WHEN trim(path) = '' THEN 'Unknown' WHEN regexp_matches(replace(path, '\\', '/'), '(?i)/(obj|bin)/') THEN 'Intermediate'
WHEN regexp_matches(path, '(?i)(\\.g\\.cs|\\.g\\.i\\.cs|\\.generated\\.cs|\\.designer\\.cs|\\.AssemblyAttributes\\.cs|\\.AssemblyInfo\\.cs)$') THEN 'Generated' ELSE 'HandWritten' END AS source_kind FROM f_docs""")
def visibility_classes(f: Facts) -> DataFrame:
    return f.documents.select("document_id", S.source_kind(F.col("path")).alias("source_kind"))


@query(f"""{sql_with('diagnostics')} SELECT CAST(count(*) FILTER (WHERE severity = 'error') AS INTEGER) AS errors, CAST(count(*) FILTER (WHERE severity = 'warning') AS INTEGER) AS warnings,
CAST(count(*) FILTER (WHERE severity = 'info') AS INTEGER) AS infos, CAST(count(*) AS INTEGER) AS total FROM f_diagnostics""")
def diagnostic_summary(f: Facts) -> DataFrame:
    return metrics.diagnostic_summary(f.diagnostics)


_DIAGNOSTIC = "code, severity, message, file, line, col"


@query(f"{sql_with('diagnostics')} SELECT {_DIAGNOSTIC} FROM f_diagnostics WHERE upper(file) = 'U7'")
def diagnostics_scope_document(f: Facts) -> DataFrame:
    return metrics.diagnostics_in(f.diagnostics, "document", path="U7")


@query(f"{sql_with('diagnostics')} SELECT {_DIAGNOSTIC} FROM f_diagnostics WHERE project_id = '7'")
def diagnostics_scope_project(f: Facts) -> DataFrame:
    return metrics.diagnostics_in(f.diagnostics, "project", project_id="7")


@query(f"{sql_with('diagnostics')} SELECT {_DIAGNOSTIC} FROM f_diagnostics")
def diagnostics_ordered(f: Facts) -> DataFrame:
    return metrics.diagnostics_in(f.diagnostics).orderBy(*metrics.diagnostic_order())


# --- smells and actions ------------------------------------------------------------------------

_POLICY = """CASE WHEN provider_key = 'use_var_for_local' THEN {use} WHEN origin = 'pack_codefix' AND {c} = 'compiler' AND diagnostic_id IN ('CS0168', 'CS0219', 'IDE0059') THEN {ok} ELSE {no} END"""


def _policy(use: str, ok: str, no: str, c: str = "category") -> str:
    return _POLICY.format(use=f"'{use}'", ok=f"'{ok}'", no=f"'{no}'", c=c)


_MATCH = f"""{sql_with('diagnostics', 'actions')}, m AS (SELECT d.file, d.line, d.col, a.title, lower(trim(a.category)) AS lc, a.category AS raw, a.origin, a.provider_key, a.diagnostic_id
FROM f_diagnostics d JOIN f_actions a ON d.file = a.file AND d.span_start >= a.span_start AND d.span_start < a.span_start + a.span_len),
s AS (SELECT file, line, col, title, CASE WHEN lc <> '' THEN lc WHEN origin LIKE '%analyzer%' THEN 'analyzer' ELSE 'unknown' END AS category, origin,
CASE WHEN origin LIKE '%analyzer%' OR lc = 'analyzer' THEN 'info' ELSE {_policy('review_required', 'low', 'high', 'raw')} END AS risk, {_policy('review_required', 'allow', 'block', 'raw')} AS decision FROM m)"""
_SMELL = "file, line, col, title, category, origin, risk"


def _smells(f: Facts) -> DataFrame:
    return smells.matches(smells.anchors(f.diagnostics), f.actions)


@query(f"{_MATCH} SELECT {_SMELL} FROM s")
def smells_anchor_join(f: Facts) -> DataFrame:
    return _smells(f).select(*_SMELL.split(", "))


@query(f"{_MATCH} SELECT file, line, min(col) AS col, title, category, origin, risk FROM s GROUP BY file, line, title, category, origin, risk")
def smells_dedup(f: Facts) -> DataFrame:
    return smells.dedup(_smells(f))


@query(f"{_MATCH} SELECT file, line, min(col) AS col, title, category, origin, risk FROM s WHERE risk IN ('low', 'review_required') AND category IN ('compiler', 'style', 'refactoring') GROUP BY file, line, title, category, origin, risk")
def smells_filtered(f: Facts) -> DataFrame:
    return smells.dedup(smells.chosen(_smells(f), ["LOW", "review_required"], ["Compiler", "style", "refactoring"]))


@query(f"""{_MATCH}, t AS (SELECT * FROM s ORDER BY file, line, col, CASE WHEN decision = 'allow' THEN 0 ELSE 1 END, CASE risk WHEN 'low' THEN 0 WHEN 'review_required' THEN 1 ELSE 2 END, title, category, origin, risk LIMIT 40)
SELECT file, line, min(col) AS col, title, category, origin, risk FROM t GROUP BY file, line, title, category, origin, risk""")
def smells_limited(f: Facts) -> DataFrame:
    return smells.dedup(smells.first_found(_smells(f), 40))


@query(f"""{sql_with('actions')} SELECT file, span_start, origin, category, diagnostic_id, {_policy('review_required', 'allow', 'block')} AS decision,
{_policy('review_required', 'safe', 'blocked')} AS risk, {_policy('manual_review_required', 'allowlisted', 'not_allowlisted')} AS reason FROM f_actions""")
def policy_decisions(f: Facts) -> DataFrame:
    return smells.policy_decisions(f.actions)


@query(f"""{sql_with('actions')} SELECT span_start, CASE WHEN origin LIKE '%analyzer%' THEN 'info' ELSE {_policy('review_required', 'low', 'high')} END AS risk FROM f_actions""")
def risk_normalized(f: Facts) -> DataFrame:
    return f.actions.select("span_start", S.risk(S.policy(F.col("provider_key"), F.col("origin"), F.col("category"), F.col("diagnostic_id"))["risk"], F.col("origin"), F.col("category")).alias("risk"))


_B = "to_base64(encode({}))"
_ACTION_ID = "concat_ws('|', 'v1', '3', " + ", ".join(_B.format(x) for x in ("'default'", "origin", "category", "provider_key")) + ", span_start, span_len, " + ", ".join(_B.format(x) for x in ("file", "coalesce(diagnostic_id, '')", "coalesce(refactoring_id, '')")) + ", line, col)"


@query(f"{sql_with('actions')} SELECT {_ACTION_ID} AS action_id, 3 AS version, origin, category, provider_key, span_start, span_len, file, diagnostic_id, refactoring_id, line, col FROM f_actions WHERE category <> ''")
def action_id_codec(f: Facts) -> DataFrame:
    made = smells.action_ids(f.actions, 3).select("action_id")
    return smells.parsed_action_ids(made).select("action_id", "a.version", "a.origin", "a.category", "a.provider_key", "a.span_start", "a.span_len", "a.file", "a.diagnostic_id", "a.refactoring_id", "a.line", "a.col")


@query(f"""{sql_with('diagnostics')} SELECT DISTINCT 'v1|2|remove_unused_local|' || code || '|' || span_start || '|' || span_len || '|' || to_base64(encode(file)) AS fix_id,
'Remove unused local (' || code || ')' AS title, code AS diagnostic_id, CASE WHEN trim(category) = '' THEN 'compiler' ELSE lower(category) END AS category, file, line, col FROM f_diagnostics WHERE code IN ('CS0168', 'CS0219')""")
def code_fixes(f: Facts) -> DataFrame:
    return smells.code_fixes(f.diagnostics, 2)


@query(f"""{sql_with('diagnostics')} SELECT DISTINCT 'v1|2|remove_unused_local|' || code || '|' || span_start || '|' || span_len || '|' || to_base64(encode(file)) AS fix_id,
'Remove unused local (' || code || ')' AS title, code AS diagnostic_id, 'style' AS category, file, line, col FROM f_diagnostics WHERE code = 'CS0168' AND category = 'Style'""")
def code_fixes_filtered(f: Facts) -> DataFrame:
    return smells.code_fixes(f.diagnostics, 2, [" cs0168 "], "STYLE")


@query(f"{sql_with('actions')} SELECT concat_ws('|', 'v1', CAST(span_start % 3 AS VARCHAR), " + ", ".join(_B.format(x) for x in ("'default'", "origin", "category", "provider_key")) + ", span_start, span_len, " + ", ".join(_B.format(x) for x in ("file", "coalesce(diagnostic_id, '')", "coalesce(refactoring_id, '')")) + ", line, col) AS action_id, CAST(span_start % 3 AS INTEGER) AS version, span_start % 3 <> 2 AS is_stale FROM f_actions WHERE category <> ''")
def stale_ids(f: Facts) -> DataFrame:
    ids = f.actions.select(codecs.action_id(F.col("span_start") % 3, "default", {c: F.col(c) for c in f.actions.columns}).alias("action_id"))
    return smells.stale(ids, 2)


@query(f"""{sql_with('actions')}, t AS (SELECT * FROM f_actions WHERE upper(file) = 'U3' AND span_start <= 3000 AND span_start + span_len > 3000)
SELECT {_ACTION_ID.replace("'3'", "'1'")} AS action_id, file, span_start, span_len, title, category, provider_key, origin, {_policy('review_required', 'allow', 'block')} AS decision, {_policy('review_required', 'safe', 'blocked')} AS risk FROM t""")
def refactorings_at_position(f: Facts) -> DataFrame:
    return refactoring.actions_at(f.actions, "u3", 3000)


@query(f"{sql_with('docs')} SELECT min(path) AS path FROM f_docs WHERE (path LIKE '/%' OR path LIKE 'C:%') AND upper(path) NOT IN (SELECT upper(path) FROM f_docs WHERE path LIKE '/repo/d%') GROUP BY upper(path)")
def missing_files(f: Facts) -> DataFrame:
    return refactoring.missing_files(f.documents, f.documents.where("path like '/repo/d%'"))


# --- rename ------------------------------------------------------------------------------------

_SHAPED = "SELECT symbol_id, name, member_kind, containing_type_id, CASE WHEN member_kind = 'method' THEN shape ELSE '' END AS shape FROM f_members"


@query(f"""{sql_with('members')}, s AS ({_SHAPED}), r AS (SELECT symbol_id AS renamed, 'm' || (CAST(substr(name, 2) AS BIGINT) + 1) AS new_name, member_kind, containing_type_id, shape FROM s)
SELECT DISTINCT renamed AS symbol_id, s.symbol_id AS conflict_id, s.name AS name FROM r JOIN s ON s.containing_type_id = r.containing_type_id AND s.name = new_name AND s.member_kind = r.member_kind AND s.shape = r.shape WHERE s.symbol_id <> renamed""")
def rename_conflicts(f: Facts) -> DataFrame:
    renames = f.members.select("symbol_id", F.concat(F.lit("m"), F.expr("cast(substring(name, 2) as bigint) + 1")).alias("new_name"))
    return rewrite.conflicts(f.members, renames)


@query(f"{sql_with('symbols', 'refs')} SELECT file, line, col FROM f_symbols WHERE symbol_id = 'T:12' UNION SELECT file, line, col FROM f_refs WHERE symbol_id = 'T:12'")
def rename_affected(f: Facts) -> DataFrame:
    return rewrite.affected(f.symbols, f.refs, "T:12")


@query(f"""{sql_with('docs')} SELECT path, CAST(len(regexp_extract_all(text, 'the ')) AS INTEGER) AS edit_count FROM f_docs WHERE regexp_matches(text, 'the ') AND path <> ' '""")
def rename_changed_files(f: Facts) -> DataFrame:
    docs = f.documents.where("path <> ' '")
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("n", "row")).where(F.col("row").contains("the "))
    pieces = F.transform(F.split("row", "the "), lambda piece: F.length(piece) + 4)
    lines = lines.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))  # what stands before each place, with the place
    ends = F.transform("pieces", lambda _, i: F.aggregate(F.slice("pieces", 1, i + 1), F.lit(0), lambda a, n: a + n))
    places = lines.select(F.col("path").alias("file"), (F.col("n") + 1).alias("line"), F.explode(F.transform(ends, lambda end: end - 3)).alias("col"))
    edits = rewrite.rename_edits(places, "the", "those")
    return rewrite.changed_files(docs, rewrite.apply_edits(docs, edits))


# --- explanation -------------------------------------------------------------------------------


@query(f"""{sql_with('symbols', 'members', 'refs')}, h AS (SELECT containing_type_id, count(*) FILTER (WHERE member_kind = 'method') AS a, count(*) FILTER (WHERE member_kind = 'property') AS b, count(*) FILTER (WHERE member_kind = 'field') AS c FROM f_members GROUP BY 1),
n AS (SELECT symbol_id, count(DISTINCT (file, line, col)) AS n FROM f_refs GROUP BY 1)
SELECT s.symbol_id, CASE WHEN type_kind IS NULL THEN 'NamedType ''' || name || ''' is referenced from ' || coalesce(n.n, 0) || ' location' || CASE WHEN n.n = 1 THEN '' ELSE 's' END || '.'
ELSE name || ' is a ' || type_kind || ' in ' || containing_namespace || ' that ' ||
CASE WHEN type_kind = 'interface' THEN 'defines the contract' WHEN type_kind = 'class' AND is_abstract THEN 'provides a reusable base abstraction' WHEN type_kind = 'class' THEN 'owns the runtime behavior'
WHEN type_kind = 'struct' THEN 'packages value-oriented state' WHEN type_kind = 'enum' THEN 'declares the allowed value set' ELSE 'represents the symbol''s primary abstraction' END || '. ' ||
CASE WHEN coalesce(a + b + c, 0) = 0 THEN 'It has no top-level members' ELSE 'It exposes ' || a || ' methods, ' || b || ' properties, and ' || c || ' fields' END || '. ' ||
CASE WHEN coalesce(n.n, 0) = 0 THEN 'It currently has no discovered incoming references.' ELSE 'Edits likely affect ' || n.n || ' referencing location' || CASE WHEN n.n = 1 THEN '' ELSE 's' END || '.' END END AS role
FROM f_symbols s LEFT JOIN h ON h.containing_type_id = s.symbol_id LEFT JOIN n ON n.symbol_id = s.symbol_id""")
def explain_roles(f: Facts) -> DataFrame:
    counts = f.refs.select("symbol_id", "file", "line", "col").distinct().groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"))
    return explain.role_text(f.symbols, listing.member_shape(f.members), counts)


@query(f"""{sql_with('members', 'impl_edges')}, n AS (SELECT symbol_id, count(*) AS n FROM f_impl_edges GROUP BY 1),
m AS (SELECT f_members.*, replace(containing_type_id, ':', '') AS owner, coalesce(n, 0) AS n, 'is referenced from ' || coalesce(n, 0) || ' location' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' AS used FROM f_members LEFT JOIN n USING (symbol_id))
SELECT symbol_id, CASE member_kind WHEN 'method' THEN name || ' is a method on ' || owner || ' that returns ' || type_name || ' and works with ' || shape || '. ' || CASE WHEN n = 0 THEN 'No discovered call sites reference it yet.' ELSE 'It ' || used END
WHEN 'property' THEN name || ' is a read-only property on ' || owner || ' exposing ' || type_name || '. It ' || used ELSE name || ' is mutable state on ' || owner || ' with type ' || type_name || '. It ' || used END AS role FROM m""")
def explain_members(f: Facts) -> DataFrame:
    counts = f.impl_edges.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"))
    return explain.role_text(f.members, listing.member_shape(f.members), counts)


@query(f"""{sql_with('members')}, m AS (SELECT containing_type_id AS type_id, type_name AS name, CASE member_kind WHEN 'field' THEN 1 ELSE 2 END AS rank, line, symbol_id FROM f_members WHERE member_kind <> 'method'),
a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY type_id, name ORDER BY rank, line, symbol_id) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY rank, line, symbol_id) AS n FROM a QUALIFY n <= 3)
SELECT type_id, string_agg(name, ', ' ORDER BY n) AS collaborators FROM b GROUP BY type_id""")
def explain_collaborators(f: Facts) -> DataFrame:
    return explain.collaborators(f.members)
