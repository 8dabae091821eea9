"""Operators on small hand-written facts, and properties that hold on the stand-in facts."""

import pytest
from pyspark.sql import functions as F

from factgraph.api import Workspace
from factgraph.errors import QueryError
from factgraph.functions import codecs
from factgraph.functions import scalars as S
from factgraph.operators import callgraph, explain, hierarchy, listing, projects, refactoring, references, resolve, rewrite, smells
from factgraph.plans import registry, shapes
from factgraph.sources.snapshots import SnapshotStore, conform
from factgraph.sources.standins import Facts


def types(spark):
    """Three projects as in the fixture: App uses Core and Impl, Impl uses Core."""
    rows = [
        # symbol_id, name, type_kind, project_id, file, line
        ("T:App.Orchestrator", "Orchestrator", "class", "App", "/s/App/Orchestrator.cs", 6),
        ("T:App.EntryPoints", "EntryPoints", "class", "App", "/s/App/Orchestrator.cs", 76),
        ("T:App.Hooks", "Hooks", "class", "App", "/s/App/obj/Hooks.g.cs", 6),
        ("T:Core.IWorker", "IWorker", "interface", "Core", "/s/Core/Hierarchy.cs", 3),
        ("T:Core.WorkerA", "WorkerA", "class", "Core", "/s/Core/Hierarchy.cs", 8),
        ("T:Core.WorkerB", "WorkerB", "class", "Core", "/s/Core/Hierarchy.cs", 13),
        ("T:Core.BaseClass", "BaseClass", "class", "Core", "/s/Core/Hierarchy.cs", 18),
        ("T:Core.DerivedClass", "DerivedClass", "class", "Core", "/s/Core/Hierarchy.cs", 23),
        ("T:Core.LeafClass", "LeafClass", "class", "Core", "/s/Core/Hierarchy.cs", 28),
        ("T:Impl.RoundRobin", "RoundRobin", "class", "Impl", "/s/Impl/Work.cs", 5),
        ("T:System.Object", "Object", "class", "Core", None, None),
    ]
    df = spark.createDataFrame(rows, "symbol_id string, name string, type_kind string, project_id string, file string, line int")
    return conform("symbols", df.withColumn("display_min", F.col("name")).withColumn("in_source", F.col("file").isNotNull()).withColumn("kind", F.lit("NamedType")).withColumn("col", F.lit(1)).withColumn("arity", F.lit(0)).withColumn("containing_namespace", F.col("project_id")).withColumn("accessibility", F.lit("public")).withColumn("display_fq", F.substring("symbol_id", 3, 99)).withColumn("display_err", F.substring("symbol_id", 3, 99)))


def edges(spark):
    rows = [("DerivedClass", "BaseClass", "base"), ("LeafClass", "DerivedClass", "base")]
    rows += [(x, "IWorker", "interface") for x in ("BaseClass", "WorkerA", "WorkerB")]
    found = [(f"T:Core.{a}", f"T:Core.{b}", k) for a, b, k in rows] + [("T:Impl.RoundRobin", "T:Core.IWorker", "interface"), ("T:Core.BaseClass", "T:System.Object", "base")]
    return spark.createDataFrame(found, "type_id string, parent_id string, edge_kind string")


def ids(df, column="id"):
    return {r[0].rsplit(".", 1)[-1] for r in df.select(column).collect()}


def test_hierarchy_goldens(spark):
    e = edges(spark)
    assert ids(hierarchy.bases(e, "T:Core.DerivedClass")) == {"BaseClass", "Object"}
    assert ids(hierarchy.interfaces(e, "T:Core.DerivedClass")) == {"IWorker"}
    assert ids(hierarchy.derived(e, "T:Core.DerivedClass")) == {"LeafClass"}
    assert ids(hierarchy.bases(e, "T:Core.DerivedClass", False)) == {"BaseClass"}
    assert ids(hierarchy.interfaces(e, "T:Core.DerivedClass", False)) == set()
    assert ids(hierarchy.derived(e, "T:Core.BaseClass", True, 1)) == {"DerivedClass"}
    assert hierarchy.derived(e, "T:Core.BaseClass", True, 0).count() == 0
    none = spark.createDataFrame([], "symbol_id string, impl_id string")
    assert ids(hierarchy.implementations(e, none, types(spark), "T:Core.IWorker"), "symbol_id") == {"BaseClass", "DerivedClass", "LeafClass", "RoundRobin", "WorkerA", "WorkerB"}
    assert hierarchy.implementations(e, none, types(spark), "T:Core.BaseClass").count() == 0


def test_types_hide_generated_sources_and_page(spark):
    rows = types(spark)
    assert ids(listing.types(rows, "App"), "display_name") == {"EntryPoints", "Orchestrator"}
    all_pages = [r["symbol_id"] for o in (0, 2, 4, 6, 8) for r in listing.types_page(rows, 2, o).collect()]
    assert all_pages == [r[0] for r in listing.types(rows).orderBy(*listing.type_order()).select("symbol_id").collect()]
    assert listing.types_page(rows, 0).count() == 0
    assert [r["pos"] for r in listing.types_page(rows, 3, 2).orderBy("pos").collect()] == [3, 4, 5]
    with pytest.raises(QueryError, match="invalid_input"):
        listing.types(rows, kind="delegate")


def test_dependencies_goldens(spark):
    p = spark.createDataFrame([("App", "App", "/s/App.csproj"), ("Core", "Core", "/s/Core.csproj"), ("Impl", "Impl", "/s/Impl.csproj")], "project_id string, name string, path string")
    refs = spark.createDataFrame([("App", "Core"), ("App", "Impl"), ("Impl", "Core"), ("App", "Gone")], "src_project_id string, dst_project_id string")
    get = lambda i, d: {(r[0], r[2]) for r in projects.dependencies(p, refs, i, d).select("src_project_id", "source_name", "dst_project_id").collect()}
    assert get("App", "outgoing") == {("App", "Core"), ("App", "Impl")}
    assert get("Core", "incoming") == {("App", "Core"), ("Impl", "Core")}
    assert get("Impl", None) == {("App", "Impl"), ("Impl", "Core")}
    fan = {r["name"]: (r["outgoing"], r["incoming"]) for r in projects.module_fan(p, refs.where("dst_project_id <> 'Gone'")).collect()}
    assert fan == {"App": (2, 0), "Core": (0, 2), "Impl": (1, 1)}


def test_trace_goldens(spark):
    """The fixture's call edges around RunAsync and ExecuteFlowAsync."""
    calls = [("Run", "Start", 20), ("Run", "Item", 21), ("Run", "Hook", 22), ("Run", "Execute", 23), ("Run", "Calculate", 25), ("Run", "Stop", 27)]
    calls += [("Start", "Change", 7), ("Start", "Delay", 8), ("Start", "Change", 9), ("Stop", "Change", 14), ("Execute", "IExecute", 56), ("RunFast", "Run", 80), ("RunSafe", "Run", 85)]
    df = spark.createDataFrame([(a, b, "/s/f.cs", n, 1) for a, b, n in calls], "from_id string, to_id string, file string, line int, col int")
    homes = {"Start": "/s/i.cs", "Hook": "/s/obj/h.g.cs", "Delay": None}
    rows = spark.createDataFrame([(n, homes.get(n, "/s/f.cs"), "Core" if n == "IExecute" else "App") for n in {x for a, b, _ in calls for x in (a, b)}], "symbol_id string, file string, project_id string")
    shown = lambda s, d, n: callgraph.visible_edges(callgraph.trace(df, s, d, n), rows)
    assert shown("Run", "down", 2).count() == 10
    assert [shown("Execute", d, n).count() for d, n in (("up", 1), ("up", 2), (None, 2))] == [1, 3, 4]
    moves = {(r[0], r[1]): r[2] for r in callgraph.transitions(shown("Execute", "both", 2)).collect()}
    assert moves == {("App", "App"): 3, ("App", "Core"): 1}
    assert callgraph.trace(df, "Run", "up", 0).count() == 2  # a depth of 0 is 1
    with pytest.raises(QueryError):
        callgraph.trace(df, "Run", "sideways", 1)


def test_traces_grow_with_depth_and_both_is_the_union(spark, sf_dir):
    f = Facts(spark, sf_dir)
    calls = f.calls.cache()
    n = [callgraph.trace(calls, "T:1", "down", d).count() for d in (1, 2, 3)]
    assert n == sorted(n)
    up, down, both = (callgraph.trace(calls, "T:1", d, 2) for d in ("up", "down", "both"))
    assert both.exceptAll(up.unionByName(down).distinct()).count() == 0 and both.count() == up.unionByName(down).distinct().count()


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    for local in (0, 1, 1000):  # by joins, changing over, and by filters
        assert {(r["id"], r["distance"]) for r in shapes.reach(e, shapes.single_row(spark, id="a"), None, local).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_reach_is_the_same_by_filters_and_by_joins(spark, sf_dir):
    e = Facts(spark, sf_dir).calls.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct().cache()
    found = [{tuple(r) for r in shapes.reach(e, shapes.single_row(spark, id="T:1"), 3, local).collect()} for local in (0, 5, 100_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_range_join_finds_each_pair_once(spark):
    points = spark.createDataFrame([("f", i) for i in range(0, 5000, 7)], "k string, at int")
    spans = spark.createDataFrame([("f", s, n) for s in range(0, 5000, 311) for n in (0, 1, 900, 2500)], "k string, s int, n int")
    got = sorted((r["at"], r["s"], r["n"]) for r in shapes.range_join(points, spans, "k", "at", "s", "n").collect())
    assert got == sorted((p, s, n) for p in range(0, 5000, 7) for s in range(0, 5000, 311) for n in (0, 1, 900, 2500) if s <= p < s + n)


def test_position_lookup_takes_the_innermost(spark):
    nodes = spark.createDataFrame([("d", 1, 0, 100), ("d", 2, 10, 50), ("d", 3, 20, 5), ("e", 4, 0, 9)], "document_id string, node_id int, span_start int, span_len int")
    points = spark.createDataFrame([("d", 22), ("d", 25), ("d", 70), ("d", 100)], "document_id string, at int")
    assert {(r["at"], r["node_id"]) for r in resolve.at_position(nodes, points).collect()} == {(22, 3), (25, 2), (70, 1)}


def test_resolve_tiers(spark):
    rows = types(spark)
    assert ids(resolve.by_name(rows, "global::Core.WorkerA"), "symbol_id") == {"WorkerA"}
    assert ids(resolve.by_name(rows, "WorkerB"), "symbol_id") == {"WorkerB"}
    assert resolve.by_name(rows, "Other.WorkerB").count() == 0
    assert resolve.by_name(rows, "workerb").count() == 0  # case counts
    assert resolve.search(rows, "workerb").count() == 1


def test_impact_keeps_the_first_spelling(spark):
    refs = spark.createDataFrame([("s", "/b/File.cs", 1, 1), ("s", "/a/file.cs", 2, 1), ("s", "/a/file.cs", 2, 1), ("s", "/c/x.cs", 1, 1)], "symbol_id string, file string, line int, col int")
    assert [tuple(r) for r in references.impact_hints(refs, "s").collect()] == [("file.cs", 2), ("x.cs", 1)]


def test_action_ids_round_trip(spark):
    a = spark.createDataFrame([("o|x", "c", "k", 1, 2, "/é.cs", None, "r", 3, 4), ("o", " ", "k", 1, 2, "f", "d", None, 3, 4)], "origin string, category string, provider_key string, span_start int, span_len int, file string, diagnostic_id string, refactoring_id string, line int, col int")
    made = smells.action_ids(a, 7, "default").select("action_id", codecs.parse_action_id(codecs.split_id(F.col("action_id"))).alias("p"), "origin", "file").collect()
    good, blank = made
    assert good["p"]["origin"] == "o|x" and good["p"]["file"] == "/é.cs" and good["p"]["version"] == 7 and good["p"]["diagnostic_id"] is None and good["p"]["refactoring_id"] == "r"
    assert blank["p"] is None
    for text in ("", "v1|a|b", "v2" + good["action_id"][2:], "v1|x" + good["action_id"][4:]):
        assert spark.range(1).select(codecs.parse_action_id(codecs.split_id(F.lit(text))).alias("p")).first()["p"] is None
    fix = spark.range(1).select(codecs.parse_fix_id(codecs.split_id(codecs.fix_id(2, F.lit("CS0168"), F.lit(5), F.lit(9), F.lit("/a b.cs")))).alias("p")).first()["p"]
    assert (fix["version"], fix["diagnostic_id"], fix["span_start"], fix["file"]) == (2, "CS0168", 5, "/a b.cs")


def test_policy_and_risk(spark):
    rows = [("use_var_for_local", "native", "refactoring", None), ("k", S.FIX_ORIGIN, "compiler", "CS0168"), ("k", S.FIX_ORIGIN, "compiler", None), ("k", "x_analyzer", "", "CS0168")]
    df = spark.createDataFrame(rows, "provider_key string, origin string, category string, diagnostic_id string").withColumn("file", F.lit("f")).withColumn("span_start", F.lit(1))
    assert [(r["decision"], r["reason"]) for r in smells.policy_decisions(df).collect()] == [("review_required", "manual_review_required"), ("allow", "allowlisted"), ("block", "not_allowlisted"), ("block", "not_allowlisted")]
    assert {r["reason"] for r in smells.policy_decisions(df, "strict").collect()} == {"unknown_profile"}
    kinds = ["safe", "medium", "blocked", "", "odd"]
    got = spark.createDataFrame([(k,) for k in kinds], "r string").select(S.risk(F.col("r"), F.lit("native"), F.lit("style")).alias("x"), S.risk_rank(S.risk(F.col("r"), F.lit("native"), F.lit("style"))).alias("n")).collect()
    assert [(r["x"], r["n"]) for r in got] == [("low", 0), ("review_required", 1), ("high", 2), ("info", 2), ("odd", 2)]


def test_source_kinds(spark):
    paths = [(None, "Unknown"), ("  ", "Unknown"), ("/a/obj/x.cs", "Intermediate"), ("C:\\a\\BIN\\x.cs", "Intermediate"), ("/a/x.G.CS", "Generated"), ("/a/x.assemblyinfo.cs", "Generated"), ("/a/objects/x.cs", "HandWritten")]
    got = spark.createDataFrame([(p,) for p, _ in paths], "p string").select(S.source_kind(F.col("p"))).collect()
    assert [r[0] for r in got] == [k for _, k in paths]


def test_rename_edits_and_conflicts(spark):
    docs = spark.createDataFrame([("d", "/d.cs", "int Old = 1;\nOld + Old;"), ("e", "/e.cs", "none")], "document_id string, path string, text string")
    places = spark.createDataFrame([("/d.cs", 1, 5), ("/d.cs", 2, 1), ("/d.cs", 2, 7)], "file string, line int, col int")
    after = rewrite.apply_edits(docs, rewrite.rename_edits(places, "Old", "Newer"))
    assert {r["path"]: r["text"] for r in after.collect()} == {"/d.cs": "int Newer = 1;\nNewer + Newer;", "/e.cs": "none"}
    assert [tuple(r) for r in rewrite.changed_files(docs, after).collect()] == [("/d.cs", 3)]
    rows = conform("symbols", spark.createDataFrame([("a", "A", "method", "T", ["int"]), ("b", "B", "method", "T", ["int"]), ("c", "C", "method", "T", ["string"]), ("d", "B", "field", "T", [])], "symbol_id string, name string, member_kind string, containing_type_id string, param_types array<string>"))
    wanted = spark.createDataFrame([("a", "B"), ("c", "B")], "symbol_id string, new_name string")
    assert [(r["symbol_id"], r["conflict_id"]) for r in rewrite.conflicts(rows, wanted).collect()] == [("a", "b")]
    for name in ("1x", "", None, "a b"):
        with pytest.raises(QueryError, match="invalid_new_name"):
            rewrite.check_identifier(name)


def test_smells_dedup_keeps_the_leftmost(spark):
    rows = spark.createDataFrame([("F", 1, 9, "t", "c", "o", "low"), ("f", 1, 3, "t", "c", "o", "low"), ("f", 1, 3, "t", "c", "o", "high")], "file string, line int, col int, title string, category string, origin string, risk string")
    assert sorted((r["col"], r["risk"]) for r in smells.dedup(rows).collect()) == [(3, "high"), (3, "low")]


def test_cleanup_and_refactorings(spark):
    text = "using Z.B;\nusing static Y.C;\nusing A = Q.D;\nusing Unused;\n\nclass T\n{\n    int spare;\n    void M()\n    {\n        int unused = 1;\n        string name = Get();\n        using var x = Open();\n    }\n}"
    docs = spark.createDataFrame([("d", "/d.cs", text), ("e", "/e.cs", "class E { }")], "document_id string, path string, text string")
    found = spark.createDataFrame([("CS8019", "/d.cs", 4), ("CS0219", "/d.cs", 11), ("CS0219", "/d.cs", 13)], "code string, file string, line int")
    after, changed = refactoring.cleanup(docs, found, 3)
    lines = after.where("path = '/d.cs'").first()["text"].split("\n")
    assert lines[:4] == ["using A = Q.D;", "using Z.B;", "using static Y.C;", ""] and lines[10] == "" and lines[11:13] == text.split("\n")[11:13]
    assert [r["path"] for r in changed.collect()] == ["/d.cs"]
    with pytest.raises(QueryError, match="workspace_changed"):
        refactoring.cleanup(docs, found, 3, expected_version=2)
    with pytest.raises(QueryError, match="invalid_request"):
        refactoring.cleanup(docs, found, 3, profile="wild")
    wanted = spark.createDataFrame([("/d.cs", 11, 9, 3), ("/d.cs", 12, 9, 6)], "file string, line int, col int, span_len int")
    rewritten = rewrite.apply_edits(docs, refactoring.use_var_edits(wanted)).where("path = '/d.cs'").first()["text"]
    assert "var unused = 1;" in rewritten and "var name = Get();" in rewritten
    a = spark.createDataFrame([("t", "compiler", S.FIX_ORIGIN, "k", "/d.cs", "CS0168", None, 10, 5, 2, 1)], "title string, category string, origin string, provider_key string, file string, diagnostic_id string, refactoring_id string, span_start int, span_len int, line int, col int")
    here = lambda *x: refactoring.actions_at(a, "/D.cs", *x).collect()
    assert [r["decision"] for r in here(10)] == ["allow"] and not here(15) and here(12, (0, 11)) and not here(12, (0, 5))
    ident = here(10)[0]["action_id"]
    assert refactoring.require_action(a, ident, 1).count() == 1
    with pytest.raises(QueryError, match="workspace_changed"):
        refactoring.require_action(a, ident, 2)
    with pytest.raises(QueryError, match="action_not_found"):
        refactoring.require_action(a, "nonsense", 1)


def test_snapshots_are_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    with pytest.raises(QueryError, match="solution_not_selected"):
        store.read()
    assert store.write({"symbols": types(spark)}) == 1
    assert store.write({"symbols": types(spark).limit(2)}) == 2
    assert store.read()["symbols"].count() == 2 and store.read(1)["symbols"].count() == 11 and store.read()["refs"].count() == 0
    with pytest.raises(QueryError, match="workspace_changed"):
        store.check_current(1)


def test_api_errors_and_queries(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in __import__("factgraph.schema", fromlist=["FACTS"]).FACTS.items()}
    p = spark.createDataFrame([("App", "App", "/s/App.csproj", 1), ("Core", "Core", "/s/Core.csproj", 1)], "project_id string, name string, path string, snapshot_version int")
    w = Workspace(spark, "/nowhere").use({**empty, "symbols": types(spark), "type_edges": edges(spark), "projects": p})
    total, rows = w.list_types(name="core", limit=2)
    assert total == 6 and rows.count() == 2
    with pytest.raises(QueryError, match="invalid_input"):
        w.find_usages(" ")
    with pytest.raises(QueryError, match="symbol_not_found"):
        w.find_usages("T:none")
    with pytest.raises(QueryError, match="invalid_input"):
        w.list_dependencies()
    with pytest.raises(QueryError, match="solution_not_selected"):
        Workspace(spark, "/nowhere").list_types(name="x")
    assert w.resolve_symbol(qualified_name="WorkerA").first()["symbol_id"] == "T:Core.WorkerA"
    assert w.resolve_symbol(path="/S/core/hierarchy.cs", line=8, column=1).first()["name"] == "WorkerA"
    tree = w.get_type_hierarchy("T:Core.DerivedClass")
    assert [r["name"] for r in tree["bases"].collect()] == ["BaseClass", "Object"]
    assert "WorkerA is a class in Core" in w.explain_symbol("T:Core.WorkerA")["role"].first()["role"]


def test_type_names_and_collaborators(spark):
    written = ["int", "int?", "string?", "object", "System.Text.Json", "List<Dictionary<int, string>>", "Money?", "int[]", "(int a, int b)", "int[]?", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(written)], "i int, w string")
    assert [r[0] for r in rows.orderBy("i").select(S.type_name(F.col("w"))).collect()] == ["Int32", "Nullable", "String", "Object", "Json", "List", "Money", "", "", "", None]
    columns = "symbol_id string, containing_type_id string, member_kind string, is_static boolean, param_types array<string>, return_type string, file string, line int, col int"
    members = spark.createDataFrame([
        ("P", "T", "property", False, [], "Late", "a", 1, 1), ("F", "T", "field", None, [], "Clock", "a", 2, 1), ("C", "T", "ctor", None, ["Store<int>", "Clock", "int[]", None], None, "a", 9, 1),
        ("S", "T", "ctor", True, ["Hidden"], None, "a", 3, 1), ("G", "T", "field", None, [], "Gauge", None, None, None), ("M", "U", "method", None, ["X"], "Y", "a", 1, 1), ("N", None, "field", None, [], "Z", "a", 1, 1),
    ], columns)
    assert [tuple(r) for r in explain.collaborators(members).collect()] == [("T", "Store, Clock, Gauge")]
    assert explain.collaborators(members.limit(0)).count() == 0


def test_every_query_runs_and_has_sql(spark, sf_dir):
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)
    for name in ("list_types_page", "module_fan", "smells_limited", "hotspots_quick"):
        assert registry.QUERIES[name](spark, sf_dir).count() > 0
