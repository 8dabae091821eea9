"""Spans carried from version to version, warnings of one pass, scopes and positions, on a workspace of sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factgraph.api import Workspace
from factgraph.errors import QueryError
from factgraph.operators import rewrite, smells

DOCS = "document_id string, path string, text string"
SPANS = "file string, line int, span_start int, span_len int"
BOX = """namespace Demo;

public class Box
{
    public int Count(int n)
    {
        int spare = 1;
        string text = "spare";
        if (n > 1 && n < 9) { return Inner.Twice(n) + text.Length; }
        try { n++; } catch { }
        return Inner.Twice(1);
    }
    public class Inner { public static int Twice(int x) { return Once(x) + Once(x); } static int Once(int x) => x; }
}
"""


def placed(text, word):
    at = text.index(word)
    return text[:at].count("\n") + 1, at


def test_lines_move_with_the_text_around_them(spark):
    old = "head\nsame\nsame\nkept here\nchanged line\nlast é word\n"
    texts = {"moved": "new\nhead\nsame\nx\nsame\nkept here\nother line\nlast é word\n", "equal": old, "blank": "", "empty": None}
    before = spark.createDataFrame([(k, k, old) for k in (*texts, "gone")], DOCS)
    after = spark.createDataFrame([(k, k, t) for k, t in texts.items()] + [("late", "late", "x")], DOCS)
    words = ("head", "kept", "changed", "é", "word")
    spans = spark.createDataFrame([(k, *placed(old, w), len(w)) for k in (*texts, "gone") for w in words] + [("moved", 4, old.index("here"), 9), ("moved", 4, 0, 1)], SPANS)
    got = {(r["file"], r["span_start"]): (r["new_line"], r["new_start"]) for r in rewrite.carried(spans, before, after).collect()}
    want = {("equal", placed(old, w)[1]): placed(old, w) for w in words} | {("moved", placed(old, w)[1]): placed(texts["moved"], w) for w in words if w != "changed"}
    assert got == want
    changes = {(r["path"], r["change"]) for r in rewrite.document_changes(before, after).collect()}
    assert changes == {("moved", "changed"), ("blank", "changed"), ("empty", "changed"), ("gone", "removed"), ("late", "added")}


def plain_moves(old, new):
    """Lines found again, by the definition: common head, common tail, and what stands once in each rest."""
    a, b = old.split("\n"), new.split("\n")
    h = next(i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1])
    t = 0
    while t < min(len(a), len(b)) - h and a[-1 - t] == b[-1 - t]:
        t += 1
    pairs = [(i, i) for i in range(h)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(t)]
    p, q = a[h : len(a) - t], b[h : len(b) - t]
    pairs += [(h + i, h + q.index(x)) for i, x in enumerate(p) if p.count(x) == 1 and q.count(x) == 1]
    start = lambda rows, i: sum(len(x) + 1 for x in rows[:i])
    return {(i + 1, j + 1, start(a, i), start(b, j), len(a[i])) for i, j in pairs}


def test_line_moves_equal_plain_ones_on_random_texts(spark):
    rng = random.Random(7)
    lines = ["", "a", "bb", "c c", "é", "dddd", "e", "f f f"]
    rows = []
    for i in range(300):
        old = [rng.choice(lines) for _ in range(rng.randint(0, 12))]
        new = [x for x in old for x in ([x], [], [x, rng.choice(lines)], [x])[rng.randint(0, 3)]]
        if "\n".join(old) != "\n".join(new):
            rows.append((str(i), "\n".join(old), "\n".join(new)))
    found = {}
    for r in rewrite.line_moves(spark.createDataFrame(rows, "document_id string, old string, new string")).collect():
        found.setdefault(r["document_id"], set()).add((r["line"], r["new_line"], r["start"], r["new_start"], r["length"]))
    assert all(found.get(k, set()) == plain_moves(old, new) for k, old, new in rows)


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    (root / "Demo.sln").write_text("solution")
    (root / "Demo.csproj").write_text("<Project/>")
    (root / "Box.cs").write_text(BOX)
    return root


@pytest.fixture
def workspace(spark, sources, tmp_path):
    w = Workspace(spark, str(tmp_path / "store"))
    w.load_solution(str(sources))
    return w


def test_actions_are_carried_over_edits(workspace, sources):
    w, path = workspace, str(sources / "Box.cs")
    line, at = placed(BOX, "string text")
    action = w.refactorings(path, line=line, column=9).first()["action_id"]
    spare = w.refactorings(path, BOX.index("spare")).where("title like 'Remove%'").first()["action_id"]
    assert w.carry_action(action) == action
    w.apply_refactoring(spare)  # the line above loses its statement
    assert w.version == 2 and [(r["path"], r["change"]) for r in w.changes(1).collect()] == [(path, "changed")]
    with pytest.raises(QueryError, match="workspace_changed"):
        w.preview_refactoring(action)
    carried = w.carry_action(action)
    now = w.facts["documents"].first()["text"]
    assert carried != action and w.refactorings(path, now.index("string text")).first()["action_id"] == carried
    with pytest.raises(QueryError, match="workspace_changed"):
        w.carry_action(spare)  # its own line was edited
    w.apply_refactoring(carried)
    assert 'var text = "spare";' in w.facts["documents"].first()["text"] and w.version == 3
    with pytest.raises(QueryError, match="action_not_found"):
        w.carry_action("v1|x")


def test_smells_with_warnings(spark, workspace, sources):
    w, path = workspace, str(sources / "Box.cs")
    found = w.codesmells(path)
    rows = {(r["title"], r["category"], r["risk"], r["line"]) for r in found["findings"].collect()}
    assert {("Remove unused local (CS0219)", "compiler", "low", 7), ("Use 'var'", "refactoring", "review_required", 8)} <= rows
    assert any(t.startswith("Diagnostic: ") and (c, r, n) == ("analyzer", "info", 10) for t, c, r, n in rows) and found["warnings"] == []
    none = w.codesmells(path, risk_levels=["high"])
    assert none["findings"].isEmpty() and none["warnings"] == ["No finding has the wanted risk levels and categories."]
    # a second anchor within the type's name meets the same action again
    facts, (line, at) = w.facts, placed(BOX, "string text")
    inner = spark.createDataFrame([(path, "name", line, 11, at + 2)], "document_id string, node_kind string, start_line int, start_col int, span_start int")
    w.use({**facts, "nodes": facts["nodes"].select(*inner.columns).unionByName(inner)})
    twice = w.codesmells(path)
    assert twice["warnings"] == ["1 findings that repeat title, category and line are left out."] and twice["findings"].count() == len(found["findings"].collect())
    many = spark.range(700).select(F.lit(path).alias("document_id"), F.lit("literal").alias("node_kind"), (F.col("id") + 100).cast("int").alias("start_line"), F.lit(1).alias("start_col"), (F.col("id") + 10_000).cast("int").alias("span_start"))
    w.use({**facts, "nodes": many, "actions": facts["actions"].limit(0)})
    cut = w.codesmells(path)
    n = w.facts["diagnostics"].count()
    assert cut["warnings"] == [f"Only the first {smells.MAX_ANCHORS} of {700 + n} anchors were looked at."] and cut["findings"].count() == n
    docs = w.facts["documents"]
    w.use({**w.facts, "documents": docs.unionByName(docs.withColumn("project_id", F.lit("other")))})
    with pytest.raises(QueryError, match="several loaded documents"):
        w.codesmells(path)


def test_services_by_scope_and_position(workspace, sources):
    w, path = workspace, str(sources / "Box.cs")
    twice, once = "M:Demo.Box.Inner.Twice(int)", "M:Demo.Box.Inner.Once(int)"
    count = "M:Demo.Box.Count(int)"
    assert [(r["from_id"], r["to_id"]) for r in w.callers(once).collect()] == [(twice, once)] * 2
    assert {r["from_id"] for r in w.callers(once, 2).collect()} == {twice, count} and {r["to_id"] for r in w.callees(count, 2).collect()} == {twice, once}
    assert w.call_graph(twice, "both")["counts"].first().asDict() == {"node_count": 3, "edge_count": 4}
    assert [r["name"] for r in w.symbol_outline("T:Demo.Box").collect()] == ["Count"] and [r["name"] for r in w.symbol_outline("T:Demo.Box", 2).collect()] == ["Count", "Once", "Twice"]
    assert w.symbol_at(path, 7, 1).first()["symbol_id"] == count and "Twice(int)" in w.signature(twice)
    measured = {r["symbol_id"]: r["complexity"] for r in w.code_metrics("document", path).collect()}
    assert measured[twice] == 1 and measured[count] > 2 and w.code_metrics("project", path).count() == w.code_metrics().count()
    seen = w.analyze("document", path)
    assert seen["summary"].first()["total"] == seen["diagnostics"].count() == w.facts["diagnostics"].count() > 1
    assert w.code_fixes(scope="document", path=path).count() == w.code_fixes(scope="project", path=str(sources / "Demo.csproj")).count() == w.code_fixes().count() == 1
    assert [r["symbol_id"] for r in w.search_symbols("twice", scope="document", path=path).collect()] == [twice] and w.search_symbols("twice", kind="property").isEmpty()
    project = w.facts["projects"].first()
    assert w.resolve_symbol(qualified_name="Box", project_path=project["path"], project_id=project["project_id"]).count() == 1
    for bad in ({"scope": "folder"}, {"scope": "document"}):
        with pytest.raises(QueryError, match="invalid_request"):
            w.code_fixes(**bad)
    with pytest.raises(QueryError, match="invalid_path"):
        w.search_symbols("twice", scope="document", path="/none.cs")
    for bad in ({}, {"line": 0, "column": 1}, {"line": 99, "column": 1}, {"line": 1, "column": 99}, {"position": 3, "selection_length": -1}):
        with pytest.raises(QueryError, match="invalid_input"):
            w.refactorings(path, **bad)
    line, at = placed(BOX, "string text")
    shown = lambda **k: [r["title"] for r in w.refactorings(path, line=line, column=9, **k).collect()]
    assert shown() == shown(selection_start=at + 2, selection_length=1) == ["Use 'var'"] and shown(selection_start=at + 90, selection_length=5) == []


def test_ambiguous_names_list_their_projects(spark, workspace):
    w = workspace
    again = w.facts["symbols"].where("name = 'Box'").withColumn("symbol_id", F.lit("T:Other.Box")).withColumn("project_id", F.lit("other"))
    w.use({**w.facts, "symbols": w.facts["symbols"].unionByName(again)})
    with pytest.raises(QueryError) as e:
        w.resolve_symbol(qualified_name="Box")
    assert json.loads(e.value.details["candidates"]) == ["T:Demo.Box", "T:Other.Box"] and json.loads(e.value.details["projects"]) == ["Demo", "other"]
    assert w.resolve_symbol(qualified_name="Box", project="Demo").first()["symbol_id"] == "T:Demo.Box"
