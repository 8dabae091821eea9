"""The C# front end on a small sample of our own."""

import pytest

from factgraph.api import Workspace
from factgraph.errors import QueryError
from factgraph.functions import scalars as S
from factgraph.sources import csharp
from factgraph.streaming import ingest

SHAPES = """namespace Demo.Shapes;

/* block { comment */
public interface IShape
{
    double Area(int scale);
}

public abstract class Shape : IShape
{
    private readonly string label = "a { b";
    public static int Count;
    public string Label { get; }

    protected Shape(string label)
    {
        this.label = label;
    }

    public abstract double Area(int scale);
}

public sealed class Circle : Shape
{
    // if (comment)
    public override double Area(int scale)
    {
        if (scale > 1 && scale < 9)
        {
            return Helper(scale);
        }
        return 0;
    }

    private double Helper(int scale) => scale;
}
"""
USER = """using Demo.Shapes;
namespace Demo.App
{
    public class Runner
    {
        public double Run(Circle circle)
        {
            foreach (var x in new int[3]) { Report(x); }
            return circle.Area(2);
        }

        public void Report(int x) { }
    }
}
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    (root / "Demo.sln").write_text("solution")
    for name, text, refs in (("Shapes", SHAPES, ""), ("App", USER, '<ProjectReference Include="..\\Shapes\\Shapes.csproj" />')):
        (root / name).mkdir()
        (root / name / f"{name}.csproj").write_text(f"<Project>{refs}</Project>")
        (root / name / f"{name}.cs").write_text(text)
    return str(root)


def test_facts(spark, folder):
    facts = {k: v.cache() for k, v in csharp.facts(spark, folder).items()}
    found = {r["symbol_id"]: r for r in facts["symbols"].collect()}
    assert {"T:Demo.Shapes.IShape", "T:Demo.Shapes.Shape", "T:Demo.Shapes.Circle", "T:Demo.App.Runner"} <= set(found)
    kinds = {r["name"]: r["member_kind"] for r in found.values() if r["containing_type_id"] == "T:Demo.Shapes.Shape"}
    assert kinds == {"label": "field", "Count": "field", "Label": "property", "Shape": "ctor", "Area": "method"}
    area = found["M:Demo.Shapes.Circle.Area(int)"]
    assert (area["accessibility"], area["line"], area["end_line"], area["return_type"]) == ("public", 26, 33, "double")
    assert found["T:Demo.Shapes.Shape"]["is_abstract"] and found["M:Demo.Shapes.Shape.Count"]["is_static"]
    edges = {(r["type_id"], r["parent_id"], r["edge_kind"]) for r in facts["type_edges"].collect()}
    assert edges == {("T:Demo.Shapes.Shape", "T:Demo.Shapes.IShape", "interface"), ("T:Demo.Shapes.Circle", "T:Demo.Shapes.Shape", "base")}
    calls = {(r["from_id"], r["to_id"]) for r in facts["calls"].collect()}
    assert ("M:Demo.Shapes.Circle.Area(int)", "M:Demo.Shapes.Circle.Helper(int)") in calls
    assert ("M:Demo.App.Runner.Run(Circle)", "M:Demo.App.Runner.Report(int)") in calls
    metrics = {r["symbol_id"]: (r["complexity"], r["line_count"]) for r in facts["metrics"].collect()}
    assert metrics["M:Demo.Shapes.Circle.Area(int)"] == (3, 8) and metrics["M:Demo.App.Runner.Run(Circle)"][0] == 2
    assert {(r[0] != r[1]) for r in facts["project_refs"].collect()} == {True}
    circle = [(r["line"], r["col"]) for r in facts["refs"].where("symbol_id = 'T:Demo.Shapes.Circle'").collect()]
    assert circle == [(6, 27)]


def test_load_and_rename(spark, folder, tmp_path):
    w = Workspace(spark, str(tmp_path / "store"))
    loaded = w.load_solution(folder)
    assert loaded["projects"] == ["App", "Shapes"] and loaded["version"] == 1
    done = w.rename_symbol("M:Demo.Shapes.Circle.Helper(int)", "Assist")
    assert [c["edit_count"] for c in done["changed"]] == [2]
    text = w.facts["documents"].where("path like '%Shapes.cs'").first()["text"]
    assert "return Assist(scale);" in text and "private double Assist(int scale)" in text and "Helper" not in text
    # the new snapshot has the facts of the new texts, so a second rename finds its places
    assert done["version"] == 2 and w.store.versions() == [1, 2]
    assert w.facts["symbols"].where("name = 'Assist'").count() == 1 and w.facts["symbols"].where("name = 'Helper'").isEmpty()
    again = w.rename_symbol("M:Demo.Shapes.Circle.Assist(int)", "Third")
    assert [c["edit_count"] for c in again["changed"]] == [2] and again["version"] == 3
    text = w.facts["documents"].where("path like '%Shapes.cs'").first()["text"]
    assert "return Third(scale);" in text and "Assist" not in text
    with pytest.raises(QueryError, match="invalid_new_name"):
        w.rename_symbol("M:Demo.Shapes.Circle.Third(int)", "class")
    assert loaded["solution"].startswith("/") and [r["symbol_id"] for r in w.search_symbols("third").collect()] == ["M:Demo.Shapes.Circle.Third(int)"]
    # members that implement an interface's member
    assert [r["symbol_id"] for r in w.find_implementations("M:Demo.Shapes.IShape.Area(int)").collect()] == ["M:Demo.Shapes.Circle.Area(int)", "M:Demo.Shapes.Shape.Area(int)"]
    w.store.write({"projects": w.facts["projects"]})  # another writer's snapshot
    with pytest.raises(QueryError, match="workspace_changed"):
        w.rename_symbol("M:Demo.Shapes.Circle.Third(int)", "Fourth")


LOCALS = """namespace Demo.Locals;

public class Box
{
    private readonly int size;
    public const int Most = 3;
    public string Name { get; set; }

    public int Fill(int count)
    {
        int spare = 5;
        int unset;
        int used = count + 1;
        string text = "spare";
        return used + text.Length;
    }
}
"""


def test_smells_fixes_and_refactorings(spark, tmp_path):
    (tmp_path / "Demo.sln").write_text("solution")
    (tmp_path / "Demo.csproj").write_text("<Project/>")
    (tmp_path / "Box.cs").write_text(LOCALS)
    path = str(tmp_path / "Box.cs")
    w = Workspace(spark, str(tmp_path / "store"))
    assert w.load_solution(str(tmp_path))["diagnostics"]["warnings"] == 2
    found = {(r["code"], r["line"], r["col"], r["span_start"], r["span_len"]) for r in w.facts["diagnostics"].collect()}
    assert found == {("CS0219", 11, 13, LOCALS.index("spare"), 5), ("CS0168", 12, 13, LOCALS.index("unset"), 5)}
    shown = {(r["line"], r["title"], r["origin"]) for r in w.find_codesmells(path).collect()}
    assert {(11, "Remove unused local (CS0219)", S.FIX_ORIGIN), (12, "Remove unused local (CS0168)", S.FIX_ORIGIN)} <= shown
    roles = {n: w.explain_symbol(f"M:Demo.Locals.Box.{n}")["role"].first()["role"] for n in ("Name", "size", "Most")}
    assert roles["Name"] == "Name is a read/write property on Box exposing String. It is referenced from 0 locations."
    assert roles["size"] == "size is read-only state on Box with type Int32. It is referenced from 0 locations."
    about = w.explain_symbol("T:Demo.Locals.Box")["role"].first()["role"]
    assert about == "Box is a class in Demo.Locals that owns the runtime behavior. It exposes 1 methods, 1 properties, and 2 fields. Key collaborators: Int32, String. It currently has no discovered incoming references."
    assert roles["Most"] == "Most is constant value on Box with type Int32. It is referenced from 0 locations."
    fixes = w.code_fixes().collect()
    assert [f["diagnostic_id"] for f in fixes] == ["CS0219", "CS0168"]
    assert w.preview_code_fix(fixes[0]["fix_id"]) == [{"path": path, "edit_count": 1, "edits": [{"line": 11, "col": 9, "length": 14, "new_text": ""}]}] and w.version == 1
    assert w.apply_code_fix(fixes[0]["fix_id"]) == {"changed": [{"path": path, "edit_count": 1}], "version": 2}
    assert "int spare" not in w.facts["documents"].first()["text"] and [r["code"] for r in w.facts["diagnostics"].collect()] == ["CS0168"]
    with pytest.raises(QueryError, match="workspace_changed"):
        w.apply_code_fix(fixes[1]["fix_id"])
    with pytest.raises(QueryError, match="fix_not_found"):
        w.apply_code_fix("v1|x")
    text = w.facts["documents"].first()["text"]
    listed = w.refactorings(path, text.index("string text")).collect()
    assert [r["title"] for r in listed] == ["Use 'var'"]
    assert [(r["path"], r["edits"][0]["new_text"]) for r in w.preview_refactoring(listed[0]["action_id"])] == [(path, "var")]
    w.apply_refactoring(listed[0]["action_id"])
    assert 'var text = "spare";' in w.facts["documents"].first()["text"]
    with pytest.raises(QueryError, match="invalid_input"):
        w.refactorings(path, len(text) + 100)


def parse(spark, *texts):
    docs = spark.createDataFrame([(f"d{i}", "p", f"d{i}", t) for i, t in enumerate(texts)], "document_id string, project_id string, path string, text string")
    return csharp.parse(docs)


def test_scopes_end_where_their_block_is_closed(spark):
    text = "class A\n{\n  int F() { return 1; }\n  int G()\n  {\n    if (true) { F(); }\n  }\n  int H() => 2;\n}\nclass B { }\nclass C {\n}\n"
    parsed = parse(spark, text)
    ends = {r["name"]: (r["line"], r["end_line"]) for r in csharp.symbols(parsed["types"], parsed["members"]).collect()}
    assert ends == {"A": (1, 9), "F": (3, 3), "G": (4, 7), "H": (8, 8), "B": (10, 10), "C": (11, 12)}


def test_streaming_follows_files(spark, folder, tmp_path):
    seen = []
    stream = ingest.follow_sources(spark, folder, str(tmp_path / "ck"), lambda facts, n: seen.append(facts["symbols"].where("type_kind is not null").count()), once=True)
    stream.awaitTermination(120)
    assert sum(seen) == 4
