"""The lexer against a plain one, and the front end on sources that trip over lines, names and edits."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from factgraph.api import Workspace
from factgraph.errors import QueryError
from factgraph.operators import refactoring, rewrite
from factgraph.plans import shapes
from factgraph.sources import csharp, lexer, rules
from factgraph.sources.snapshots import SnapshotStore

DOCS = "document_id string, project_id string, path string, text string"


def parse(spark, *texts):
    return csharp.parse(spark.createDataFrame([(f"d{i}", "p", f"d{i}", t) for i, t in enumerate(texts)], DOCS))


def plain_words(text):
    """Words outside of comments and strings, character by character: (start, word)."""
    out, i, n, fresh = [], 0, len(text), True
    while i < n:
        c, two = text[i], text[i : i + 2]
        if c == "#" and fresh or two == "//":
            while i < n and text[i] != "\n":
                i += 1
            continue
        if two == "/*":
            end = text.find("*/", i + 2)
            i, fresh = n if end < 0 else end + 2, False
            continue
        if two == '@"':
            i += 2
            while i < n and not (text[i] == '"' and text[i + 1 : i + 2] != '"'):
                i += 2 if text[i] == '"' else 1
            i, fresh = i + 1, False
            continue
        if c in "\"'":
            i += 1
            while i < n and text[i] != c and text[i] != "\n":
                i += 2 if text[i] == "\\" and i + 1 < n and text[i + 1] != "\n" else 1
            i, fresh = i + (i < n and text[i] == c), False
            continue
        if c.isalpha() or c == "_":
            j = i
            while j < n and (text[j].isalnum() or text[j] == "_"):
                j += 1
            out.append((i, text[i:j]))
            i, fresh = j, False
            continue
        if c.isdigit():
            while i < n and (text[i].isalnum() or text[i] == "_"):
                i += 1
            fresh = False
            continue
        fresh = c == "\n" or (fresh and c.isspace())
        i += 1
    return out


def test_lexer_equals_a_plain_one_on_random_sources():
    rng = random.Random(4)
    bits = ["a", "bc1", " ", "\n", "/*", "*/", "//", '"', "'", "\\", '@"', '""', "{", "}", "(", ")", ";", "#if x\n", "=>", "<", ">", "1", "é", " if ", "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        if '"""' in text:
            continue  # raw strings are another test's
        got = [(r["start"], r["text"]) for r in lexer.statements(text) if r["kind"] == "word"]
        assert got == plain_words(text), repr(text)


def test_lexer_offsets_strings_and_intervals():
    text = 'class A {\n  string s = $"x {F(1):N2} {{no}} {b}" + @"q""/*" + $@"\\{c}" + """raw "/* """;\n  char c = \'"\'; /* a\n b */ int z;\n}\n'
    rows = lexer.statements(text)
    assert all(text[r["start"] : r["start"] + r["length"]] == r["text"] for r in rows if r["kind"] != "string")
    assert [r["text"] for r in rows if r["kind"] == "word"] == ["class", "A", "string", "s", "F", "b", "c", "char", "c", "int", "z"]
    assert [(r["header"], r["line"], r["col"], r["end_line"]) for r in rows if r.get("header")] == [("class A", 1, 1, 5), ("string s", 2, 3, 2), ("char c", 3, 3, 3), ("int z", 4, 7, 4)]
    # intervals nest: a statement lies within the one that owns it
    by = {r["i"]: r for r in rows if r.get("header")}
    assert all(r["owner"] == -1 or (by[r["owner"]]["start"] <= r["start"] and r["end"] <= by[r["owner"]]["end"]) for r in by.values())
    for broken in ("}", "class {", "((", 'class A { void F() { "', "a } b { c", "[", "", "\n\n"):
        lexer.statements(broken)


TRICKY = """/* one
   class Ghost { void Run() { Helper(); } }
   three */
namespace N;

public interface IRun { void Go(); int Many(int a,
    string b); }

public class T : IRun
{
    string mark = "/*";
    public void Go() { Helper(); }
    string verbatim = @"c:\\";
    public int Many(int a,
        string b)
    {
        return a; // Helper();
    }
    private void Helper() { }
    void After() { try { Go(); } catch { } }
    string end = "*/";
}
"""


def test_comments_strings_one_line_types_and_split_parameters(spark):
    parsed = parse(spark, TRICKY)
    found = {r["symbol_id"]: (r["line"], r["col"], r["end_line"]) for r in csharp.symbols(parsed["types"], parsed["members"]).collect()}
    assert found == {
        "T:N.IRun": (6, 18, 7), "M:N.IRun.Go()": (6, 30, 6), "M:N.IRun.Many(int, string)": (6, 40, 7), "T:N.T": (9, 14, 22), "M:N.T.mark": (11, 12, 11), "M:N.T.Go()": (12, 17, 12), "M:N.T.verbatim": (13, 12, 13),
        "M:N.T.Many(int, string)": (14, 16, 18), "M:N.T.Helper()": (19, 18, 19), "M:N.T.After()": (20, 10, 20), "M:N.T.end": (21, 12, 21),
    }
    # the built-in rules, one of our own that fails, and one that works
    def broken(_):
        raise RuntimeError("no such thing")

    late = lambda p: p["statements"].select((1 / F.lit(0)).cast("string").alias("code"))
    own = lambda p: p["types"].select(F.lit("X1").alias("code"), F.col("path").alias("file"))
    diagnostics, failed = rules.run(parsed, {"broken": broken, "late": late, "own": own})
    assert sorted(r["code"] for r in diagnostics.collect()) == [rules.EMPTY_CATCH, "X1", "X1"]
    assert set(failed) == {"broken", "late"} and "no such thing" in failed["broken"]


def project(root, name, text, refs=()):
    (root / name).mkdir(exist_ok=True)
    listed = "".join(f'<ProjectReference Include="..\\{r}\\{r}.csproj" />' for r in refs)
    (root / name / f"{name}.csproj").write_text(f"<Project>{listed}</Project>")
    (root / name / f"{name}.cs").write_text(text)


def test_equal_names_bind_in_their_own_project_and_a_solution_loads_its_own(spark, tmp_path):
    core = "namespace {0};\npublic class Base {{ public virtual int Id() => 1; }}\npublic class Child : Base {{ public int Use() => Id() + new Base().Id(); }}\n"
    project(tmp_path, "N", core.format("N"))
    project(tmp_path, "M", core.format("M"))
    project(tmp_path, "App", "using N;\nnamespace App;\nclass Run { Base kept = new Base(); int Go(Child c, M.Base hidden) { var made = new Child(); return c.Use() + made.Use() + kept.Id() + this.kept.Id(); } }\n", ["N"])
    (tmp_path / "One.sln").write_text('Project("{x}") = "App", "App\\App.csproj", "{y}"\nEndProject\n')
    (tmp_path / "Two.sln").write_text('Project("{x}") = "M", "M\\M.csproj", "{y}"\nEndProject\n')
    w = Workspace(spark, str(tmp_path / "store"))
    assert w.load_solution(str(tmp_path), "two.sln")["projects"] == ["M"] and w.facts["symbols"].where("project_id is null").count() == 0
    (tmp_path / "M" / "More.cs").write_text("namespace M; enum Late { One, Two = 2 }")
    assert w.reload()["projects"] == ["M"] and w.version == 2
    assert {r[0] for r in w.facts["symbols"].where("name in ('Late', 'One', 'Two')").select("symbol_id").collect()} == {"T:M.Late", "M:M.Late.One", "M:M.Late.Two"}
    rows, _ = csharp.projects(spark, str(tmp_path), solution=str(tmp_path / "One.sln"))
    assert {r["name"] for r in rows.collect()} == {"App", "N"}
    facts = csharp.facts(spark, str(tmp_path))
    edges = {(r["type_id"], r["parent_id"]) for r in facts["type_edges"].collect()}
    assert edges == {("T:N.Child", "T:N.Base"), ("T:M.Child", "T:M.Base")}
    calls = sorted((r["from_id"], r["to_id"]) for r in facts["calls"].collect())
    assert calls == sorted([(f"M:{p}.Child.Use()", f"M:{p}.Base.Id()") for p in "MN"] * 2 + [("M:App.Run.Go(Child, M.Base)", "M:N.Child.Use()")] * 2 + [("M:App.Run.Go(Child, M.Base)", "M:N.Base.Id()")])
    seen = {(r["symbol_id"], r["line"], r["col"]) for r in facts["refs"].where("file like '%App.cs'").collect()}
    assert ("T:N.Child", 3, 44) in seen and not any(s.startswith(("T:M", "M:M")) for s, _, _ in seen)


def same(spark, a, b, skip=("projects", "project_refs")):
    for name in sorted(set(a) - set(skip)):
        x, y = (csharp.conform(name, t[name]) for t in (a, b))
        left, right = (sorted(map(repr, t.collect())) for t in (x, y))
        assert left == right, (name, [r for r in left if r not in right][:3], [r for r in right if r not in left][:3])


def test_facts_after_an_edit_equal_a_full_rebuild(spark, tmp_path):
    texts = {
        "a": "namespace A;\npublic class Root { public int Top() => 1; }\npublic class Mid : Root { public Leaf leaf; }\n", "b": "using A;\nnamespace B;\nclass User { Mid mid; int F() => mid.Top() + mid.leaf.Deep(); }\n",
        "c": "namespace A;\npublic class Leaf { public int Deep() => 2; }\n", "d": "namespace D;\nclass Alone { void Nothing() { int dead = 1; } }\n",
    }
    none = spark.createDataFrame([], "src_project_id string, dst_project_id string"), spark.createDataFrame([("p", "p", "/p.csproj", 1)], "project_id string, name string, path string, snapshot_version int")
    frame = lambda t: spark.createDataFrame([(k, "p", k, v, "HandWritten") for k, v in t.items()], DOCS + ", source_kind string")
    old = {k: shapes.cut_lineage(csharp.conform(k, v)) for k, v in csharp.facts_of(none[1], none[0], frame(texts)).items()}
    changed = {**texts, "a": texts["a"].replace(": Root", "").replace("Leaf leaf", "Leaf other"), "d": texts["d"].replace("dead", "gone")}
    found, again = csharp.facts_after(old, frame({k: changed[k] for k in "ad"}))
    assert {r[0] for r in again.collect()} == {"a", "b", "d"}
    same(spark, found, csharp.facts_of(none[1], none[0], frame(changed)))
    _, again = csharp.facts_after(old, frame({"d": changed["d"]}))
    assert [r[0] for r in again.collect()] == ["d"]
    assert csharp.facts_after(old, frame({"d": "global using A;\n" + texts["d"]})) is None


def test_one_of_two_writers_wins(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    table = spark.createDataFrame([("p", "one", "/p", 1)], "project_id string, name string, path string, snapshot_version int")
    assert store.write({"projects": table}) == 1
    ready, done = threading.Barrier(2), []

    def writer(name):
        ready.wait()
        try:
            done.append((name, store.write({"projects": table.withColumn("name", F.lit(name))}, after=1)))
        except QueryError as e:
            done.append((name, e.code))

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("left", "right")]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert sorted(str(x) for _, x in done) == ["2", "workspace_changed"] and store.versions() == [1, 2]
    winner = next(n for n, x in done if x == 2)
    assert [r["name"] for r in store.read(2)["projects"].collect()] == [winner] and [r["name"] for r in store.read(1)["projects"].collect()] == ["one"]
    # beyond a check, a version that is there is never linked again
    assert not store._commit(2, "elsewhere") and [r["name"] for r in store.read(2)["projects"].collect()] == [winner]


def test_edits_meet_the_text_they_replace(spark):
    docs = spark.createDataFrame([("d", "p", "d", "one two\n  int dead = 1;\nthree")], DOCS)
    edit = lambda *rows: rewrite.apply_edits(docs, spark.createDataFrame(list(rows), "path string, line int, col int, length int, new_text string, old_text string")).first()
    assert edit(("d", 1, 5, 3, "zwei", "two"))["text"].startswith("one zwei\n")
    for bad in ([("d", 1, 5, 3, "x", "tow")], [("d", 9, 1, 1, "x", None)], [("d", 1, 1, 4, "x", None), ("d", 1, 3, 2, "y", None)]):
        assert (edit(*bad)["edit_count"], edit(*bad)["text"]) == (-1, "one two\n  int dead = 1;\nthree")
    assert edit(("d", 2, 3, 13, "", None))["text"] == "one two\n\nthree"


def test_cleanup_runs_to_a_fixed_point(spark):
    text = "using B;\nusing A;\nnamespace N {\n    using D;\n    using C;\n    class T {\n        int F() {\n            int a = 1;\n            int b = a;\n            int kept = Next();\n            int used = 2; return used;\n        }\n        int Next() => 1;\n    }\n}\n"
    docs = spark.createDataFrame([("d", "p", "d", text), ("e", "p", "e", "class E { }")], DOCS)
    none = spark.createDataFrame([], "code string, file string, line int")
    after, changed = refactoring.cleanup(docs, none, 1)
    want = text.replace("using B;\nusing A;", "using A;\nusing B;").replace("    using D;\n    using C;", "    using C;\n    using D;").replace("            int a = 1;\n            int b = a;\n", "\n\n")
    assert after.where("path = 'd'").first()["text"] == want and [r[0] for r in changed.collect()] == ["d"]
    once, _ = refactoring.cleanup(docs, none, 1, passes=1)
    assert "int a = 1;" in once.where("path = 'd'").first()["text"]  # read by b until b is gone


def test_long_spans_are_joined_by_coarser_blocks(spark):
    points = spark.createDataFrame([("k", p) for p in (0, 5, 1023, 1024, 5_000_000, 2_000_000_000)], "file string, at int")
    spans = spark.createDataFrame([("k", 0, 2_100_000_000, "all"), ("k", 5, 1, "one"), ("k", 1000, 5_000_000, "long"), ("k", 7, 0, "none")], "file string, start int, len int, name string")
    got = {(r["at"], r["name"]) for r in shapes.range_join(points, spans, "file", "at", "start", "len").collect()}
    assert got == {(p, "all") for p in (0, 5, 1023, 1024, 5_000_000, 2_000_000_000)} | {(5, "one"), (1023, "long"), (1024, "long"), (5_000_000, "long")}


def test_texts_of_one_file_are_cut_by_several_tasks(spark):
    """Texts that lie in one partition were all cut by one task; batches hold tokens of several documents."""
    line = "class C { string s = \"x\"; int M(List<int> a) { return a.Count(1, 2) + 1; } }\n"
    texts = [None, "", line, *[line * (20 + k) + f"/* {'x' * 30_000} */" for k in range(12)], line * 800, "// nothing\n"]
    docs = spark.createDataFrame([(f"/d{k}.cs", str(k % 3), f"/p{k}.cs", t) for k, t in enumerate(texts)], "document_id string, project_id string, path string, text string").coalesce(1)
    found = lexer.tokens(docs)
    assert found.rdd.getNumPartitions() > 1
    got: dict = {}
    for r in found.collect():
        got.setdefault((r["document_id"], r["project_id"], r["path"]), []).append(r.asDict(recursive=True))
    for k, t in enumerate(texts):
        own = {"document_id": f"/d{k}.cs", "project_id": str(k % 3), "path": f"/p{k}.cs"}
        want = [{f.name: {**r, **own}.get(f.name) for f in found.schema} for r in lexer.statements(t or "")]
        assert sorted(got.get(tuple(own.values()), []), key=lambda r: r["i"]) == want


def test_edits_of_a_batch_are_not_all_objects_at_once():
    """A batch has 10,000 documents with all their edits, which took some hundred bytes an edit in each Python worker."""
    import tracemalloc

    import pyarrow as pa

    edit = {"line": 1, "col": 1, "length": 3, "new_text": "those", "old_text": "the"}
    edits = [[{**edit, "line": k + 1} for k in range(20)]] * 2000
    columns = [[f"d{i}" for i in range(2000)], [f"p{i}" for i in range(2000)], ["the x\n" * 20] * 2000]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(edits)], names=["document_id", "path", "text", "edits"])
    tracemalloc.start()
    rows, peak = 0, 0
    for part in rewrite._edited(iter([batch])):
        rows += part.num_rows
        assert part.column(2).to_pylist() == ["those x\n" * 20] * part.num_rows and set(part.column(3).to_pylist()) == {20}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 3_000_000


def test_tokens_of_a_text_are_columns():
    """A token was a dict of its own until its batch was written, which took most of the time of cutting a text."""
    import tracemalloc

    text = "class C { int M(int a, int b) { if (a > b) { return a + 1; } return M(b, a); } }\n" * 400
    n = lexer._record([(("d", "p", "p"), text, lexer._columns(text))]).num_rows
    tracemalloc.start()
    record = lexer._record([(("d", "p", "p"), text, lexer._columns(text))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert record.num_rows == n and peak < 500 * n


def test_only_tables_that_are_asked_for_are_written(spark):
    parsed = parse(spark, TRICKY)
    assert parsed["types"].count() and set(parsed) == {"tokens", "statements", "types"}


def test_declarations_need_no_tokens(spark):
    """Queries for declarations wrote a row per token, which were most of their rows, and tested every statement for all kinds of declarations."""
    docs = spark.createDataFrame([("d0", "p", "d0", TRICKY)], DOCS)
    bare, full = csharp.parse(docs, whole=False), csharp.parse(docs)
    for name in ("types", "members", "functions", "places"):
        got, want = ([r.asDict(recursive=True) for r in t[name].collect()] for t in (bare, full))
        assert sorted(map(str, got)) == sorted(map(str, want)) and (got or name == "functions")
    assert "tokens" not in bare
    # a statement that stands in no type is no candidate for a member
    assert {r["in_type"] for r in bare["members"].collect()} == {True} and not bare["statements"].where("in_type").join(bare["functions"], ["document_id", "head"]).count()


def test_a_text_without_directives_and_holes_is_cut_alike():
    for text in ('class C { string s = "a\\"b"; /* x */ char c = \'\\\'\'; }\n', "a // b\n\t@\"x\"\"y\" 1.5f => ?? x", '"""raw "x" """ é_1 \x00'):
        fast, slow = lexer.cut(text), lexer.cut(text + "\n#")
        assert fast == slow and fast


def test_blanks_before_a_token_are_part_of_its_match():
    """Each blank and comment was a match of its own, so a text took twice as many matches as it has tokens."""
    for text in (TRICKY, "", " ", "a ", "// a", "/* a", "/* a */ /", "\n x // b\n /* c */ y \n // d"):
        assert "#" not in text and "$" not in text
        matches = list(lexer._PLAIN.finditer(text))
        assert len(matches) <= len(lexer.cut(text)) + 2 and "".join(m.group() for m in matches) == text
    assert [(k, a, b) for k, a, b in lexer.cut("/* a */ x // b\n")] == [("word", 8, 9)]


def test_what_kind_a_member_has_is_found_once(spark):
    """A filter on the kind had all patterns tested in a join's condition, and again for the rows that met it."""
    parsed = parse(spark, TRICKY)
    tested = csharp.tested_members(parsed["statements"], parsed["types"])
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = tested._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count(csharp.METHOD) == 1 and plan.count(csharp.EVENT) == 2  # to tell the kind, and for its groups
    # what is no member is left out of the written rows alone
    rows = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    assert rows(csharp.member_declarations(parsed["statements"], parsed["types"])) == rows(parsed["members"]) == rows(tested.where("member_kind is not null")) != []


def test_modifiers_are_words_of_what_stands_before_a_name(spark):
    parsed = parse(spark, "class A { public static int a; protected internal int b; private protected int c; statics d; const int e = 1; abstract void F(); internal sealed partial class G { } }")
    got = {r["name"]: (r["accessibility"], r["is_static"], r["is_abstract"], r["is_const"], r["is_partial"]) for r in csharp.symbols(parsed["types"], parsed["members"]).collect()}
    assert got["a"] == ("public", True, False, False, False) and got["b"][0] == "protected_internal" and got["c"][0] == "private_protected" and got["d"] == ("private", False, False, False, False)
    assert got["e"][1:4] == (True, False, True) and got["F"][2] and got["G"] == ("internal", False, False, False, True) and got["A"][0] == "internal"
