"""The fourteen entry queries over a snapshot, with their defaults, validation and errors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError, require
from .functions import codecs
from .functions import scalars as S
from .operators import callgraph, explain, hierarchy, listing, metrics, projects, refactoring, references, resolve, rewrite, smells
from .plans.shapes import cut_lineage, page, single_row
from .sources import csharp
from .sources.snapshots import SnapshotStore


class Workspace:
    """One workspace: a store of snapshots, and the facts of the current one."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, SnapshotStore(spark, store)
        self.version: int | None = None
        self.facts: dict[str, DataFrame] = {}
        self.from_source = False
        self.root: str | None = None
        self.solution: str | None = None

    # loading

    def load_solution(self, root: str, hint: str | None = None) -> dict:
        """Derive the facts of a solution's projects into a new snapshot; the hint selects the solution, else it is the first by path.

        A solution that lists no project stands for all projects below the folder.
        """
        root = require(root, "root", "invalid_path")
        found = [r[0] for r in csharp.discover(self.spark, root).collect()]  # solution files of one folder
        wanted = S.text_or_none(hint)
        chosen = [p for p in found if p.lower().endswith(wanted.lower())] if wanted else found
        if not chosen:
            raise QueryError("solution_not_found", "no solution file was found", root=root, hint=wanted)
        self.root, self.solution = root, chosen[0]
        return self._load()

    def reload(self) -> dict:
        """Derive the facts of the selected solution again, as a new snapshot."""
        if self.solution is None:
            raise QueryError("solution_not_selected", "no solution is loaded")
        return self._load()

    def _load(self) -> dict:
        self.version = self.store.write(csharp.facts(self.spark, self.root, solution=self.solution))
        self.facts, self.from_source = self.store.read(self.version), True
        names = [r[0] for r in self.facts["projects"].select("name").orderBy("name").collect()]
        return {"solution": self.solution, "version": self.version, "projects": names, "diagnostics": metrics.diagnostic_summary(self.facts["diagnostics"]).first().asDict()}

    def use(self, facts: dict[str, DataFrame], version: int = 1) -> "Workspace":
        """Take facts as they are, for facts from elsewhere."""
        self.facts, self.version, self.from_source = facts, version, False
        return self

    def _fact(self, name: str) -> DataFrame:
        if name not in self.facts:
            raise QueryError("solution_not_selected", "no solution is loaded")
        return self.facts[name]

    # selectors

    def _symbol(self, symbol_id: str | None = None, path: str | None = None, line: int | None = None, column: int | None = None) -> str:
        """The id given, or that of the innermost symbol at a position."""
        if S.text_or_none(symbol_id):
            symbol_id = symbol_id.strip()
            if self._fact("symbols").where(F.col("symbol_id") == symbol_id).isEmpty():
                raise QueryError("symbol_not_found", "no symbol has this id", symbolId=symbol_id)
            return symbol_id
        if not S.text_or_none(path) or line is None or column is None:
            raise QueryError("invalid_input", "a symbol id or a position is needed")
        line = max(line, 1)
        inside = self._fact("symbols").where(S.same_ignoring_case(F.col("file"), path.strip()) & (F.col("line") <= line) & (F.coalesce("end_line", "line") >= line))
        row = inside.orderBy(F.coalesce("end_line", "line") - F.col("line"), F.col("line").desc(), "symbol_id").select("symbol_id").first()
        if row is None:
            raise QueryError("symbol_not_found", "no symbol is declared there", path=path)
        return row[0]

    def _type(self, **selector) -> str:
        symbol = self._symbol(**selector)
        row = self._fact("symbols").where(F.col("symbol_id") == symbol).select("type_kind", "containing_type_id").first()
        found = symbol if row["type_kind"] is not None else row["containing_type_id"]
        if found is None:
            raise QueryError("invalid_input", "the symbol is no type", symbolId=symbol)
        return found

    # the entry queries

    def understand_codebase(self, profile: str | None = None) -> dict[str, DataFrame]:
        fan = projects.module_fan(self._fact("projects"), self._fact("project_refs"))
        visible = self._fact("symbols").where(S.is_visible(F.col("file")))
        shown = self._fact("metrics").join(visible.select("symbol_id"), "symbol_id", "left_semi")
        return {"modules": fan.orderBy((F.col("outgoing") + F.col("incoming")).desc(), "name"), "hotspots": metrics.hotspots(shown, visible, profile)}

    def list_dependencies(self, path: str | None = None, name: str | None = None, id: str | None = None, direction: str | None = None) -> DataFrame:
        if sum(S.text_or_none(x) is not None for x in (path, name, id)) != 1:
            raise QueryError("invalid_input", "exactly one of path, name and id is needed")
        project = projects.select_project(self._fact("projects"), path, name, id)
        return projects.dependencies(self._fact("projects"), self._fact("project_refs"), project, direction).orderBy("source_name", "src_project_id", "target_name", "dst_project_id")

    def list_types(self, path: str | None = None, name: str | None = None, id: str | None = None, namespace_prefix: str | None = None, kind: str | None = None, accessibility: str | None = None, limit: int | None = None, offset: int | None = None) -> tuple[int, DataFrame]:
        if not any(S.text_or_none(x) for x in (path, name, id)):
            raise QueryError("invalid_input", "a project selector is needed")
        project = projects.select_project(self._fact("projects"), path, name, id)
        rows = listing.types(self._fact("symbols"), project, namespace_prefix, kind, accessibility)
        return rows.count(), page(rows, listing.type_order(), *S.page_bounds(limit, offset))

    def list_members(self, symbol_id: str | None = None, path: str | None = None, line: int | None = None, column: int | None = None, kind: str | None = None, accessibility: str | None = None, binding: str | None = None, include_inherited: bool = False, limit: int | None = None, offset: int | None = None) -> tuple[int, DataFrame]:
        owner = self._type(symbol_id=symbol_id, path=path, line=line, column=column)
        rows = listing.members(self._fact("symbols"), self._fact("type_edges"), owner, kind, accessibility, binding, include_inherited)
        return rows.count(), page(rows, listing.member_order(), *S.page_bounds(limit, offset))

    def resolve_symbol(self, symbol_id: str | None = None, path: str | None = None, line: int | None = None, column: int | None = None, qualified_name: str | None = None, project: str | None = None, project_path: str | None = None, project_id: str | None = None) -> DataFrame:
        if not S.text_or_none(qualified_name) or S.text_or_none(symbol_id) or S.text_or_none(path):
            return resolve.descriptor(resolve.by_id(self._fact("symbols"), self._symbol(symbol_id, path, line, column)))
        found = resolve.by_name(self._fact("symbols"), qualified_name)
        if any(S.text_or_none(x) for x in (project, project_path, project_id)):
            found = found.where(F.col("project_id") == projects.select_project(self._fact("projects"), project_path, project, project_id))
        n = found.limit(2).count()
        if n == 0:
            raise QueryError("symbol_not_found", "no symbol has this name", qualifiedName=qualified_name)
        if n > 1:
            names = self._fact("projects").groupBy("project_id").agg(F.min("name").alias("project"))
            first = found.orderBy(F.col("type_kind").isNull(), "display_min", "project_id", "symbol_id").limit(20).join(names, "project_id", "left")
            candidates = first.orderBy(F.col("type_kind").isNull(), "display_min", "project_id", "symbol_id").select("symbol_id", F.coalesce("project", "project_id")).collect()
            raise QueryError("ambiguous_symbol", "several symbols have this name", candidates=json.dumps([r[0] for r in candidates]), projects=json.dumps([r[1] for r in candidates]))
        return resolve.descriptor(found)

    def explain_symbol(self, symbol_id: str | None = None, path: str | None = None, line: int | None = None, column: int | None = None) -> dict[str, DataFrame]:
        symbol = self._symbol(symbol_id, path, line, column)
        refs, rows = self._fact("refs"), self._fact("symbols")
        counts = references.usages(refs, symbol).agg(F.count(F.lit(1)).alias("n")).withColumn("symbol_id", F.lit(symbol))
        inside = rows.where(F.col("containing_type_id") == symbol)
        role = explain.role_text(rows.where(F.col("symbol_id") == symbol), listing.member_shape(inside), counts, explain.collaborators(inside))
        return {"role": role, "key_references": references.key_references(refs, symbol), "impact_hints": references.impact_hints(refs, symbol)}

    def trace_call_flow(self, symbol_id: str | None = None, path: str | None = None, line: int | None = None, column: int | None = None, direction: str | None = None, depth: int | None = None) -> dict[str, DataFrame]:
        symbol = self._symbol(symbol_id, path, line, column)
        edges = callgraph.visible_edges(callgraph.trace(self._fact("calls"), symbol, direction, depth), self._fact("symbols"))
        moves = callgraph.transitions(edges)
        return {"edges": edges.orderBy("from_id", "to_id", "file", "line", "col"), "transitions": moves.orderBy(F.desc("count"), "from_project", "to_project")}

    def find_callers(self, symbol_id: str | None) -> DataFrame:
        return self.trace_call_flow(require(symbol_id, "symbolId"), direction="upstream", depth=1)["edges"]

    def find_usages(self, symbol_id: str | None, scope: str = "solution", path: str | None = None) -> DataFrame:
        symbol = self._symbol(require(symbol_id, "symbolId"))
        if scope == "document" and path and self._fact("documents").where(S.same_ignoring_case(F.col("path"), path)).isEmpty():
            raise QueryError("invalid_path", "the document isn't loaded", path=path)
        owner = self._fact("symbols").where(F.col("symbol_id") == symbol).select("project_id").first()[0]
        return references.usages(self._fact("refs"), symbol, scope, path, owner).orderBy(*references.LOCATION)

    def find_implementations(self, symbol_id: str | None) -> DataFrame:
        symbol = self._symbol(require(symbol_id, "symbolId"))
        found = hierarchy.implementations(self._fact("type_edges"), self._fact("impl_edges"), self._fact("symbols"), symbol)
        return resolve.descriptor(found).orderBy(*resolve.descriptor_order())

    def get_type_hierarchy(self, symbol_id: str | None, include_transitive: bool = True, max_derived: int = 200) -> dict[str, DataFrame]:
        symbol = self._type(symbol_id=require(symbol_id, "symbolId"))
        edges, rows = self._fact("type_edges"), self._fact("symbols")
        named = lambda ids: resolve.descriptor(rows.join(ids.select("id"), F.col("symbol_id") == F.col("id"), "left_semi")).orderBy(*resolve.descriptor_order())
        return {
            "bases": named(hierarchy.bases(edges, symbol, include_transitive)), "interfaces": named(hierarchy.interfaces(edges, symbol, include_transitive)),
            "derived": named(hierarchy.derived(edges, symbol, include_transitive, None)).limit(max(max_derived, 0)),
        }

    def find_codesmells(self, path: str | None, max_findings: int | None = None, risk_levels: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
        return self.codesmells(path, max_findings, risk_levels, categories)["findings"]

    def codesmells(self, path: str | None, max_findings: int | None = None, risk_levels: list[str] | None = None, categories: list[str] | None = None) -> dict:
        """Findings of a document, and warnings about anchors cut off and findings that repeat; what they count is observed in the jobs that find, so nothing is scanned for it."""
        path = require(path, "path", "invalid_path")
        here = lambda df, c="file": df.where(S.same_ignoring_case(F.col(c), path))
        match here(self._fact("documents"), "path").limit(2).count():
            case 0:
                raise QueryError("invalid_path", "the document isn't loaded", path=path)
            case 2:
                raise QueryError("invalid_path", "several loaded documents have this path", path=path)
        anchored, matched, kept, n = Observation(), Observation(), Observation(), F.count(F.lit(1)).alias("n")
        at = cut_lineage(smells.first_anchors(smells.anchors(here(self._fact("diagnostics")), here(self._fact("nodes"), "document_id")).observe(anchored, n)))
        found = smells.matches(at, here(self._fact("actions")))
        found = smells.chosen(found.unionByName(smells.unanswered(at, found)), risk_levels, categories)
        if max_findings is not None:
            found = smells.first_found(found, max_findings)
        rows = cut_lineage(smells.dedup(found.observe(matched, n)).observe(kept, n))
        anchors, matches, left = (o.get.get("n", 0) for o in (anchored, matched, kept))
        warnings = []
        if anchors > smells.MAX_ANCHORS:
            warnings.append(f"Only the first {smells.MAX_ANCHORS} of {anchors} anchors were looked at.")
        if matches > left:
            warnings.append(f"{matches - left} findings that repeat title, category and line are left out.")
        if not left and (risk_levels is not None or categories is not None):
            warnings.append("No finding has the wanted risk levels and categories.")
        return {"findings": rows.orderBy("file", "line", "col", "title", "category", "origin"), "warnings": warnings}

    def rename_symbol(self, symbol_id: str | None, new_name: str | None) -> dict:
        """Rename a symbol in a new snapshot; returns the changed files and the new version."""
        symbol = self._symbol(require(symbol_id, "symbolId"))
        rewrite.check_identifier(new_name)
        rows = self._fact("symbols")
        old = rows.where(F.col("symbol_id") == symbol).select("name").first()[0]
        clash = rewrite.conflicts(rows, rows.where(F.col("symbol_id") == symbol).select("symbol_id", F.lit(new_name).alias("new_name")))
        if not clash.isEmpty():
            raise QueryError("rename_conflict", "a sibling has the new name", newName=new_name)
        places = rewrite.affected(rows, self._fact("refs"), symbol)
        touched = places.orderBy(*references.LOCATION)
        changed = self._edit(rewrite.rename_edits(places, old, new_name))
        return {"changed": changed, "affected": touched, "version": self.version}

    def _edit(self, edits: DataFrame) -> list[dict]:
        """Apply edits; facts of the new texts become a new snapshot.  Returns the changed files.

        Only the changed documents, and those in which a name may mean something else now, are derived
        again.  Facts that didn't come from sources (``use``) only have their texts changed, in memory.
        """
        before = self._fact("documents")
        touched = before.join(edits.select("path").distinct(), "path", "left_semi")
        after = cut_lineage(rewrite.apply_edits(touched, edits))
        if not after.where("edit_count < 0").isEmpty():
            raise QueryError("stale_workspace_snapshot", "a text isn't what the facts say, or edits overlap")
        changed = [r.asDict() for r in rewrite.changed_files(touched, after).orderBy("path").collect()]  # files that are edited
        texts = touched.drop("text").join(after.select("document_id", "text"), "document_id").select(*before.columns)
        return self._changed(texts) or changed

    def _changed(self, texts: DataFrame) -> None:
        """The next snapshot, in which documents have these texts."""
        before = self._fact("documents")
        if not self.from_source:
            self.facts, self.version = {**self.facts, "documents": before.join(texts.select("document_id"), "document_id", "left_anti").unionByName(texts)}, (self.version or 0) + 1
            return
        self.store.check_current(self.version)
        found = csharp.facts_after(self.facts, texts)
        if found is None:
            whole = before.join(texts.select("document_id"), "document_id", "left_anti").unionByName(texts)
            facts = csharp.facts_of(self.facts["projects"], self.facts["project_refs"], cut_lineage(whole))
        else:
            facts = found[0]
        self.version = self.store.write(facts, after=self.version)
        self.facts = self.store.read(self.version)

    def execute_cleanup(self, path: str | None = None, expected_version: int | None = None, profile: str | None = None) -> dict:
        """Clean up one document or all, with the current snapshot's diagnostics; returns the changed files and the new version."""
        docs, found = self._fact("documents"), self._fact("diagnostics")
        if S.text_or_none(path):
            docs = docs.where(S.same_ignoring_case(F.col("path"), path.strip()))
            if docs.isEmpty():
                raise QueryError("invalid_path", "the document isn't loaded", path=path)
        after, changed = refactoring.cleanup(docs, found, self.version, expected_version, profile)
        paths = sorted(r[0] for r in changed.collect())  # files that are edited
        if paths:
            self._changed(after.join(changed, "path", "left_semi").select(*docs.columns))
        return {"rules": list(refactoring.STEPS), "changed": paths, "version": self.version}

    # the operators behind the entry queries, on the current snapshot

    def search_symbols(self, text: str, limit: int | None = None, offset: int | None = None, kind: str | None = None, accessibility: str | None = None, scope: str = "solution", path: str | None = None) -> DataFrame:
        """Symbols of a name in the scope, in the order of descriptors."""
        where = self._scope(scope, path)
        found = resolve.search(self._fact("symbols"), require(text, "query"), S.text_or_none(kind), S.text_or_none(accessibility), where.get("project_id"), where.get("path"))
        return page(resolve.descriptor(found), resolve.descriptor_order(), *S.page_bounds(limit, offset))

    def _scope(self, scope: str, path: str | None, code: str = "invalid_request") -> dict:
        """The path of a document scope or the project_id of a project scope; a project is named by its file or by one of its documents."""
        path = S.text_or_none(path)
        if scope not in ("document", "project", "solution"):
            raise QueryError(code, "scope must be one of: document, project, solution", parameter="scope", value=scope)
        if scope == "solution" or (scope == "project" and path is None):
            return {}
        if path is None:
            raise QueryError(code, "a document scope needs a path", parameter="path")
        inside = lambda df: df.where(S.same_ignoring_case(F.col("path"), path)).select("project_id")
        found = inside(self._fact("documents"))
        row = (found if scope == "document" else inside(self._fact("projects")).unionByName(found)).first()
        if row is None:
            raise QueryError("invalid_path", "no loaded document or project has this path", path=path)
        return {"path": path} if scope == "document" else {"project_id": row[0]}

    def symbol_at(self, path: str, line: int, column: int) -> DataFrame:
        """Descriptor of the innermost symbol declared around a position."""
        return self.resolve_symbol(path=path, line=line, column=column)

    def signature(self, symbol_id: str | None) -> str:
        return resolve.by_id(self._fact("symbols"), self._symbol(require(symbol_id, "symbolId"))).select("display_min").first()[0]

    def symbol_outline(self, symbol_id: str | None, depth: int | None = None) -> DataFrame:
        """Members of a type and of those nested in it, to a depth of 1 to 3."""
        symbol, rows = self._type(symbol_id=require(symbol_id, "symbolId")), self._fact("symbols")
        kinds = rows.where("type_kind is not null")
        around = kinds.select(F.col("display_err").alias("containing_type_fq"), "project_id", F.col("symbol_id").alias("parent_id"))
        nesting = kinds.join(around, ["containing_type_fq", "project_id"]).select(F.col("symbol_id").alias("type_id"), "parent_id")
        return listing.outline(rows, nesting, symbol, 1 if depth is None else depth).orderBy("name", "kind", "signature", "accessibility", "is_static")

    def callers(self, symbol_id: str | None, max_depth: int | None = None) -> DataFrame:
        """Edges up to a depth, at least 1; unlike ``find_callers``, those of generated sources are shown too."""
        return self.call_graph(symbol_id, "upstream", max_depth)["edges"]

    def callees(self, symbol_id: str | None, max_depth: int | None = None) -> DataFrame:
        return self.call_graph(symbol_id, "downstream", max_depth)["edges"]

    def call_graph(self, symbol_id: str | None, direction: str | None = None, max_depth: int | None = None) -> dict:
        """Edges of the graph around a symbol, with its numbers of nodes and edges."""
        symbol = self._symbol(require(symbol_id, "symbolId"))
        edges = callgraph.trace(self._fact("calls"), symbol, direction, 1 if max_depth is None else max_depth)
        return {"edges": edges.orderBy("from_id", "to_id", "file", "line", "col"), "counts": callgraph.graph_counts(edges, symbol)}

    def code_metrics(self, scope: str = "solution", path: str | None = None) -> DataFrame:
        """Complexity and lines of each measured symbol of the scope, in order of id."""
        where, rows = self._scope(scope, path, "invalid_input"), self._fact("symbols")
        if "path" in where:
            rows = rows.where(S.same_ignoring_case(F.col("file"), where["path"]))
        elif where:
            rows = rows.where(F.col("project_id") == where["project_id"])
        return self._fact("metrics").join(rows.select("symbol_id"), "symbol_id", "left_semi").orderBy("symbol_id")

    def analyze(self, scope: str = "solution", path: str | None = None) -> dict[str, DataFrame]:
        """Diagnostics and metrics of the scope, and the number of diagnostics by severity."""
        where = self._scope(scope, path, "invalid_input")
        found = metrics.diagnostics_in(self._fact("diagnostics"), scope, **where)
        return {"diagnostics": found.orderBy(*metrics.diagnostic_order()), "summary": metrics.diagnostic_summary(found), "metrics": self.code_metrics(scope, path)}

    def changes(self, since: int) -> DataFrame:
        """Documents added, removed or changed since an older snapshot, in order of path."""
        return rewrite.document_changes(self.store.read(since)["documents"], self._fact("documents")).orderBy("path", "document_id")

    def code_fixes(self, ids: list[str] | None = None, category: str | None = None, scope: str = "solution", path: str | None = None) -> DataFrame:
        """Fixes of the current snapshot's diagnostics in the scope, in order of place."""
        where, found = self._scope(scope, path), self._fact("diagnostics")
        if "path" in where:
            found = found.where(S.same_ignoring_case(F.col("file"), where["path"]))
        elif where:
            found = found.where(F.col("project_id") == where["project_id"])
        return smells.code_fixes(found, self.version, ids, category).orderBy("file", "line", "col", "diagnostic_id")

    def _fix_edits(self, fix_id: str | None) -> DataFrame:
        ident = require(fix_id, "fixId")
        fields = self.spark.range(1).select(codecs.split_id(F.lit(ident)).alias("parts")).select(codecs.parse_fix_id(F.col("parts")).alias("a")).first()["a"]
        if fields is None:
            raise QueryError("fix_not_found", "the id is no fix id", fixId=ident)
        if fields["version"] != self.version:
            raise QueryError("workspace_changed", "the fix is of another snapshot", expected=str(self.version), actual=str(fields["version"]))
        at = self._fact("diagnostics").where((F.col("file") == fields["file"]) & (F.col("span_start") == fields["span_start"]) & (F.upper("code") == fields["diagnostic_id"].upper()))
        if at.isEmpty():
            raise QueryError("fix_not_found", "the diagnostic is gone", fixId=ident)
        edits = cut_lineage(refactoring.unused_local_edits(refactoring.statements_of(self._fact("documents").where(F.col("path") == fields["file"])), at))
        if edits.isEmpty():
            raise QueryError("fix_conflict", "no declaration of one local stands there", fixId=ident)
        return edits

    @staticmethod
    def _preview(edits: DataFrame) -> list[dict]:
        """Files that edits would change, with their number and the edits themselves."""
        each = F.array_sort(F.collect_set(F.struct("line", "col", "length", "new_text"))).alias("edits")
        return [r.asDict(recursive=True) for r in edits.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("edit_count"), each).orderBy("path").collect()]

    def preview_code_fix(self, fix_id: str | None) -> list[dict]:
        """Files that the fix would change, with their edits; nothing is written."""
        return self._preview(self._fix_edits(fix_id))

    def apply_code_fix(self, fix_id: str | None) -> dict:
        changed = self._edit(self._fix_edits(fix_id))
        return {"changed": changed, "version": self.version}

    def refactorings(self, path: str | None, position: int | None = None, line: int | None = None, column: int | None = None, selection_start: int | None = None, selection_length: int | None = None) -> DataFrame:
        """Actions at a place of a document (an offset, or line and column from 1) that meet the selection, in order of place, span and title."""
        path = require(path, "path", "invalid_path")
        if position is None and (line is None or column is None or line < 1 or column < 1):
            raise QueryError("invalid_input", "an offset, or a line and a column from 1, are needed", line=line, column=column)
        if (selection_start or 0) < 0 or (selection_length or 0) < 0:
            raise QueryError("invalid_input", "a selection must not be negative")
        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        before = F.aggregate(F.slice(lines, 1, (line or 1) - 1), F.lit(0), lambda n, row: n + F.length(row) + 1)
        size = self._fact("documents").where(S.same_ignoring_case(F.col("path"), path)).select(F.length("text"), F.length(F.get(lines, F.lit((line or 1) - 1))), before).first()
        if size is None:
            raise QueryError("invalid_path", "the document isn't loaded", path=path)
        if position is None:
            if size[1] is None or column - 1 > size[1]:
                raise QueryError("invalid_input", "the position lies outside the document", line=line, column=column)
            position = size[2] + column - 1
        if not 0 <= position <= (size[0] or 0):
            raise QueryError("invalid_input", "the position lies outside the document", position=str(position))
        selection = None if selection_start is None else (selection_start, selection_length or 0)
        return refactoring.actions_at(self._fact("actions"), path, position, selection, version=self.version).orderBy("span_start", "span_len", "title", "category")

    def carry_action(self, action_id: str | None) -> str:
        """The id on the current snapshot of an action found on an older one.

        Its span is carried over what changed in its document since; there the action is found again
        by key, else by what it is about.  It is an error if its line was edited or nothing is offered there now.
        Without this step, ids of older snapshots are refused.
        """
        ident = require(action_id, "actionId")
        old = refactoring.parsed_id(self.spark, ident)
        if old["version"] == self.version:
            return ident
        place = single_row(self.spark, file=old["file"], line=old["line"], span_start=old["span_start"], span_len=old["span_len"])
        here = lambda facts: facts["documents"].where(F.col("path") == old["file"])
        now = rewrite.carried(place, here(self.store.read(old["version"])), here(self.facts)).first()
        if now is None:
            raise QueryError("workspace_changed", "the line of the action was edited", expected=str(self.version), actual=str(old["version"]))
        return refactoring.found_again(self._fact("actions"), old, now["new_start"], self.version)

    def _action_edits(self, action_id: str | None) -> DataFrame:
        action = cut_lineage(refactoring.require_action(self._fact("actions"), require(action_id, "actionId"), self.version))
        row = action.select("provider_key", "file", "line", "span_start", S.policy(F.col("provider_key"), F.col("origin"), F.col("category"), F.col("diagnostic_id"), None)["decision"].alias("decision")).first()
        if row["decision"] == "block":
            raise QueryError("policy_blocked", "the policy blocks this action", actionId=action_id)
        if row["provider_key"] == S.USE_VAR_KEY:
            return refactoring.use_var_edits(action)
        here = refactoring.statements_of(self._fact("documents").where(F.col("path") == row["file"]))
        at = self._fact("diagnostics").where((F.col("file") == row["file"]) & (F.col("span_start") == row["span_start"]))
        return refactoring.unused_local_edits(here, at)

    def preview_refactoring(self, action_id: str | None) -> list[dict]:
        return self._preview(self._action_edits(action_id))

    def apply_refactoring(self, action_id: str | None) -> dict:
        changed = self._edit(self._action_edits(action_id))
        return {"changed": changed, "version": self.version}


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
