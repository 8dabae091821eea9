"""Tokens and statements of C# texts: one Arrow pass over documents, linear in each text.

A text is cut into words, numbers, strings and punctuation with true offsets; comments and directive
lines are left out, and code in the holes of interpolated strings is cut like any other.  A stack of
brackets deals tokens to statements: a statement begins after the one before it in the same block and ends
with ``;``, with the block it heads, or, in an enumeration, with a comma.  So every token has the first
token of its statement (``head``), and a statement's first token has its header (what stands before its
body or value), its end, and the statements around it (``scopes``): nested intervals.

Each document is one row's work; nothing is kept between documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import spread

_TOKEN = re.compile(
    r"""(?P<word>@?[^\W\d]\w*)
|(?P<skip>\s+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))
|(?P<number>\d(?:[\w]|\.(?=\d))*)
|(?P<raw>\$*(?P<quotes>"{3,})(?s:.*?)(?:(?P=quotes)(?!")|\Z))
|(?P<verbatim>@"(?:[^"]|"")*(?:"|\Z))
|(?P<holed>\$@?"|@\$")
|(?P<string>"(?:[^"\\\n]|\\[^\n]|\\(?=\n|\Z))*(?:"|(?=\n)|\Z))
|(?P<char>'(?:[^'\\\n]|\\[^\n]|\\(?=\n|\Z))*(?:'|(?=\n)|\Z))
|(?P<mark>=>|&&|\|\||\?\?=|\?\?|\?\.|::|==|!=|<=|\+\+|--|->|[-+*/%&|^]=|.)""",
    re.X,
)
#: The text of an interpolated string up to a hole or its end: with escapes, or verbatim.
_PIECE = {False: re.compile(r'(?:[^"\\{\n]|\\[^\n]|\\(?=\n|\Z)|\{\{)*(?:"|\{|(?=\n)|\Z)'), True: re.compile(r'(?:[^"{]|""|\{\{)*(?:"|\{|\Z)')}
#: The same for a text without directives and holes, a match a token: blanks and comments before it belong to the match, and a last match has no token.
_PLAIN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))*+
(?:(@?[^\W\d]\w*)
|([(){}\[\];,.])
|(\d(?:[\w]|\.(?=\d))*)
|((?P<quotes>"{3,})(?s:.*?)(?:(?P=quotes)(?!")|\Z)|@"(?:[^"]|"")*(?:"|\Z)|"(?:[^"\\\n]|\\[^\n]|\\(?=\n|\Z))*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[^\n]|\\(?=\n|\Z))*(?:'|(?=\n)|\Z))
|(=>|&&|\|\||\?\?=|\?\?|\?\.|::|==|!=|<=|\+\+|--|->|[-+*/%&|^]=|.)
|\Z)""",
    re.X,
)
_PLAIN_KIND = {1: "word", 2: "mark", 3: "number", 4: "string", 6: "mark"}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: First words of statements that are expressions up to their semicolon.
_VALUES = frozenset(("return", "throw", "yield", "await"))
STRING = '""'
#: Words of which the header of a type has one.
_TYPE_WORDS = frozenset(("class", "interface", "struct", "enum", "record"))
#: Rows of a batch, about.
ROWS = 20_000

SCHEMA = """document_id string, project_id string, path string, i int, kind string, text string, start int, length int, line int, col int, head int, role string, receiver string, argc int, arity int, made boolean, match int,
owner int, last int, header string, ender string, body_at int, made_type string, value string, scopes array<int>, places array<struct<start: int, line: int, col: int>>, end int, end_line int, end_col int, in_type boolean"""
_PLACE = pa.list_(pa.struct([("start", pa.int32()), ("line", pa.int32()), ("col", pa.int32())]))
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(n, _KINDS.get(k, _PLACE)) for n, k in (f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", SCHEMA))])

#: Columns of tokens and of first tokens of statements that are filled as lists, beside those that follow from places in the text.
_LISTS = ("kind", "text", "head", "role", "receiver", "argc", "arity", "made", "match")
_AT_HEADS = ("owner", "last", "header", "ender", "body_at", "made_type", "value", "scopes", "in_type")

#: A document's own columns, those of tokens, and those of statements: in ``grouped`` a statement is a row, which holds its tokens.
_OWN = ("document_id", "project_id", "path")
_TOKENS = ("i", "kind", "text", "start", "length", "line", "col", "role", "receiver", "argc", "arity", "made", "match")
_HEADS = [f for f in _ARROW if f.name not in ("i", "kind", "text", "length", "receiver", "argc", "arity", "made", "match")]
_TYPES = dict(f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", SCHEMA))
STATEMENTS = ", ".join(f"{f.name} {_TYPES[f.name]}" for f in _HEADS)
GROUPED = f"{STATEMENTS}, tokens array<struct<{', '.join(f'{n}: {_TYPES[n]}' for n in _TOKENS)}>>"


def cut(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each token."""
    if "#" not in text and "$" not in text:  # no directives and no holes: what a token is doesn't depend on those before it
        return [(_PLAIN_KIND[k], *m.span(k)) for m in _PLAIN.finditer(text) if (k := m.lastindex)]
    out, at, depth, holes, fresh, size, match = [], 0, 0, [], True, len(text), _TOKEN.match
    while at < size:
        if holes and holes[-1][1] is None:  # within an interpolated string
            end = _PIECE[holes[-1][0]].match(text, at).end()
            if end > at:
                out.append(("string", at, end))
            if end > at and text[end - 1] == "{" and (len(text[at:end]) - len(text[at:end].rstrip("{"))) % 2:
                holes[-1][1] = depth
            else:
                holes.pop()
            at = end
            continue
        if text[at] == "#" and fresh:
            at = text.find("\n", at)
            at = len(text) if at < 0 else at
            continue
        m = match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "word":
            out.append((kind, at, end))
            fresh, at = False, end
            continue
        if kind == "quotes":
            kind = "raw"
        if kind == "skip":
            if not fresh or text[at] == "/":
                fresh = (fresh or "\n" in m.group()) and not text.startswith("/*", at)  # a directive is the first on its line
        elif kind == "holed":
            holes.append(["@" in m.group(), None])
            out.append(("string", at, end))
        else:
            mark = m.group() if kind == "mark" else ""
            if holes and depth == holes[-1][1] and mark in (":", "}"):  # a format ends with the hole, too
                if mark == ":":
                    end = at + re.compile(r"[^}\n]*").match(text, at).end() - at
                    end += end < len(text) and text[end] == "}"
                holes[-1][1] = None
                out.append(("string", at, end))
            else:
                depth += (mark in _CLOSES and mark != "") - (mark in (")", "]", "}"))
                out.append((kind if kind in ("word", "number", "mark") else "string", at, end))
            fresh = False
        at = end
    return out


class _Block:
    """A bracket on the stack; in a block of statements, ``head`` is the first token of the current one."""

    __slots__ = ("mark", "at", "statements", "ends", "head", "owner", "scopes", "asked", "commas", "body", "stop", "enum", "arms", "home", "in_type")

    def __init__(self, mark: str, at: int, statements: bool, ends: bool = False, owner: int = -1, scopes: tuple = (), home: _Block | None = None):
        self.mark, self.at, self.statements, self.ends, self.owner, self.scopes = mark, at, statements, ends, owner, scopes
        self.head, self.asked, self.commas, self.body, self.stop, self.enum, self.arms, self.in_type = None, [], 0, None, None, False, False, False
        self.home = self if statements else home


def _type_arguments(texts: list[str], kinds: list[str], at: int) -> tuple[int, int]:
    """(number of type arguments, token after them) if ``<`` at ``at`` opens some, else (0, at)."""
    depth, n, j = 0, 1, at
    while j < len(texts):
        t = texts[j]
        if t == "<":
            depth += 1
        elif t == ">":
            depth -= 1
            if not depth:
                return (n, j + 1)
        elif t == ",":
            n += depth == 1
        elif kinds[j] != "word" and t not in (".", "::", "[", "]", "?"):
            break
        j += 1
    return (0, at)


def _columns(text: str, whole: bool = True) -> tuple[list[int], list[int], tuple[list, ...], list[tuple]]:
    """Without ``whole`` what only tokens have is left out.

    Starts and ends of a text's tokens, a list for each of ``_LISTS``, and by statement its first token, the token behind its header and a value for each of ``_AT_HEADS``."""
    found = cut(text)
    n = len(found)
    kinds, starts, ends = ([f[k] for f in found] for k in range(3))
    texts = [STRING if k == "string" else text[a:b] for k, a, b in found]
    heads, roles, receivers, argcs, arities, made, matches = [0] * n, [None] * n, [None] * n, [None] * n, [None] * n, [False] * n, [None] * n
    done: list[tuple] = []
    frames = [_Block("", -1, True)]
    after_do, angle_until, ended_do = False, 0, False

    def finish(block: _Block, last: int) -> None:
        nonlocal ended_do
        head = block.head
        if head is None:
            return
        stop = min(block.stop if block.stop is not None else last + 1, last + 1)
        if texts[last] in (";", ",", ":") and stop == last + 1 and last >= head:
            stop = last
        value = made_type = None
        if stop < last <= stop + 3 and texts[stop] == "=":
            value = " ".join(texts[stop + 1 : last])
        if stop + 2 <= last and texts[stop] == "=" and texts[stop + 1] == "new" and kinds[stop + 2] == "word":
            j = stop + 3
            while j + 1 <= last and texts[j] == "." and kinds[j + 1] == "word":
                j += 2
            _, after = _type_arguments(texts, kinds, j) if j <= last and texts[j] == "<" else (0, j)
            made_type = " ".join(texts[stop + 2 : after])
        done.append((head, stop, block.owner, last, " ".join(texts[head:stop]), texts[stop] if stop <= last else "", block.body, made_type, value, block.scopes, block.in_type))
        ended_do = texts[head] == "do"
        block.head = block.body = block.stop = None
        block.asked.clear()

    for i, t in enumerate(texts):
        top = frames[-1]
        home = top.home
        if top.statements and top.head is None and t not in ("}", ";"):
            top.head = i
            if t == "while" and ended_do:
                roles[i] = "tail"
        if top.statements and t != "}":
            ended_do = False
        heads[i] = home.head if home.head is not None else i
        previous = texts[i - 1] if i else ""
        if kinds[i] == "word" and not whole:
            if t == "case" and previous != "goto" or t == "default" and i + 1 < n and texts[i + 1] == ":" and not top.asked:
                roles[i] = "label"
        elif kinds[i] == "word":
            after = i + 1
            if i + 1 < len(texts) and texts[i + 1] == "<":
                n_types, after = _type_arguments(texts, kinds, i + 1)
                if n_types and (after >= len(texts) or texts[after] in ("(", ")", "]", "{", "}", ":", ";", ",", ".", "?", "==", "!=", "[", ">", "=", "=>") or kinds[after] == "word"):
                    arities[i], angle_until = n_types, max(angle_until, after)
                else:
                    after = i + 1
            argcs[i] = -1
            if after < len(texts) and texts[after] == "(":
                argcs[i] = after  # the bracket, until its arguments are counted
            if previous in (".", "?.") or (previous == "::" and i > 1):
                simple = i > 1 and kinds[i - 2] == "word" and (i < 3 or texts[i - 3] not in (".", "?.", "::"))
                receivers[i] = texts[i - 2] if simple else ""
            made[i] = previous == "new"
            if t == "case" and previous != "goto" or t == "default" and i + 1 < len(texts) and texts[i + 1] == ":" and not top.asked:
                roles[i] = "label"
        elif t == "?":
            top.asked.append(i)
        elif t == ":":
            if top.asked:
                roles[top.asked.pop()] = "conditional"
            elif top.statements and top.head is not None and texts[top.head] in ("case", "default"):
                finish(top, i)
        elif t in ("=", "=>") and top.statements and top.stop is None and top.head != i:
            top.stop = i
            top.body = i if t == "=>" else None
        if t == "=>" and top.arms:
            roles[i] = "arm"
        if t == ",":
            top.commas += i >= angle_until
            top.asked.clear()
            if top.enum:
                finish(top, i)
        elif t == ";":
            top.asked.clear()
            if top.statements:
                finish(top, i)
        elif t in ("(", "["):
            frames.append(_Block(t, i, False, home=home))
        elif t == "{":
            scopes = (*home.scopes, home.head) if home.head is not None else home.scopes
            owner = home.head if home.head is not None else home.owner
            if previous == "=>":
                frames.append(_Block(t, i, True, False, owner, scopes))
            elif not top.statements or top.stop is not None or previous == "switch" or texts[top.head] in _VALUES:
                frames.append(_Block(t, i, False, home=home))
                frames[-1].arms = previous == "switch"
            else:
                top.stop = top.body = i
                frames.append(_Block(t, i, True, True, owner, scopes))
                frames[-1].enum = "enum" in texts[top.head : i]
            if frames[-1].statements and home.head is not None:
                frames[-1].in_type = not _TYPE_WORDS.isdisjoint(texts[home.head : i])
        elif t in (")", "]", "}"):
            if len(frames) > 1 and any(_CLOSES[f.mark] == t for f in frames[1:]):
                while True:  # brackets that were never closed end here, too
                    block = frames.pop()
                    if block.statements:
                        finish(block, i - 1)
                    if _CLOSES[block.mark] == t:
                        break
                matches[block.at] = i
                argcs[block.at] = 0 if i == block.at + 1 else block.commas + 1
                below = frames[-1]
                if block.ends:
                    heads[i] = below.head if below.head is not None else i
                    finish(below, i)
                elif t == "]" and below.statements and below.head == block.at:
                    roles[block.at : i + 1] = ["attribute"] * (i + 1 - block.at)  # attributes stand before a statement
                    below.head = None
    while frames:
        block = frames.pop()
        if block.statements and texts:
            finish(block, len(texts) - 1)
    # a word has the number of arguments of the bracket behind it, which comes later
    for i, kind in enumerate(kinds if whole else ()):
        if kind != "word":
            argcs[i] = None
        elif argcs[i] >= 0:
            argcs[i] = argcs[argcs[i]] or 0
    done.sort()
    return starts, ends, (kinds, texts, heads, roles, receivers, argcs, arities, made, matches), done


def statements(text: str) -> list[dict]:
    """Rows of ``SCHEMA``, one per token, without values for the document's own columns."""
    return _record([((None, None, None), text, _columns(text))]).to_pylist()


def grouped(docs: DataFrame, whole: bool = True) -> DataFrame:
    """One row per statement of documents (document_id, project_id, path, text), see ``GROUPED``; a null text has none.

    A statement's row holds its tokens; brackets that end no statement have rows without a header.  Without ``whole`` there
    are only statements, and no tokens.  Documents are dealt to tasks by their id first, as texts that fill one small
    file would all be cut by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            for *own, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((own, text or "", _columns(text or "", whole)))
                n += len(held[-1][2][0])
                if n >= ROWS:
                    yield from _parts(held, whole)
                    held, n = [], 0
        if n:
            yield from _parts(held, whole)

    return spread(docs.select("document_id", "project_id", "path", "text"), "document_id", "text").mapInArrow(run, GROUPED if whole else STATEMENTS)


def flat(rows: DataFrame) -> DataFrame:
    """Tokens of ``grouped`` rows, see ``SCHEMA``: what only first tokens of statements have is null at others."""
    each = rows.withColumn("t", F.explode("tokens"))
    first = F.col("t.i") == F.col("head")
    of = lambda n: F.col(n) if n in _OWN or n == "head" else F.col(f"t.{n}") if n in _TOKENS else F.when(first, F.col(n))
    return each.select(*[of(n).alias(n) for n in _ARROW.names])


def tokens(docs: DataFrame) -> DataFrame:
    """Tokens of documents (document_id, project_id, path, text), see ``SCHEMA``; a null text has none."""
    return flat(grouped(docs))


def _parts(held: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
    """Statements of several documents in batches of about ``ROWS``."""
    record = _groups(held, whole)
    for a in range(0, record.num_rows, ROWS):
        yield record.slice(a, ROWS)


def _groups(held: list[tuple], whole: bool) -> pa.RecordBatch:
    """The statements of several documents with their tokens; what ``_record`` takes."""
    columns, values, at, nth = _tables(held, whole)
    home = np.array(columns["head"], np.int64) + np.searchsorted(nth, nth)
    if whole:
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1])) if len(order) else order
        rows = home[order][first]
        inner = pa.StructArray.from_arrays([_as_array(columns[n], _ARROW.field(n)).take(pa.array(order)) for n in _TOKENS], fields=[_ARROW.field(n) for n in _TOKENS])
        last = {"tokens": pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), inner)}
    else:
        rows, last = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)), {}
    own, rows = pa.array(nth[rows]), pa.array(rows)
    done = at.take(rows)
    arrays = {f.name: _as_array(values[f.name], f).take(done) if f.name in values else columns[f.name].take(own) if f.name in _OWN else _as_array(columns[f.name], f).take(rows) for f in _HEADS} | last
    return pa.RecordBatch.from_arrays(list(arrays.values()), schema=pa.schema([*_HEADS, *([pa.field("tokens", last["tokens"].type)] if whole else [])]))


def _as_array(x, field: pa.Field) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x, field.type)


def _record(held: list[tuple]) -> pa.RecordBatch:
    """The tokens of several documents: (document_id, project_id, path), text and ``_columns`` of each."""
    columns, values, at, nth = _tables(held)
    of = lambda f: _as_array(values[f.name], f).take(at) if f.name in values else columns[f.name].take(pa.array(nth)) if f.name in _OWN else _as_array(columns[f.name], f)
    return pa.RecordBatch.from_arrays([of(f) for f in _ARROW], schema=_ARROW)


def _tables(held: list[tuple], whole: bool = True) -> tuple[dict, dict, pa.Array, np.ndarray]:
    """Columns of tokens (their documents' own by document), columns of statements, the statement that each token begins, and each token's document.

    Lines and columns follow from the places of line ends, for all documents at once.
    """
    counts = np.array([len(c[0]) for _, _, c in held])
    nth, begun = np.repeat(np.arange(len(held)), counts), np.cumsum(counts) - counts
    sizes = np.array([len(t) for _, t, _ in held])
    base = np.cumsum(sizes) - sizes
    breaks = np.flatnonzero(np.frombuffer("".join(t for _, t, _ in held).encode("utf-32-le", "surrogatepass"), "<u4") == ord("\n"))

    def place(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line and column of places in documents."""
        at, above = at + base[doc], np.searchsorted(breaks, base)[doc]
        k = np.searchsorted(breaks, at)
        before = base[doc] - 1
        inner = k > above
        before[inner] = breaks[k[inner] - 1]
        return k - above + 1, at - before

    joined = lambda lists: [x for part in lists for x in part]
    start, end = (np.array(joined(c[k] for _, _, c in held), np.int64) for k in (0, 1))
    line, col = place(start, nth)
    columns = {n: pa.array([own[k] for own, _, _ in held], pa.string()) for k, n in enumerate(_OWN)}
    columns |= {"i": np.arange(len(nth)) - begun[nth], "start": start, "length": end - start, "line": line, "col": col}
    columns |= {n: joined(c[2][k] for _, _, c in held) for k, n in enumerate(_LISTS) if whole or n in ("head", "role")}
    # what only the first tokens of statements have is put into place by number
    done = joined(c[3] for _, _, c in held)
    doc = np.repeat(np.arange(len(held)), [len(c[3]) for _, _, c in held])
    head, stop, last = (np.array([d[k] for d in done], np.int64) + begun[doc] for k in (0, 1, 3))
    at = np.full(len(nth), -1, np.int64)
    at[head] = np.arange(len(done))
    at = pa.array(at, mask=at < 0)
    values = {n: pa.array([d[k] for d in done], _ARROW.field(n).type) for k, n in enumerate(_AT_HEADS, 2)}
    values["end"] = end[last]
    values["end_line"], values["end_col"] = place(end[last], doc)
    # the tokens of all headers, one after the other
    until = np.cumsum(stop - head)
    inside = np.arange(until[-1] if len(until) else 0) + np.repeat(head - until + stop - head, stop - head)
    parts = pa.StructArray.from_arrays([pa.array(x[inside], pa.int32()) for x in (start, line, col)], fields=list(_PLACE.value_type))
    values["places"] = pa.ListArray.from_arrays(pa.array(np.append(0, until), pa.int32()), parts)
    return columns, values, at, nth
