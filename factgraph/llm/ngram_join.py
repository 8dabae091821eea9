"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles, exactly.

A document's set holds the 64-bit hashes of its distinct shingles of ``WIDTH`` words (a shorter
text is one shingle).  Two documents link at a similarity of ``PERCENT`` or more.

1. Equal sets are one class, found by a fingerprint; the least doc_id stands for it.
2. Three global token orders: by frequency in the whole corpus, rare first, and by two independent
   hashes.  Frequencies are counted over all documents into ``COUNT_SLOTS`` slots; as any order is
   exact, tokens that share a slot only share a frequency.
3. A linked pair shares a token of both prefixes under the first order.  Prefix tokens meet by
   token and their lists are cut by the length bound; lists of one class go no further, and those
   that several tokens have in common are one list.  Only then its classes get their prefixes under
   the other two orders.
4. In a list the filters are intersected, before any text moves: the length bound, and enough
   shared tokens in the prefixes under the second and the third order.  Pairs that pass tie their
   classes into candidate groups; a list gives a spanning star for each, never its pairs.
   A list of more than ``HOT_LIST`` classes is dealt again by list and second token together, and
   one that is still above ``MOST_LIST`` is one candidate group as it is.
5. Texts of candidate groups come together and their sets are compared: a search from document to
   linked document asks only about those that no link has reached.
6. Links of all groups give components by repeated minimum labels over written tables.

Defined results: a null or empty text, or one without a word, has an empty set and links with
nothing; rows that repeat a doc_id count as one document (its component holds what any of them
links with); a null doc_id links with nothing and has a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, FOLDED_TABLES, SPACE_WORDS, input_bytes, materialize, mix, partitions_for, segments, shingle_hashes, utf8, word_hashes, word_spans, working_on

WIDTH, PERCENT = 3, 90
#: Slots of the table of token frequencies (a byte each when it goes to the tasks), and of a slice of it.
COUNT_SLOTS, SLICE_SLOTS = 1 << 21, 1 << 12
#: Tokens that prefixes under the second and third order must share: a share of the set, and at most so many.
SHARED_PART, SHARED_MOST = 0.3, 24
#: Classes of a list that is searched as it is, and of one that is searched at all.
HOT_LIST, MOST_LIST = 4000, 200_000
#: Pairs of small lists that are looked at together, and classes of a small list.
PAIRS, SMALL_LIST = 1 << 20, 48
#: Shingles of a group that is searched in one task; a larger one is searched in pairs of blocks of half that.
GROUP_SHINGLES = 2_000_000
#: Text of small groups that is searched together.
BATCH_BYTES = 1 << 21
#: Fingerprints of sets that a task remembers.
SEEN_SETS = 1 << 20
ORDERS = 3


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after the other, and their n + 1 offsets."""
    starts, ends, at = word_spans(raw, offsets, SPACE_WORDS)
    words = word_hashes(raw, starts, ends, FOLDED_TABLES[0], BASES[0])
    sizes = np.diff(at)
    h = shingle_hashes(words, width)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.flatnonzero(np.arange(len(h)) + width <= at[1:][doc[: len(h)]]) if len(h) else np.zeros(0, np.int64)
    docs, values = [doc[place]], [h[place]]
    for d in np.flatnonzero((sizes > 0) & (sizes < width)):
        short = np.array([sizes[d]], np.uint64)
        for w in words[at[d] : at[d + 1]]:
            short = short * BASES[1] + w
        docs.append(np.array([d]))
        values.append(mix(short))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(sizes) < 1 << 16 else np.int64), kind="stable")]
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(doc[fresh], np.arange(len(sizes) + 1))


def fingerprints(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, with independent hashes of its members."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(values * BASES[1] + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
    return one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def prefix_sizes(sizes: np.ndarray, percent: int, shared: np.ndarray | int = 1) -> np.ndarray:
    """Tokens in the prefix of each set, of which a linked pair has ``shared`` in common.

    Sets of a linked pair have at least ceil(percent * size / 100) tokens in common, for either size.
    """
    return np.minimum(sizes - -(-percent * sizes // 100) + shared, sizes)


def must_share(sizes: np.ndarray) -> np.ndarray:
    """Tokens that the longer prefixes of a set have in common with those of any linked set."""
    return np.clip((SHARED_PART * sizes).astype(np.int64), 1, SHARED_MOST)


def signatures(values: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the second and the third order: 16-bit marks of each set's prefix tokens, in order, and their offsets."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    wanted = prefix_sizes(sizes, percent, must_share(sizes))
    out = []
    for base in BASES:
        key = mix(values * base + np.uint64(77))
        # only keys that may be in a prefix are sorted: the least ones, by a bound with room to spare
        bound = np.where(wanted + 8 * np.sqrt(wanted) + 30 >= sizes, 1.0, (wanted + 8 * np.sqrt(wanted) + 30) / np.maximum(sizes, 1))
        some = np.flatnonzero((key >> np.uint64(11)).astype(np.float64) * 2.0**-53 <= bound[doc])
        count = np.bincount(doc[some], minlength=len(sizes))
        if (count < wanted).any():  # out of all reason for hashes, but then sort them all
            some, count = np.arange(len(doc)), sizes
        by = some[np.lexsort((key[some], doc[some]))]
        keep = np.arange(len(by)) - _starts(count)[doc[by]] < wanted[doc[by]]
        out.append(((key[by[keep]] & np.uint64(0xFFFF)).astype(np.uint16), _starts(wanted)))
    return out


_SETS = "doc_id long, n long, f1 long, f2 long, second binary, third binary, slice int, counts binary"


def set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, size, fingerprint and signatures of each row's set, and rows with slices of token counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("second", pa.binary()), ("third", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("ngram_join")
        counts = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in segments(offsets):
                values, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                slots, n = np.unique(_slot(values), return_counts=True)
                counts[slots] += n
                one, two = fingerprints(values, at)
                marks = signatures(values, at, percent)
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[packed(*m) for m in marks], pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        slices = counts.reshape(-1, min(SLICE_SLOTS, COUNT_SLOTS))
        some = np.flatnonzero(slices.any(1))
        for a in range(0, len(some), 64):
            part = some[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), f.type) for f in list(schema)[:6]] + [pa.array(part, pa.int32()), pa.array([np.minimum(slices[i], 2**32 - 1).astype(np.uint32).tobytes() for i in part], pa.binary())], schema=schema)

    return docs.mapInArrow(run, _SETS)


def _slot(values: np.ndarray) -> np.ndarray:
    """The slot of the frequency table that each token is counted in."""
    return (mix(values * BASES[1]) >> np.uint64(65 - COUNT_SLOTS.bit_length())).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """For each slot how often its tokens occur, in steps of a quarter power of two: a table of fixed size."""
    width = min(SLICE_SLOTS, COUNT_SLOTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        steps = [np.minimum(np.log2(np.maximum(v, 1)) * 4, 255).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(steps, pa.binary())], ["slice", "counts"])

    out = np.zeros((COUNT_SLOTS // width, width), np.uint8)
    counted = sets.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary")
    for r in counted.collect():  # at most a byte a slot
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out.ravel()


_TOKENS, _LISTS = "token long, n long, f1 long, f2 long", "list long, f1 long, f2 long"


def runs_of_lists(batches: Iterator[pa.RecordBatch], percent: int, most: int = HOT_LIST) -> Iterator[pa.RecordBatch]:
    """Runs (list, f1, f2) of several classes, of ``batches`` (token, n, f1, f2) in that order.

    The list of a token is cut where one size and the next don't fit the length bound, as then no
    pair across the cut does.  A run is named by its members, so that tokens with the same run name
    one list.  A run of more than ``most`` classes goes out as it comes, under a name of its own.
    """

    def named(names: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(rows[2]), pa.array(rows[3])], ["list", "f1", "f2"])

    held, long = np.zeros((4, 0), np.int64), None  # the last run so far; the name of a long one, of which the last row is held
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(4)])], 1)
        if not rows.shape[1]:
            continue
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        rows = rows[:, fresh]  # a class of several tasks counts once
        cut = (rows[0, 1:] != rows[0, :-1]) | (100 * rows[1, :-1] < percent * rows[1, 1:])
        first = np.flatnonzero(np.concatenate([[True], cut]))
        if long is not None:
            own = rows[:, 1 : first[1] if len(first) > 1 else None]
            yield named(np.full(own.shape[1], long), own)
            if len(first) == 1:
                held = rows[:, -1:]
                continue
            rows, first, long = rows[:, first[1] :], first[1:] - first[1], None
        held = rows[:, first[-1] :]
        yield named(*_run_names(rows[:, : first[-1]], first[:-1]))
        if held.shape[1] > most:
            long = mix(mix(held[0, :1].view(np.uint64)) ^ held[1, :1].view(np.uint64))[0]
            yield named(np.full(held.shape[1], long), held)
            held = held[:, -1:]
    if long is None:
        yield named(*_run_names(held, np.zeros(min(held.shape[1], 1), np.int64)))


def _run_names(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each row of the runs that begin at ``first`` and hold several rows, and those rows."""
    if not len(first):
        return np.zeros(0, np.uint64), rows
    size = np.diff(np.append(first, rows.shape[1]))
    members = mix(mix(rows[2].view(np.uint64)) + rows[3].view(np.uint64))
    keep = np.repeat(size > 1, size)
    return np.repeat(mix(np.add.reduceat(members, first)), size)[keep], rows[:, keep]


def prefix_lists(docs: DataFrame, width: int, percent: int, steps: np.ndarray, n: int) -> DataFrame:
    """Lists (list, f1, f2) of classes that share a prefix token under the first order and are near in size."""
    names = ["token", "n", "f1", "f2"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        working_on("ngram_join")
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for x, y in segments(offsets):
                values, at = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], width)
                prints = fingerprints(values, at)
                new = np.ones(y - x, bool)
                for d, print_ in enumerate(zip(*(f.tolist() for f in prints))):
                    if print_ in seen:  # an equal set of the task
                        new[d] = False
                    seen.add(print_)
                if len(seen) > SEEN_SETS:
                    seen.clear()
                sizes = np.diff(at)
                doc = np.repeat(np.arange(y - x), sizes)
                use = new[doc]
                token, doc = values[use], doc[use]
                by = np.lexsort((mix(token.copy()), steps[_slot(token)], doc))
                token, doc = token[by], doc[by]
                keep = np.arange(len(doc)) - _starts(np.where(new, sizes, 0))[doc] < prefix_sizes(sizes, percent)[doc]
                token, doc = token[keep], doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(sizes[doc].astype(np.int64)), *[pa.array(f[doc].view(np.int64)) for f in prints]], names)

    rows = docs.mapInArrow(scan, _TOKENS).repartition(n, "token").sortWithinPartitions(*names)
    return rows.mapInArrow(lambda batches: runs_of_lists(batches, percent), _LISTS).distinct()


# --- candidates within the list of a token -------------------------------------------------------


def _gather(at: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenated slices values[at[k]:at[k + 1]] for all keys."""
    sizes = at[keys + 1] - at[keys]
    total = int(sizes.sum())
    if not total:
        return values[:0]
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[keys], sizes)
    return values[place]


class OpenIndex:
    """Rows by token, of rows that no search has reached; built again whenever half of them are closed."""

    def __init__(self, tokens: np.ndarray, at: np.ndarray, n_tokens: int):
        self.tokens, self.at, self.n_tokens = tokens, at, n_tokens
        self.open = np.diff(at) > 0
        self._build()

    def _build(self) -> None:
        rows = np.flatnonzero(self.open)
        self.left = self.built = len(rows)
        tokens = _gather(self.at, rows, self.tokens)
        order = np.argsort(tokens, kind="stable")
        self.rows = np.repeat(rows, self.at[rows + 1] - self.at[rows])[order]
        self.by_token = _starts(np.bincount(tokens, minlength=self.n_tokens))

    def close(self, rows: np.ndarray) -> None:
        self.open[rows] = False
        self.left -= len(rows)
        if 2 * self.left < self.built:
            self._build()

    def near(self, row: int) -> np.ndarray:
        """Open rows that share a token with ``row``, once for each."""
        rows = _gather(self.by_token, self.tokens[self.at[row] : self.at[row + 1]].astype(np.int64), self.rows)
        return rows[self.open[rows]]


def spread(index: OpenIndex, ask) -> np.ndarray:
    """For each row the first row from which ``ask(row, near rows)`` leads to it, step by step."""
    root = np.arange(len(index.at) - 1)
    for start in range(len(root)):
        if not index.left:
            break
        if not index.open[start]:
            continue
        index.close(np.array([start]))
        queue = [start]
        while queue and index.left:
            x = queue.pop()
            found = ask(x, index.near(x))
            index.close(found)
            root[found] = start
            queue += found.tolist()
    return root


def _fits(a: np.ndarray | int, b: np.ndarray, percent: int) -> np.ndarray:
    """The length bound."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def long_list(sizes: np.ndarray, second: tuple, third: tuple, percent: int) -> np.ndarray:
    """Roots of the candidate groups of one list."""
    need = must_share(sizes)
    known = np.zeros(1 << 16, bool)

    def ask(x: int, near: np.ndarray) -> np.ndarray:
        near, shared = np.unique(near, return_counts=True)
        near = near[_fits(sizes[x], sizes[near], percent) & (shared >= np.minimum(need[x], need[near]))]
        if not len(near):
            return near
        values, at = third
        mine = values[at[x] : at[x + 1]]
        known[mine] = True
        counts = at[near + 1] - at[near]
        shared = np.add.reduceat(known[_gather(at, near, values)].astype(np.int64), np.cumsum(counts) - counts)
        known[mine] = False
        return near[shared >= np.minimum(need[x], need[near])]

    return spread(OpenIndex(*second, 1 << 16), ask)


def short_lists(first: np.ndarray, count: np.ndarray, sizes: np.ndarray, marks: list[tuple], percent: int) -> np.ndarray:
    """Roots of the candidate groups of many lists of rows [first, first + count)."""
    need = must_share(sizes)
    tables = [np.sort(np.repeat(np.arange(len(sizes)), np.diff(at)) << 16 | values) for values, at in marks]
    ties = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in np.unique(count):
        one, two = np.triu_indices(int(k), 1)
        lists = first[count == k]
        step = max(1, PAIRS // len(one))
        for z in range(0, len(lists), step):
            block = lists[z : z + step, None]
            a, b = (block + one).ravel(), (block + two).ravel()
            ok = _fits(sizes[a], sizes[b], percent)
            a, b = a[ok], b[ok]
            for (values, at), table in zip(marks, tables):
                if not len(a):
                    break
                counts = at[a + 1] - at[a]
                sought = np.repeat(b, counts) << 16 | _gather(at, a, values)
                hit = table[np.minimum(np.searchsorted(table, sought), len(table) - 1)] == sought
                ok = np.add.reduceat(hit.astype(np.int64), np.cumsum(counts) - counts) >= np.minimum(need[a], need[b])
                a, b = a[ok], b[ok]
            ties.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*ties))
    root = np.arange(len(sizes))
    while True:  # least row of each group
        after = root.copy()
        np.minimum.at(after, a, root[b])
        np.minimum.at(after, b, root[a])
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _marks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit marks of a binary column and their offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(np.uint16).astype(np.int64), (offsets - offsets[0]) // 2


_EDGES = "a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidate_edges(lists: DataFrame, percent: int, most: int) -> DataFrame:
    """Star edges of the candidate groups of ``lists`` (list, head, n, second, third), sorted by list and head in partitions."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        key, head, sizes = (rows.column(i).to_numpy() for i in range(3))
        marks = [_marks_of(rows.column(i).chunk(0)) for i in (3, 4)]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        small = (count > 1) & (count <= SMALL_LIST)
        root = short_lists(first[small], count[small], sizes, marks, percent)
        for a, k in zip(first[count > SMALL_LIST].tolist(), count[count > SMALL_LIST].tolist()):
            own = [(values[at[a] : at[a + k]], at[a : a + k + 1] - at[a]) for values, at in marks]
            root[a : a + k] = a + long_list(sizes[a : a + k], *own, percent)
        far = root != np.arange(len(root))
        return _edges(head[root[far]], head[far])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, whole = 0, None  # whole: the list that is taken as one group, and its first class
        for batch in batches:
            if whole is not None:
                more = int(np.searchsorted(batch.column(0).to_numpy(), whole[0], "right"))
                head = batch.column(1).slice(0, more).to_numpy()
                yield _edges(np.full(more, whole[1]), head)
                batch = batch.slice(more)
            if not batch.num_rows:
                continue
            whole = None
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut == 0 and n and held[-1].column(0)[-1].as_py() != key[0]:
                yield solve(pa.Table.from_batches(held))
                held, n = [], 0
            if cut:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, n = [], 0
            held.append(batch.slice(cut))
            n += batch.num_rows - cut
            if n > most:
                head = np.concatenate([h.column(1).to_numpy() for h in held])
                yield _edges(np.full(len(head) - 1, head[0]), head[1:])
                whole, held, n = (int(key[-1]), int(head[0])), [], 0
        if held:
            yield solve(pa.Table.from_batches(held))

    return lists.mapInArrow(run, _EDGES)


def token_lists(shared: DataFrame, classes: DataFrame, percent: int, hot: int, n: int) -> DataFrame:
    """Classes of each list (list, head, n, second, third): those of ``shared``, or of a hot list and a second token."""
    often = materialize(shared.groupBy("list").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > hot).select("list", F.lit(True).alias("often")), "often")
    rows = shared.join(classes, ["f1", "f2"]).join(often, "list", "left")
    size = F.col("n")
    prefix = F.least(size - F.ceil(F.lit(percent) * size / 100) + 1, size).cast("int")
    both = F.transform(F.sequence(F.lit(1), prefix), lambda i: F.xxhash64("list", F.substring("second", i * 2 - 1, F.lit(2))))
    rows = rows.select(F.explode(F.when(F.col("often"), F.array_distinct(both)).otherwise(F.array("list"))).alias("list"), "head", "n", "second", "third")
    return rows.repartition(n, "list").sortWithinPartitions("list", "head")


# --- components ----------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Least reachable document of each document that has an edge: id, component.

    Each round gives every document the least label around it and then its label's label.  A star
    takes two rounds, a chain of n about log n.  Both joins of a round read written tables on both
    sides, so that Spark can split the partition of a hot centre or label.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = materialize(edges.where("a <> b").select(ways.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        around = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(around, F.col("id") == F.col("a")).select("id", F.col("component").alias("before"), F.least("component", "near").alias("near"))
        # hook: the old label learns of the nearer one as well
        hooks = nearer.where("near < before").select(F.col("before").alias("id"), F.lit(None).cast("long").alias("before"), "near")
        hooked = materialize(nearer.unionByName(hooks).groupBy("id").agg(F.max("before").alias("before"), F.min("near").alias("near")), "hooked")
        jump = hooked.select(F.col("id").alias("at"), F.col("near").alias("further"))
        after = materialize(hooked.join(jump, F.col("near") == F.col("at"), "left").select("id", "before", F.least("near", F.coalesce("further", "near")).alias("component")), "labels")
        labels = after.select("id", "component")
        if after.where("component <> before").isEmpty():
            return labels
    raise RuntimeError("components didn't settle")


# --- search within a group -----------------------------------------------------------------------


def _prefixes(values: np.ndarray, at: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of each document under a token order, one after the other, and their offsets."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((rank[values], doc))
    length = prefix_sizes(sizes, percent)
    keep = np.arange(len(values)) - at[doc] < length[doc]
    return values[by][keep], _starts(length)


def linked(values: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the least place of a set that links lead to."""
    if len(at) < 3:
        return np.arange(len(at) - 1)
    tokens, coded = np.unique(values, return_inverse=True)
    ties = mix(tokens.copy())
    orders = [np.lexsort((ties, np.bincount(coded)))] + [np.argsort(mix(tokens * b), kind="stable") for b in BASES][: ORDERS - 1]
    prefixes = []
    for by in orders:
        rank = np.empty(len(tokens), np.int64)
        rank[by] = np.arange(len(tokens))
        prefixes.append(_prefixes(coded, at, rank, percent))
    sizes = np.diff(at)
    mark = np.zeros(len(tokens), bool)

    def shared_with(mine: np.ndarray, of: np.ndarray, of_at: np.ndarray, near: np.ndarray) -> np.ndarray:
        mark[mine] = True
        counts = of_at[near + 1] - of_at[near]
        out = np.add.reduceat(mark[_gather(of_at, near, of)].astype(np.int64), np.cumsum(counts) - counts)
        mark[mine] = False
        return out

    def ask(x: int, near: np.ndarray) -> np.ndarray:
        near = np.unique(near)
        near = near[_fits(sizes[x], sizes[near], percent)]
        for own, own_at in prefixes[1:]:  # the filters of the other orders
            if len(near):
                near = near[shared_with(own[own_at[x] : own_at[x + 1]], own, own_at, near) > 0]
        if not len(near):
            return near
        same = shared_with(coded[at[x] : at[x + 1]], coded, at, near)
        return near[100 * same >= percent * (sizes[x] + sizes[near] - same)]

    return spread(OpenIndex(*prefixes[0], len(tokens)), ask)


def group_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Star edges of linked documents; ``members`` (cell, doc_id, text) sorted by cell in partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def solve():
            raw, offsets = utf8(pa.array([r[2] for r in held], pa.large_string()))
            values, at = shingle_sets(raw, offsets, width)
            ids = np.array([r[1] for r in held], np.int64)
            root = linked(values, at, percent)
            far = root != np.arange(len(root))
            return _edges(ids[root[far]], ids[far])

        previous, size = None, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if row[0] != previous and size >= BATCH_BYTES:
                    yield solve()
                    held, size = [], 0
                previous = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield solve()

    return members.mapInArrow(run, _EDGES)


def _cells(groups: DataFrame, most: int) -> DataFrame:
    """id and cell of ``groups`` (id, component, n): the group, or all pairs of its blocks that hold the document."""
    sized = groups.join(groups.groupBy("component").agg(F.sum("n").alias("total")), "component")
    blocks = F.ceil(F.col("total") * 2 / most).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("component", F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    cells = F.when(F.col("total") <= most, F.array(F.xxhash64("component"))).otherwise(pairs)
    return sized.withColumn("blocks", blocks).withColumn("own", own).select("id", F.explode(cells).alias("cell"))


def repeated_ids(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Star edges between the heads of all classes that rows of one doc_id are in."""
    key = F.struct("f1", "f2")
    several = real.groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("greatest")).where("least <> greatest").select("doc_id")
    heads = materialize(real.join(several, "doc_id").select("doc_id", "f1", "f2").distinct().join(classes, ["f1", "f2"]).select("doc_id", "head").distinct(), "repeated")
    least = heads.groupBy("doc_id").agg(F.min("head").alias("a"))
    return heads.join(least, "doc_id").where("a <> head").select("a", F.col("head").alias("b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES, hot_list: int = HOT_LIST, most_list: int = MOST_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(spark, input_bytes(docs))
    table = materialize(set_table(docs, width, percent), "sets")
    steps = frequencies(table)
    table = table.where("slice is null")
    sets = table.select("doc_id", "n", "f1", "f2")
    named = docs.where(F.col("doc_id").isNotNull())
    real = sets.where("n > 0 and doc_id is not null")
    key = ["f1", "f2"]
    classes = materialize(real.groupBy(*key).agg(F.min("doc_id").alias("head"), F.min("n").alias("n")), "classes")
    # candidate groups of class heads
    shared = materialize(prefix_lists(named, width, percent, steps, n), "tokens")
    marked = table.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").alias("head"), "n", "second", "third")).alias("c")).select(*key, "c.*")
    candidates = candidate_edges(token_lists(shared, marked, percent, hot_list, n), percent, most_list)
    groups = components(candidates)
    # ids of groups are class heads; an id that several sets repeat counts with all of them
    weight = classes.groupBy("head").agg(F.sum("n").alias("n"))
    cells = _cells(groups.join(weight, F.col("id") == F.col("head")).select("id", "component", "n"), group_shingles)
    # never a broadcast of the cells: they grow with the documents
    members = named.join(cells.hint("merge"), F.col("doc_id") == F.col("id")).select("cell", "doc_id", "text").repartition(n, "cell").sortWithinPartitions("cell", "doc_id")
    found = components(group_links(members, width, percent).unionByName(repeated_ids(real, classes)))
    label = materialize(classes.join(found, F.col("head") == F.col("id"), "left").select(*key, F.least("head", F.coalesce("component", "head")).alias("component_id")), "components")
    # a row without a word stands in the component of the other rows of its doc_id, if there are any
    mixed = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least = 0 and most > 0").select("doc_id")
    beside = materialize(real.join(mixed, "doc_id").join(label, key).groupBy("doc_id").agg(F.min("component_id").alias("beside")), "beside")
    out = sets.join(label, key, "left").join(beside, "doc_id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "beside", "doc_id")).alias("component_id"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, c FROM r JOIN e ON id = a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON m.id = d.doc_id
"""


def brute_force(docs: list[tuple], width: int = WIDTH, percent: int = PERCENT) -> list[tuple]:
    """The query's rows by plain comparison, for tests."""
    import re

    fold = {i: i + 32 for i in range(65, 91)}
    sets, root = [], {}
    for doc_id, text in docs:
        w = re.findall("[^ \t-\r]+", (text or "").translate(fold))
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()))
        root.setdefault(doc_id, doc_id)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                same = len(s & t)
                if 100 * same >= percent * (len(s) + len(t) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return [(i, len(s), find(i)) for i, s in sets]
