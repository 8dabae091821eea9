"""Long repeated passages across a corpus: the distributed part that both indexes share.

Texts are sequences of units (bytes or words) and a passage is a window of ``width`` consecutive
units of one document.  The steps:

1. ``anchors``: in each window the run of ``gram`` units with the least hash is its anchor, which
   depends on the window's content alone.  Neighbouring windows share anchors, so a text has one
   row per anchor: the anchor's hash, a hash of the content its windows cover, and their place.
2. Rows meet by anchor hash.  Rows of equal content are likely copies: all but the first are linked
   to it.  They were already told apart within each task before the shuffle, so a passage in a third
   of all documents is a row per task.
3. Links of neighbouring anchors are united into ranges: a shard has ranges of one document and the
   ranges of others that are linked to them (``streams``), cut so that no shard outgrows an index.
4. Anchors with several contents can share single windows.  A shard has all contents of an anchor.
5. The ranges of both kinds are fetched and go into the index of their shard (``build``), which
   tells the windows that occur earlier.  Equal ranges of a shard (by bytes) are streamed once.
   Anchors with more than ``HOT_CONTENTS`` contents are resolved window by window instead, dealt by
   window hash.
6. Runs of repeated windows are collected by document and cut from its text.

Hashes only say what meets in an index; a window goes if the index finds its units in an earlier
place.  Windows of anchors with very many contents are equal if two independent 64-bit hashes are.

A document is named by its doc_id and a hash of its text (``key``), and is earlier than another by
that order.  So rows without an id, and rows that repeat an id with another text, are documents of
their own; only rows of one doc_id with the same text are one document, and stay or go alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, materialize_freed, mix, partitions_for, segments, utf8, working_on
from .suffix_index import order_of

#: Window starts that are hashed at a time.
PIECE = 1 << 19
#: Anchor rows that a task gathers before it drops repeats among them.
GATHER_ROWS = 1 << 20
#: Units in one index, and contents of an anchor above which its windows are dealt one by one.
INDEX_UNITS, HOT_CONTENTS = 1 << 19, 1000
#: Bytes of contents in a batch, about.
CONTENT_BYTES = 1 << 22
#: Windows of a first document that make a shard with the ranges linked to them.
BLOCK = 512
_PLACE_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Kind:
    """What a unit and a passage are.

    units      raw bytes and offsets of documents -> two hash arrays of units and their offsets
    contents   raw bytes of a document, unit ranges -> the bytes of each content, None past the end
    build      contents, width -> per content the class of each window (equal windows, equal class)
    same_doc   whether an earlier start in the same document counts
    """

    width: int
    gram: int
    same_doc: bool
    units: Callable
    contents: Callable
    build: Callable


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_tables: dict[tuple, tuple] = {}


def _ranges(values: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ranges [lo, hi) of ``values``, with the base ``k``."""
    n = PIECE + 4096
    if len(values) > n:
        up, down = _powers(BASES[k], len(values))  # not kept: texts have many lengths
    else:
        if (k, n) not in _tables:
            _tables[k, n] = _powers(BASES[k], n)
        up, down = _tables[k, n]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo])


def window_minima(key: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive keys."""
    n = len(key) - size + 1
    padded = np.full(-(-len(key) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def anchors(one: np.ndarray, two: np.ndarray, at: np.ndarray, width: int, gram: int) -> Iterator[tuple]:
    """doc, lo, hi (window starts in the document), anchor hash and content hash of each anchor."""
    for c in range(0, max(len(one) - width + 1, 0), PIECE):
        a, b = one[c : c + PIECE + width - 1], two[c : c + PIECE + width - 1]
        n = len(a) - width + 1
        starts = np.arange(len(a) - gram + 1)
        grams = _ranges(a, 0, starts, starts + gram)
        least = window_minima((grams & ~_PLACE) | starts.astype(np.uint64), width - gram + 1)
        place = (least & _PLACE).astype(np.int64)
        doc = np.searchsorted(at, np.arange(c, c + n), "right") - 1
        valid = np.arange(c, c + n) + width <= at[doc + 1]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
        lo, hi = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        if len(lo):
            inner = place[lo]
            content = _ranges(b, 1, lo, hi - 1 + width)
            content = mix(content ^ ((hi - lo).astype(np.uint64) << np.uint64(32)) ^ (inner - lo).astype(np.uint64))
            base = at[doc[lo]] - c
            yield doc[lo], lo - base, hi - base, grams[inner], content


def _firsts(h1, h2, doc, lo):
    """Sorted order by (h1, h2, doc, lo), and where a new (h1, h2) begins in it."""
    order = np.lexsort((lo, doc, h2, h1))
    s1, s2 = h1[order], h2[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    return order, fresh


def _sorted_by(*keys: np.ndarray) -> np.ndarray:
    """Order by several keys of no negative numbers, as one number where they fit into it (a faster sort)."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(len(keys[0]), np.int64)
    for k, n in zip(keys, bits):
        packed = packed << n | k
    return order_of(packed, (1 << sum(bits)) - 1)[0]


def _merge_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite ranges [lo, hi) of the same document that touch or overlap."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # ranges of one document: the furthest end so far, told apart by a shift per document
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    reach = np.maximum.accumulate(hi + group * (1 << 33)) - group * (1 << 33)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def _merge_contents(h1, doc, lo, hi) -> tuple:
    """Unite neighbouring contents of an anchor in a document, as a text that repeats itself has many."""
    order = np.lexsort((lo, doc, h1))
    h1, doc = h1[order], doc[order]
    group = np.cumsum(np.concatenate([[0], ((h1[1:] != h1[:-1]) | (doc[1:] != doc[:-1])).astype(np.int64)]))
    own, start, end = _merge_runs(group, lo[order].astype(np.int64), hi[order].astype(np.int64))
    at = np.searchsorted(group, own)
    return h1[at], doc[at], start, end


def _ranked(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Numbers of documents in order of (doc_id, key), and the names (doc_ids, keys) by number."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, (ids[new], keys[new])


ROWS = "kind byte, h1 long, h2 long, doc_id long, key long, lo int, hi int, at int"
NAME = ["doc_id", "key"]
_ARROW = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])
#: Kinds of rows: an anchor or window, a removed range, a range to fetch for shard h1, one of a hot
#: anchor, and a range equal to one of document (h1, h2) that starts with the window ``at``.
ANCHOR, REMOVED, FETCH, HOT, LINK = range(5)


def _batch(kind: int, h1, h2, doc, lo, hi, names: tuple, at=None) -> pa.RecordBatch:
    as_long = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(as_long(h1)), pa.array(as_long(h2)), pa.array(as_long(names[0][doc])), pa.array(as_long(names[1][doc])), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.zeros(len(doc), np.int32) if at is None else at.astype(np.int32))], schema=_ARROW)


def _removed(doc, lo, hi, names: tuple) -> pa.RecordBatch:
    doc, lo, hi = _merge_runs(doc, lo, hi)
    h1 = mix(names[0][doc].astype(np.uint64) ^ mix(names[1][doc].astype(np.uint64)))
    return _batch(REMOVED, h1, np.zeros(len(doc), np.int64), doc, lo, hi, names)


def _resolve(h1, h2, doc, lo, same_doc: bool) -> tuple:
    """Indices of rows that are first in their (h1, h2), of other rows to keep, of the repeats, and of the first row of each repeat."""
    order, fresh = _firsts(h1, h2, doc, lo)
    group = np.cumsum(fresh) - 1
    first = order[fresh][group]
    later = doc[order] > doc[first]
    if same_doc:
        later |= lo[order] != lo[first]
    # rows of one document with the same text have the same windows at the same places
    again = ~fresh
    again[1:] &= (doc[order][1:] == doc[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    return order[fresh], order[~fresh & ~later & ~again], order[later & ~again], first[later & ~again]


def streams(doc, lo, hi, first, at, width: int, salt: int, block: int, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (shard, doc, lo, hi) that bring ranges of window starts, and the ranges of ``first`` from ``at`` that they are linked to, into shards.

    A shard is ``block`` windows of one document and what is linked to them.  Of ranges of many
    documents, or of a text that repeats itself, about ``units`` go to a shard, and each has the block.
    ``salt`` tells the shards of tasks apart, so a block that all tasks have is no hot key.
    """
    part = at // block
    group = np.unique(first * (part.max() + 1) + part, return_inverse=True)[1]
    own, copy, start, end = _merge_contents(group, doc, lo, hi)
    pieces = -(-(end - start) // (4 * block))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    own, copy, last = np.repeat(own, pieces), np.repeat(copy, pieces), np.repeat(end, pieces)
    start = np.repeat(start, pieces) + nth * 4 * block
    end = np.minimum(start + 4 * block, last)
    # rows are in order of group: units of the group so far
    total = np.cumsum(end - start + width)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    begun = (total - (end - start + width))[new]
    cut = (total - begun[np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))]) // units
    shard = mix(mix(own.astype(np.uint64) ^ np.uint64(salt % (1 << 63))) ^ mix(cut.astype(np.uint64) + np.uint64(salt % 997)))
    # each shard with the ranges of its block
    there, source, from_, to = _merge_contents(group, first, at, at + hi - lo)
    edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (cut[1:] != cut[:-1])]))
    n = np.searchsorted(there, own[edge], "right") - np.searchsorted(there, own[edge], "left")
    pick = np.repeat(np.searchsorted(there, own[edge], "left"), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate([shard, np.repeat(shard[edge], n)]), np.concatenate([copy, source[pick]]), np.concatenate([start, from_[pick]]), np.concatenate([end, to[pick]])


def _salt(stage: int, flush: int) -> int:
    """A number of its own for each flush of each task, the same when the task is run again."""
    context = TaskContext.get()
    return int(mix(np.array([((stage << 20 | flush) << 32) + (context.partitionId() if context else 0)], np.uint64))[0])


def _scan(kind: Kind):
    """Anchor rows of documents, without those that repeat another row of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("repeats")
        held, named, n, docs, flushes = [], [], 0, 0, 0

        def flush():
            h1, h2, doc, lo, hi = (np.concatenate(x) for x in zip(*held))
            rank, names = _ranked(*(np.concatenate(x) for x in zip(*named)))
            doc = rank[doc]
            first, more, copies, of = _resolve(h1, h2, doc, lo, kind.same_doc)
            keep = np.concatenate([first, more])
            yield _batch(ANCHOR, h1[keep], h2[keep], doc[keep], lo[keep], hi[keep], names)
            if len(copies):
                shard, doc, lo, hi = streams(doc[copies], lo[copies], hi[copies], doc[of], lo[of], kind.width, _salt(1, flushes), BLOCK, INDEX_UNITS)
                yield _batch(FETCH, shard, np.zeros(len(shard), np.int64), doc, lo, hi, names)

        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in segments(offsets, PIECE):
                one, two, at = kind.units(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for doc, lo, hi, h1, h2 in anchors(one, two, at, kind.width, kind.gram):
                    held.append((h1.view(np.int64), h2.view(np.int64), docs + doc, lo, hi))
                    n += len(doc)
                named.append((ids[a:b], keys[a:b]))
                docs += b - a
                if n >= GATHER_ROWS:
                    yield from flush()
                    held, named, n, docs, flushes = [], [], 0, 0, flushes + 1
        if held:
            yield from flush()

    return run


def _meet(kind: Kind, windows: bool):
    """Rows sorted by h1 -> the contents that the index needs and the links of equal ones; of hot anchors' windows the removed ones."""

    def groups(rows: list) -> Iterator[pa.RecordBatch]:
        tag, h1, h2, ids, keys, lo, hi = (np.concatenate(x) for x in zip(*rows))
        doc, names = _ranked(ids, keys)
        for kept in (FETCH, REMOVED):
            passed = tag == kept
            if passed.any():
                yield _batch(kept, h1[passed], h2[passed], doc[passed], lo[passed], hi[passed], names)
        passed = tag == ANCHOR
        h1, h2, doc, lo, hi = (x[passed] for x in (h1, h2, doc, lo, hi))
        if len(h1):
            first, same, later, of = _resolve(h1, h2, doc, lo, kind.same_doc)
            if windows:
                if len(later):
                    yield _removed(doc[later], lo[later], hi[later] + kind.width - 1, names)
                return
            if len(later):
                yield _batch(LINK, names[0][doc[of]], names[1][doc[of]], doc[later], lo[later], hi[later], names, lo[of])
            # contents of each anchor; a content's other places in its first document go with it
            known, contents = np.unique(h1[first], return_counts=True)
            places = np.concatenate([first, same])
            count = contents[np.searchsorted(known, h1[places])]
            for tag_out, pick in ((FETCH, (count > 1) & (count <= HOT_CONTENTS)), (HOT, count > HOT_CONTENTS)):
                f = places[pick]
                if len(f):
                    wanted = _merge_contents(h1[f], doc[f], lo[f], hi[f])
                    yield _batch(tag_out, wanted[0], np.zeros(len(wanted[0]), np.int64), *wanted[1:], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy() for i in range(7))
            if not len(rows[0]):
                continue
            # hold back the last anchor's rows, as it may go on in the next batch
            cut = int(np.searchsorted(rows[1], rows[1][-1], "left"))
            if cut:
                yield from groups([*held, tuple(x[:cut] for x in rows)])
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield from groups(held)

    return run


def _dealt(df: DataFrame, n: int, kind: Kind, windows: bool = False) -> DataFrame:
    return df.repartition(n, "h1").sortWithinPartitions("h1").mapInArrow(_meet(kind, windows), ROWS)


def _linked(kind: Kind):
    """Links dealt by document -> ranges to fetch."""

    def flush(rows: list, flushes: int) -> pa.RecordBatch:
        first_ids, first_keys, ids, keys, lo, hi, at = (np.concatenate(x) for x in zip(*rows))
        doc, names = _ranked(np.concatenate([ids, first_ids]), np.concatenate([keys, first_keys]))
        shard, doc, lo, hi = streams(doc[: len(ids)], lo, hi, doc[len(ids) :], at, kind.width, _salt(2, flushes), BLOCK, INDEX_UNITS)
        return _batch(FETCH, shard, np.zeros(len(shard), np.int64), doc, lo, hi, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, flushes = [], 0, 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy().astype(np.int64) for i in range(1, 8)))
            n += batch.num_rows
            if n >= GATHER_ROWS:
                yield flush(held, flushes)
                held, n, flushes = [], 0, flushes + 1
        if n:
            yield flush(held, flushes)

    return run


def _fetch(kind: Kind):
    """Documents with the contents wanted of them -> contents, and windows of hot anchors."""
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("content", pa.binary())])

    def with_content(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], schema=schema)

    def windows(held: list) -> Iterator[pa.RecordBatch]:
        """Windows of hot anchors, a window that several documents of the task have once."""
        h1, h2, ids, keys, lo = (np.concatenate(x) for x in zip(*held))
        doc, names = _ranked(ids, keys)
        first, same, gone, _ = _resolve(h1, h2, doc, lo, kind.same_doc)
        keep = np.concatenate([first, same])
        yield with_content(_batch(HOT, h1[keep], h2[keep], doc[keep], lo[keep], lo[keep] + 1, names))
        if len(gone):
            yield with_content(_removed(doc[gone], lo[gone], lo[gone] + kind.width, names))

    def contents(parts: list, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """Contents of several documents as one batch."""
        h1, lo, hi, doc, found = (list(x) for x in zip(*parts))
        h1, lo, hi = (np.concatenate(x) for x in (h1, lo, hi))
        doc = np.repeat(doc, [len(f) for f in found])
        rows = _batch(FETCH, h1, np.zeros(len(h1), np.int64), doc, lo, hi, (ids, keys))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([c for f in found for c in f], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            ids, keys, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            spots, at = wanted.flatten(), np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
            tag, shard, start, stop = (spots.field(k).to_numpy() for k in ("kind", "h1", "lo", "hi"))
            plain = tag == FETCH
            parts, size = [], 0
            for d in range(batch.num_rows):
                text, own = raw[offsets[d] : offsets[d + 1]], slice(at[d], at[d + 1])
                pick = plain[own]
                if pick.any():
                    h1, lo, hi = (x[own][pick] for x in (shard, start, stop))
                    found = kind.contents(text, lo, hi - 1 + kind.width)
                    ok = [i for i, x in enumerate(found) if x is not None]
                    parts.append((h1[ok], lo[ok], hi[ok], d, [found[i] for i in ok]))
                    size += sum(map(len, parts[-1][4]))
                    if size >= CONTENT_BYTES:
                        yield contents(parts, ids, keys)
                        parts, size = [], 0
                hot = [{"lo": a, "hi": b} for a, b in zip(start[own][~pick], stop[own][~pick])]
                if hot:
                    one, two, _ = kind.units(text, np.array([0, len(text)]))
                    s = np.unique(np.concatenate([np.arange(x["lo"], x["hi"]) for x in hot]))
                    s = s[s + kind.width <= len(one)]
                    h1, h2 = _ranges(one, 0, s, s + kind.width), _ranges(two, 1, s, s + kind.width)
                    held.append((h1.view(np.int64), h2.view(np.int64), np.full(len(s), ids[d], np.int64), np.full(len(s), keys[d], np.int64), s))
                    n += len(s)
                    if n >= GATHER_ROWS:
                        yield from windows(held)
                        held, n = [], 0
            if parts:
                yield contents(parts, ids, keys)
        if n:
            yield from windows(held)

    return run


def _index(kind: Kind):
    """Contents sorted by anchor -> removed ranges, by one index for many anchors."""

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        doc, names = _ranked(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        lo, contents = np.array([r[3] for r in rows], np.int64), [r[4] for r in rows]
        order = np.lexsort((lo, doc))
        contents = [contents[i] for i in order]
        doc, lo = doc[order], lo[order]
        distinct: dict[bytes, int] = {}
        which = [distinct.setdefault(c, len(distinct)) for c in contents]
        classes = kind.build(list(distinct), kind.width)
        classes = [classes[i] for i in which]
        owner = np.repeat(np.arange(len(contents)), [len(c) for c in classes])
        cls = np.concatenate(classes)
        start = lo[owner] + np.concatenate([np.arange(len(c)) for c in classes])
        by = _sorted_by(cls, np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))[owner], start)
        fresh = np.ones(len(by), bool)
        fresh[1:] = cls[by][1:] != cls[by][:-1]
        first = by[fresh][np.cumsum(fresh) - 1]
        later = ~fresh if kind.same_doc else doc[owner[by]] > doc[owner[first]]
        # the same window, in contents of one document that overlap, is no repeat of itself
        later &= (doc[owner[by]] != doc[owner[first]]) | (start[by] != start[first])
        gone = by[later]
        if len(gone):
            yield _removed(doc[owner[gone]], start[gone], start[gone] + kind.width, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, previous = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 8))):
                if row[0] != previous and size >= INDEX_UNITS:
                    yield from solve(held)
                    held, size = [], 0
                previous = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield from solve(held)

    return run


def repeated_ranges(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """texts (doc_id, key, text, unnamed, dealt by name) and the removed ranges (doc_id, key, ranges) of documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a null doc_id stands as the greatest one; its key tells it from a row that has that id
    unnamed = F.col("doc_id").isNull()
    docs = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(unnamed, "text").alias("key"), "text", unnamed.alias("unnamed"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = partitions_for(spark, n_bytes)
    met = materialize_freed(_dealt(docs.mapInArrow(_scan(kind), ROWS), n, kind), "repeats")
    texts = docs.repartition(n, *NAME)
    links = met.where(F.col("kind") == LINK).repartition(n, *NAME).sortWithinPartitions(*NAME, "lo").mapInArrow(_linked(kind), ROWS)
    wanted = met.unionByName(links).where(F.col("kind").isin(FETCH, HOT)).groupBy(*NAME).agg(F.collect_list(F.struct("kind", "h1", "lo", "hi")).alias("wanted"))
    fetched = materialize_freed(texts.join(wanted, NAME).select(*NAME, "text", "wanted").mapInArrow(_fetch(kind), f"{ROWS}, content binary"), "contents")
    indexed = fetched.where(F.col("kind") == FETCH).repartition(n, "h1").sortWithinPartitions("h1").mapInArrow(_index(kind), ROWS)
    hot = _dealt(fetched.where(F.col("kind") == HOT).select(F.lit(ANCHOR).cast("byte").alias("kind"), "h1", "h2", *NAME, "lo", "hi", "at"), n, kind, windows=True)
    removed = met.unionByName(fetched.drop("content")).unionByName(indexed).unionByName(hot).where(F.col("kind") == REMOVED)
    ranges = removed.groupBy(*NAME).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return texts, ranges


def cut(docs: DataFrame, kind: Kind, apply: Callable, schema: str) -> DataFrame:
    """Rows of ``apply(doc_id, raw bytes, merged ranges)`` for every document."""
    texts, ranges = repeated_ranges(docs, kind)
    arrow_types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    arrow = pa.schema([(name, arrow_types[kind_]) for name, kind_ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids, ranges = batch.column(0).to_pylist(), batch.column(2)
            flat = ranges.flatten() if len(ranges) else None
            sizes = np.array([len(x) if x.is_valid else 0 for x in ranges], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) if flat is not None and len(flat) else np.zeros(0, np.int64) for i in (0, 1))
            rows = []
            for d, doc_id in enumerate(ids):
                a, b = at[d], at[d + 1]
                _, x, y = _merge_runs(np.zeros(b - a, np.int64), lo[a:b].astype(np.int64), hi[a:b].astype(np.int64))
                rows.append((doc_id, *apply(raw[offsets[d] : offsets[d + 1]], x, y)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return texts.join(ranges, NAME, "left").select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "text", "ranges").mapInArrow(run, schema)
