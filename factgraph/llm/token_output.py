"""Token-ID output: documents as zstandard frames of ids, with one shared dictionary.

File format, a Parquet dataset ``blocks`` written in ascending doc_id order, one row per block:

``shard, block``      range partition of doc_id, and place within it
``rel_start``         ids of the shard before this block
``doc_ids``           the documents of the block
``min_id, max_id``    least and greatest of them, by which a point read passes over other blocks
``offsets``           n + 1 byte offsets of their frames in ``payload`` (the index for short access)
``n_tokens``          ids of each document, with the end id
``payload``           the frames, one per document, each compressed on its own
``dict_sha256``       hash of the dictionary that the frames need

and a Parquet dataset ``dictionary`` (dict_sha256, width, content).  The dictionary is trained on
the serialized id arrays of at most ``DICTIONARY_DOCS`` documents; ids are little-endian unsigned
integers of ``width`` bytes.

Defined results: a null text has no ids but the end id; an empty table makes an empty dataset; rows
that repeat a doc_id are all kept, in the order of their text; a null doc_id sorts first; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, partitions_for, shared_dir, utf8, working_on

END_ID = 1
#: Bound on the documents that train the dictionary, and on its size in bytes.
DICTIONARY_DOCS, DICTIONARY_BYTES = 1000, 64 << 10
BLOCK_BYTES = 2 << 20
#: Distinct words that a worker remembers the ids of; those not seen for long are forgotten.
MEMO_WORDS = 800_000

BLOCK_SCHEMA = "shard int, block int, rel_start long, doc_ids array<long>, min_id long, max_id long, offsets array<long>, n_tokens array<int>, payload binary, dict_sha256 string"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    The vocabulary's own pre-tokenizer drops white space and never joins characters across it, so
    a text's ids are those of its words in a row; nor does it join a letter or digit with a single
    full stop or comma at a word's end.  It folds case, so texts in Latin-1 (where folding is one to
    one) are folded before words are looked up.  Words that aren't known yet are encoded by the
    library many at a time, with a mark between them, whose id tells where one ends.
    """

    MARKS = "\u00a7\u00b6\u2020\u2021\u2022\u25a0\u25cf\u00a9\u00ae\u2122\u2192\u2605"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        # the newer and the older half of the words that are remembered
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Texts with these are encoded in one piece: special tokens (here by what they all begin
        #: with, which has no case to fold) match across words, and
        #: str.split() takes four separators for white space that the vocabulary doesn't.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = [os.path.commonprefix(special)] if special and os.path.commonprefix(special) else special
        self.apart += ["\x1c", "\x1d", "\x1e", "\x1f"]
        #: The first mark that is one id.
        self.mark, self.mark_id = next(((m, ids[0]) for m in self.MARKS if len(ids := self._ids(m)) == 1), (None, None))
        #: Folded words in Latin-1 need no further normalizing, if that shows on each such character.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        latin = [c for c in map(chr, range(33, 256)) if not c.isspace()]
        self.folds = all(self._ids(c) == self._ids(c.lower()) == self._ids(f" {c.lower()} ", True) == self._ids(c.lower(), True) for c in latin)

    def _ids(self, text: str, folded: bool = False) -> list[int]:
        return (self.plain if folded else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _serialize(self, ids: list[int]) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _split(self, text: str) -> list[str]:
        if self.folds:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split()

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered."""
        alone = words if self.mark is None else [w for w in words if self.mark in w]
        if self.mark is not None:
            joined = [w for w in words if self.mark not in w] if alone else words
            latin = [w for w in joined if max(w) < "\u0100" and w == w.lower()] if self.folds else []
            other = list(set(joined).difference(latin)) if len(latin) < len(joined) else []
            for some, folded in ((latin, True), (other, False)):
                for a in range(0, len(some), 5000):
                    alone = alone + self._learn_joined(some[a : a + 5000], folded)
        for word in alone:
            self.memo[word] = self._serialize(self._ids(word))

    def _learn_joined(self, words: list[str], folded: bool) -> list[str]:
        """Encode words in one call; returns them if the marks don't tell them apart."""
        ids = np.array(self._ids(f" {self.mark} ".join(words), folded), f"<u{self.width}")
        cut = np.flatnonzero(ids == self.mark_id) * self.width
        if len(cut) != len(words) - 1:
            return words
        raw = ids.tobytes()
        starts, ends = [0, *(cut + self.width).tolist()], [*cut.tolist(), len(raw)]
        self.memo.update(zip(words, [raw[x:y] for x, y in zip(starts, ends)]))
        return []

    def _know(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS // 2:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        missing = words - memo.keys()
        known = missing & older.keys()
        memo.update((w, older[w]) for w in known)
        # a single full stop or comma after a letter or digit is a piece of its own
        missing -= known
        ended = {w for w in missing if w[-1] in ".," and w[-2:-1].isalnum() and w[-2:-1] < "\u0100"}
        stems = (missing - ended) | {w[:-1] for w in ended} | {".", ","}
        stems -= memo.keys()
        known = stems & older.keys()
        memo.update((w, older[w]) for w in known)
        self._learn(list(stems - known))
        memo.update((w, memo[w[:-1]] + memo[w[-1]]) for w in ended)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, without the end id."""
        split = []
        for text in texts:
            if any(s in text for s in self.apart):
                split.append(None)
            else:
                split.append(self._split(text))
        self._know(set().union(*(w for w in split if w)))
        ids = self.memo.__getitem__
        return [b"".join(map(ids, words)) if words is not None else self._serialize(self._ids(texts[i])) for i, words in enumerate(split)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, for as long as it works on this operator."""
    working_on("token_output", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str, max_docs: int = DICTIONARY_DOCS, max_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of at most ``max_docs`` documents of at most 100,000 bytes, those with the least hash.

    With too little text to train on, the samples themselves serve as a raw dictionary.
    """
    rows = least_hashed(docs.where(F.octet_length("text").between(1, 100_000)).select("text", F.xxhash64("doc_id", "text").alias("draw")), max_docs)
    samples = encoder(path).encode([r["text"] for r in rows])
    try:
        return zstandard.train_dictionary(max_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-max_bytes:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_tokens(docs: DataFrame, path: str, out: str) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file ``path`` into the dataset ``out``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    content = train_dictionary(docs, path)
    digest = hashlib.sha256(content).hexdigest()
    width = encoder(path).width
    _encoders.clear()  # the driver needs it no more
    spark.createDataFrame([(digest, width, bytearray(content))], "dict_sha256 string, width int, content binary").write.parquet(f"{out}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(path).encode
        compress = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(content), write_content_size=True).compress
        end = np.asarray([END_ID], f"<u{width}").tobytes()
        block, done, ids, frames, counts, size = 0, 0, [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "rel_start": done, "doc_ids": ids, "min_id": min((i for i in ids if i is not None), default=None), "max_id": max((i for i in ids if i is not None), default=None), "offsets": offsets.tolist(), "n_tokens": counts, "payload": b"".join(frames), "dict_sha256": digest}], schema=_arrow_blocks())

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a in range(0, len(doc_ids), 1000):
                texts = [t or "" for t in batch.column(1).slice(a, 1000).to_pylist()]
                for doc_id, coded in zip(doc_ids[a : a + 1000], encode(texts)):
                    frame = compress(coded + end)
                    ids.append(doc_id)
                    frames.append(frame)
                    counts.append(len(coded) // width + 1)
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield row()
                        block, done, ids, frames, counts, size = block + 1, done + sum(counts), [], [], [], 0
        if ids:
            yield row()

    n = partitions_for(spark, n_bytes)
    (
        docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(f"{out}/blocks")
    )


def _arrow_blocks() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("rel_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("min_id", pa.int64()), ("max_id", pa.int64()), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary()), ("dict_sha256", pa.string())])


def open_frames(payload: bytes, offsets: list[int], content: bytes, wanted: list[int] | None = None) -> list[bytes]:
    """Serialized ids of the block's documents, or of those at the places ``wanted`` alone."""
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress
    return [expand(payload[offsets[i] : offsets[i + 1]]) for i in (range(len(offsets) - 1) if wanted is None else wanted)]


def read_dictionary(spark: SparkSession, out: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{out}/dictionary").first()
    return row["dict_sha256"], row["width"], bytes(row["content"])


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[int] | None:
    """Ids of one document, by the index alone and its own frame."""
    digest, width, content = read_dictionary(spark, out)
    place = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    row = spark.read.parquet(f"{out}/blocks").where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id) & (place > 0)).withColumn("i", place.cast("int")).select("dict_sha256", F.expr("substring(payload, cast(offsets[i - 1] as int) + 1, cast(offsets[i] - offsets[i - 1] as int))").alias("frame")).first()
    if row is None:
        return None
    if row["dict_sha256"] != digest:
        raise ValueError("the frames were written with another dictionary")
    frame = bytes(row["frame"])
    return np.frombuffer(open_frames(frame, [0, len(frame)], content)[0], f"<u{width}").tolist()


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the dataset ``out``."""
    digest, width, content = read_dictionary(spark, out)
    blocks = spark.read.parquet(f"{out}/blocks")
    # one row per shard: as many as there were partitions
    totals = blocks.groupBy("shard").agg(F.max(F.col("rel_start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).orderBy("shard").collect()
    bases, run = {}, 0
    for shard, n in totals:
        bases[shard] = run
        run += n

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                if r["dict_sha256"] != digest:
                    raise ValueError("the frames were written with another dictionary")
                ids = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in open_frames(r["payload"], r["offsets"], content)]
                n = np.array([len(x) for x in ids], np.int64)
                if n.tolist() != r["n_tokens"]:
                    raise ValueError("a frame doesn't hold the ids that the index tells")
                start = bases[r["shard"]] + r["rel_start"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, path: str | None = None, out: str | None = None) -> DataFrame:
    """Write ``docs`` in the file format and return what the files hold of each document."""
    spark = docs.sparkSession
    out = out or shared_dir(spark, "tokens")
    write_tokens(docs, path or tokenizer_path(), out)
    return read_digests(spark, out)
