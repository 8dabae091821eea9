"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its words and the byte n-grams of ``GRAMS`` in them, hashed to ``BUCKETS``
rows of an embedding table; the text's vector is the mean of its rows; a linear layer and a softmax
give the languages.  Table and layer are trained by stochastic gradient descent in numpy on at most
``TRAIN_ROWS`` labelled rows, dealt evenly over the languages of the whole table.  A share of them is held back, on which a temperature calibrates the
scores.  The bound of rejection is calibrated on the same rows: it lies half-way between what right
answers score at least and what junk scores at most, junk being the same texts with their bytes
shuffled; where these overlap, right answers set it.

As the layer is linear, a trained model scores a bucket once for each language, so a whole text
costs one table lookup per feature and language.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows
without a label or an id never train; without any labelled row everything is ``und``; repeated rows
are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, FOLDED_TABLES, SPACE_WORDS, carried, least_hashed, mix, segments, utf8, word_hashes, word_spans, with_carried, working_on

#: Bounds of training: rows read, and features of a row used in a step (spread over the whole text).
TRAIN_ROWS, STEP_FEATURES = 3000, 400
BUCKETS, DIMENSIONS = 1 << 15, 16
GRAMS = (2, 3)
EPOCHS, RATE, HELD_BACK = 8, 0.5, 5
#: Of the scores of right answers held back, and of junk made of the same texts, the quantiles between which the bound of rejection lies.
REJECT_QUANTILE, JUNK_QUANTILE = 0.001, 0.95
UNKNOWN = "und"


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a segment, and the place of the document of each."""
    starts, ends, at = word_spans(raw, offsets, SPACE_WORDS)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    words = word_hashes(raw, starts, ends, FOLDED_TABLES[0], BASES[0])
    found = [(words >> shift).astype(np.int32)]
    docs = [np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(at))]
    byte_doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    folded = FOLDED_TABLES[1][raw]
    inside = SPACE_WORDS[raw]
    h = folded.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(h) <= 1:
            break
        h = h[:-1] * BASES[1] + folded[n - 1 :]
        inside = inside[:-1] & SPACE_WORDS[raw[n - 1 :]]
        if n in GRAMS:
            keep = inside & (byte_doc[: len(h)] == byte_doc[n - 1 :])
            found.append((mix(h[keep]) >> shift).astype(np.int32))
            docs.append(byte_doc[: len(h)][keep])
    return np.concatenate(found), np.concatenate(docs)


def has_letter(texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


@dataclass
class Model:
    languages: list[str]
    bucket_scores: np.ndarray  # BUCKETS x languages: embedding @ layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, documents x languages."""
        buckets, docs = features(raw, offsets)
        n = len(offsets) - 1
        count = np.maximum(np.bincount(docs, minlength=n), 1)
        z = np.stack([np.bincount(docs, self.bucket_scores[buckets, k], n) for k in range(len(self.languages))], 1) / count[:, None] + self.bias
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _junk(rng: np.random.Generator, raw: np.ndarray) -> np.ndarray:
    """Features of a text whose bytes are shuffled, spaces and all."""
    return features(rng.permutation(raw[: 1 << 16]), np.array([0, min(len(raw), 1 << 16)]))[0]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit on (text, language) rows; every ``HELD_BACK``-th row only calibrates."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    raw, offsets = utf8(pa.array([t for t, _ in rows], pa.string()))
    y = np.array([languages.index(lang) for _, lang in rows])
    per_row = []
    for a, b in segments(offsets):
        buckets, docs = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.argsort(docs, kind="stable")
        per_row += np.split(buckets[order], np.cumsum(np.bincount(docs, minlength=b - a))[:-1])
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    layer += rng.normal(0, 0.1, layer.shape)
    held = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
    fit = np.flatnonzero(~held)
    weight = len(fit) / (len(languages) * np.maximum(np.bincount(y[fit], minlength=len(languages)), 1)) if len(fit) else np.ones(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            x = per_row[i]
            if not len(x):
                continue
            if len(x) > STEP_FEATURES:
                x = x[rng.integers(0, len(x), STEP_FEATURES)]
            v = table[x].mean(0)
            p = softmax((v @ layer + bias)[None])[0]
            p[y[i]] -= 1
            p *= min(weight[y[i]], 4.0)
            np.add.at(table, x, -rate * (layer @ p) / len(x) * 8)
            layer -= rate * np.outer(v, p)
            bias -= rate * 0.1 * p
    scores = table @ layer
    z = np.array([scores[x].mean(0) + bias if len(x) else bias for x in per_row])
    check = np.flatnonzero(held) if held.sum() >= 20 else np.arange(len(rows))
    grid = np.geomspace(0.02, 5, 60)
    # soft targets, as (n + 1) / (n + 2) is all that n right answers tell
    target = np.full((len(check), len(languages)), 1 / (len(check) + 2) / max(len(languages) - 1, 1))
    target[np.arange(len(check)), y[check]] = (len(check) + 1) / (len(check) + 2)
    loss = [-(target * np.log(np.maximum(softmax(z[check] / t), 1e-300))).sum(1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z[check] / temperature)
    right = p.max(1)[p.argmax(1) == y[check]]
    bound = 0.0
    if len(right):
        junk = np.array([softmax((scores[x].mean(0) + bias)[None] / temperature).max() for x in (_junk(rng, raw[offsets[i] : offsets[i + 1]]) for i in check) if len(x)])
        low, high = float(np.quantile(right, REJECT_QUANTILE)), float(np.quantile(junk, JUNK_QUANTILE)) if len(junk) else 0.0
        bound = min(low, (low + high) / 2)
    return Model(languages, scores, bias, temperature, bound)


def held_out() -> Column:
    """Documents that never train: a quarter, by the check sum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most ``max_rows`` labelled rows that aren't held out: those of each language with the least hash of id and text."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.octet_length("text").between(1, 200_000)))
    return [(r["text"], r["lang"]) for r in least_hashed(rows.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("draw")), max_rows, "lang")]


def identify(docs: DataFrame, model: Model | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row, and its columns ``carry`` as ``carried``."""
    if model is None:
        model = train(training_rows(docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("language_id")
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in segments(offsets):
                part, inner = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                known = has_letter(batch.column(2).slice(a, b - a), part, inner)
                if model is None:
                    known[:] = False
                p = model.scores(part, inner) if model is not None else np.zeros((b - a, 1))
                best = p.argmax(1)
                score = np.where(known, p.max(1), 0.0)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)] if model is not None else [UNKNOWN] * (b - a)
                rejected = ~known | (score < (model.reject_below if model is not None else 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), *[c.slice(a, b - a) for c in batch.columns[3:]]], ["doc_id", "held_out", "lang_pred", "score", "rejected", *batch.schema.names[3:]])

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *carried(carry))
    return shaped.mapInArrow(predict, with_carried("doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", shaped))
