"""Personal data by candidate gradient boosting.

1. High-recall generators propose overlapping spans per kind: loose forms of e-mail addresses
   (also with "at" and "dot" spelled out), IP addresses, card numbers and telephone numbers, and
   runs of letters and digits that may be secrets (keys, tokens, passwords), a kind that the base
   rules don't know.
2. Boosted trees score each candidate that the strict base rules don't hold, on format features
   (lengths, digit groups, separators, letter mix) and context features (characters and cue words
   around it).
3. A calibrated threshold per kind selects redactions.  Base spans always stay; a selected span is
   added where it overlaps no span that is already kept.

Labels come from the corpus itself, of a bounded sample of documents.  A span that a strict rule
holds is a positive, as it stands and, with its strict form hidden, rewritten into a loose form in
its own context; for secrets the strict rule is a quoted value that is assigned to a name such as
"token".  Candidates that no strict rule holds are negatives, beside look-alikes (dates, versions,
amounts, identifiers) set into contexts of the corpus.  A quarter of the documents is held back:
their candidates calibrate the scores, set each kind's threshold as the least score that keeps
``PRECISION`` of what is selected, and give the recall and precision in ``Model.report``.

Defined results: a null or empty text has no spans; repeated rows and null ids are rows like any
other; very long texts are searched whole, in linear time; other columns are ignored.  Places are
code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: those of the base rules, and those that candidates alone have.
ALL_KINDS = (*KINDS, "secret")
#: Bounds of training: documents read and bytes of each, and candidates of a kind and label.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_CANDIDATES = 2000, 100_000, 1500
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
#: The share of candidates held back above a threshold that must be positives.
PRECISION = 0.99
CONTEXT = 24

# --- the base rules ----------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
# a match can only start where a run of digits starts, so the look-behind keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail matches: each lies in one run of the characters it may have, around an at sign."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _EMAIL_RUN.match(text, start).end()
        run = text[start:end]
        # from an at sign no match starts, and one needs a local part before it
        for m in _EMAIL.finditer(run):
            yield start + m.start(), start + m.end()
        done = end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, by kind as listed and then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# --- generators --------------------------------------------------------------------------------

_LOOSE = {
    "email": re.compile(r"[\w.%+-]{2,64}(?:\s?(?:@|\(at\)|\[at\])\s?[\w-]{2,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[\w-]{2,63}){1,4}|\sat\s[\w-]{2,63}(?:\s(?:\(dot\)|\[dot\]|dot)\s[\w-]{2,63}){1,4})"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}|[0-9]{1,3}(?:(?:\s?\[?\.\]?\s?)[0-9]{1,3}){3})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-][0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
}
#: Where a loose e-mail address goes on after its local part.
_AT = re.compile(r"\s?(?:@|\(at\)|\[at\])|\sat(?=\s[\w-]{2,63}\s(?:\(dot\)|\[dot\]|dot)\s)")
_LOCAL_RUN = re.compile(r"[\w.%+-]")
_DIGIT_AREA = re.compile(r"[0-9][0-9a-fA-F:.()\[\]/ _-]{6,}[0-9a-fA-F]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])(?=[0-9_/+-]*[A-Za-z])[A-Za-z0-9_/+-]{16,}={0,2}")
#: The strict form of a secret, which labels training candidates.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']([A-Za-z0-9_/+-]{16,}={0,2})[\"']")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Loose spans of all kinds; they may overlap."""
    out = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and _LOCAL_RUN.match(text[start - 1]):  # a local part has at most 64 characters
            start -= 1
        x = _LOOSE["email"].match(text, start) if start < m.start() else None
        if x:
            out.append(("email", start, x.end()))
    for area in _DIGIT_AREA.finditer(text):
        # a character before and after, for what must not stand there
        a, b = max(0, area.start() - 8), min(len(text), area.end() + 8)
        part = text[a:b]
        for kind in KINDS[1:]:
            out += [(kind, a + x.start(), a + x.end()) for x in _LOOSE[kind].finditer(part)]
    out += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text)]
    return sorted(set(out))


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that label training candidates: the base rules', and assigned secrets."""
    return base_spans(text) + [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]


# --- features ----------------------------------------------------------------------------------

#: Cue words, as hashed context would need far more rows.
_CUES = {
    "email": ("mail", "contact", "write", "address", "inbox"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "credit", "pay", "account", "master"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "number"),
    "secret": ("token", "secret", "password", "passwd", "key", "auth", "bearer", "credential"),
}
_AGAINST = ("version", "isbn", "date", "page", "section", "figure", "score", "range", "total", "ratio", "serial", "order", "id", "no.")


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context features of one candidate."""
    s = text[a:b]
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    numbers = [int(g) for g in re.findall("[0-9]{1,4}", s)][:8]
    digits = sum(groups)
    return [
        ALL_KINDS.index(kind),
        len(s),
        digits,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        max(numbers, default=0),
        sum(n > 255 for n in numbers),
        sum(1900 <= n <= 2100 for n in numbers),
        sum(c.isalpha() for c in s) / len(s),
        s.count("."),
        s.count("-"),
        s.count("/"),
        s.count(" "),
        s.count(":"),
        s.count("("),
        s.count("@") + s.count("at)") + s.count("at]"),
        len(set(re.findall("[^0-9A-Za-z]", s))),
        float(luhn(_digits(s))) if digits else 0.0,
        len(re.split(r"[.\s]", s)[-1]),
        sum(w in before for w in _CUES[kind]),
        sum(w in before for w in _AGAINST),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-2:-1] in ":=" if before[-2:-1] else 0),
        float(any(c in after[:2] for c in "%$€")),
        sum(c in "0123456789abcdefABCDEF" for c in s) / len(s),
        len(set(s)) / len(s),
        float(before[-1:] in ("'", '"')),
        float("=" in before[-4:] or ":" in before[-4:]),
    ]


N_FEATURES = len(describe("a1", "secret", 0, 2))

# --- boosted trees in numpy --------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, with features cut into quantile bins."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features and bins by node, values by leaf
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)
    rate = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(cuts, [], float(np.log(rate / (1 - rate))))
    margin = np.full(len(y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        n_inner = 2**DEPTH - 1
        feature, cut, value = np.zeros(n_inner, np.int64), np.full(n_inner, BINS), np.zeros(2**DEPTH)
        node = np.zeros(len(y), np.int64)
        for inner in range(n_inner):
            rows = np.flatnonzero(node == inner)
            best = 1e-6
            if len(rows) >= 10:
                for j in range(x.shape[1]):
                    g = np.cumsum(np.bincount(binned[rows, j], grad[rows], BINS))
                    h = np.cumsum(np.bincount(binned[rows, j], hess[rows], BINS))
                    gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                    k = int(np.argmax(gain[:-1]))
                    if gain[k] > best:
                        best, feature[inner], cut[inner] = gain[k], j, k
            node[rows] = 2 * inner + 1 + (binned[rows, feature[inner]] > cut[inner])
        leaf = node - n_inner
        value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
        margin += value[leaf]
        model.trees.append((feature, cut, value))
    return model


@dataclass
class Model:
    trees: Trees
    #: Platt's slope and offset, and the threshold of each kind on the calibrated score.
    slope: float
    offset: float
    thresholds: dict[str, float]
    #: Of the candidates held back, by kind: positives, negatives, recall and precision at the threshold.
    report: dict[str, dict]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.offset)))


# --- training rows -----------------------------------------------------------------------------


def _loosened(rng: np.random.Generator, kind: str, s: str) -> str:
    """A strict span rewritten so that the strict rule no longer takes it."""
    pick = lambda *v: v[int(rng.integers(len(v)))]
    if kind == "secret":
        return s[: int(rng.integers(16, max(len(s), 16) + 1))]
    if kind == "email":
        at, dot = pick((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))
        name, _, host = s.partition("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        parts = s.split(".")
        return pick("[.]".join(parts), " . ".join(parts), ":".join(f"{int(p) * 257 % 65536:x}" for p in parts) + ":1")
    if kind == "card":
        d = _digits(s)
        return pick(".", "/", "_").join([d[:4], d[4:8], d[8:12], d[12:]])
    d = _digits(s)
    return pick(f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"00{d[:-10] or 1} {d[-10:-7]} {d[-7:-4]} {d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}")


def _harmless(rng: np.random.Generator, kind: str) -> str:
    """Text that a generator takes for the kind though it is no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    if kind == "secret":
        word = lambda: "".join(chr(n(97, 123)) for _ in range(n(4, 9)))
        return [f"{word()}/{word()}/{word()}{n(1, 99)}", f"{word()}_{word()}_{word()}_{n(1990, 2030)}", f"{word()}-{word()}-{word()}-{n(1, 9)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}00Z"][n(0, 4)]
    if kind == "email":
        return ["look at this.then go", "meet at noon dot then", "@import url.css", f"price@{n(1, 99)}.{n(10, 99)}", "was at home. They ate"][n(0, 5)]
    if kind == "ip":
        return [f"version {n(1, 20)}.{n(300, 999)}.{n(0, 999)}.{n(0, 999)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}:{n(10, 60)}", f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}"][n(0, 3)]
    if kind == "card":
        return [f"{n(1990, 2030)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(1, 99)}", f"serial {n(1000, 9999)}/{n(1000, 9999)}/{n(1000, 9999)}/{n(1, 9)}", f"{n(1000, 2000)} {n(1000, 2000)} {n(1000, 2000)} {n(1000, 2000)}"][n(0, 3)]
    return [f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(10, 29)}/{n(10, 13)}/{n(1990, 2030)}", f"pages {n(100, 200)}-{n(200, 300)} {n(10, 99)}", f"total {n(100, 999)} {n(100, 999)} {n(100, 999)}", f"{n(10, 99)}.{n(10, 99)}.{n(10, 99)}"][n(0, 5)]


def training_candidates(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``TRAIN_CANDIDATES`` candidates of each kind, label and origin."""
    rng = np.random.default_rng(seed)
    rows, labels, count = [], [], dict.fromkeys(((k, label, o) for k in ALL_KINDS for label in (0, 1) for o in ("own", "made")), 0)

    def add(text: str, kind: str, a: int, b: int, label: int, origin: str) -> None:
        if count[kind, label, origin] < TRAIN_CANDIDATES:
            count[kind, label, origin] += 1
            rows.append(describe(text, kind, a, b))
            labels.append(label)

    def set_in(before: str, core: str, after: str, kind: str, label: int) -> None:
        text = before + core + after
        for k, a, b in candidates(text):
            if k == kind and a < len(before) + len(core) and b > len(before):
                return add(text, kind, a, b, label, "made")

    for text in texts:
        strict = strict_spans(text)
        for kind, a, b in strict:
            before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
            add(text, kind, a, b, 1, "own")
            for _ in range(4):
                set_in(before, _loosened(rng, kind, text[a:b]), after, kind, 1)
        for kind, a, b in candidates(text):
            if not any(x < b and y > a for _, x, y in strict):
                add(text, kind, a, b, 0, "own")
        # look-alikes of all kinds at a place of the text
        at = int(rng.integers(0, len(text) + 1))
        for kind in ALL_KINDS:
            set_in(text[max(0, at - CONTEXT) : at] + " ", _harmless(rng, kind), " " + text[at : at + CONTEXT], kind, 0)
    return np.array(rows, float).reshape(len(rows), N_FEATURES), np.array(labels, float)


def train(texts: list[str]) -> Model:
    """Fit on three of four documents; the candidates of the fourth calibrate scores and set the thresholds."""
    x, y = training_candidates([t for i, t in enumerate(texts) if i % 4 != 3])
    held, target = training_candidates([t for i, t in enumerate(texts) if i % 4 == 3], seed=6)
    nothing = Model(Trees([], [], 0.0), 1.0, 0.0, dict.fromkeys(ALL_KINDS, float("inf")), {})
    if not 0 < y.sum() < len(y) or not len(held):
        return nothing  # nothing to tell apart
    trees = boost(x, y)
    margin = trees.margin(held)
    slope, offset = 1.0, 0.0
    soft = np.where(target == 1, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
    for _ in range(200):  # Platt's calibration, by gradient descent
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        slope -= 0.2 * np.mean((p - soft) * margin)
        offset -= 0.2 * np.mean(p - soft)
    model = Model(trees, slope, offset, {}, {})
    score, kinds = model.score(held), held[:, 0]
    for k, kind in enumerate(ALL_KINDS):
        own = kinds == k
        by = np.argsort(-score[own], kind="stable")
        s, t = score[own][by], target[own][by]
        precise = np.cumsum(t) / np.arange(1, len(t) + 1)
        last = np.append(s[1:] != s[:-1], True)[: len(s)]  # a threshold takes all of the same score
        good = np.flatnonzero((precise >= PRECISION) & last & (t > 0))
        model.thresholds[kind] = float(s[good[-1]]) if len(good) else float("inf")
        chosen = s >= model.thresholds[kind]
        model.report[kind] = {"positives": int(t.sum()), "negatives": int((1 - t).sum()), "recall": float(t[chosen].sum() / max(t.sum(), 1)), "precision": float(t[chosen].mean()) if chosen.any() else 1.0}
    return model


def sample_texts(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> list[str]:
    """Texts of at most ``max_docs`` documents of at most ``TRAIN_BYTES`` bytes: those with the least hash of id and text."""
    rows = docs.where(F.octet_length("text").between(1, TRAIN_BYTES)).select("text", F.xxhash64("doc_id", "text").alias("draw"))
    return [r["text"] for r in least_hashed(rows, max_docs)]


# --- the operator ------------------------------------------------------------------------------


class _Taken:
    """Spans that don't overlap, in order of place."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, reach = [], [], -1
        for a, b in sorted(spans):  # spans of different kinds may overlap: their union counts
            if a <= reach:
                self.ends[-1] = reach = max(reach, b)
            else:
                self.starts.append(a)
                self.ends.append(b)
                reach = b

    def hold(self, a: int, b: int) -> bool:
        """Whether a span overlaps [a, b)."""
        i = bisect.bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """Base spans, and all kept spans, of each text."""
    base = [base_spans(t) for t in texts]
    taken = [_Taken([(a, b) for _, a, b in spans]) for spans in base]
    rows, owners = [], []
    for i, text in enumerate(texts):
        for kind, a, b in candidates(text):
            if not taken[i].hold(a, b):
                rows.append(describe(text, kind, a, b))
                owners.append((i, kind, a, b))
    kept = [list(b) for b in base]
    if rows and model.trees.cuts:
        score = model.score(np.array(rows, float))
        for k in np.argsort(-score, kind="stable"):
            i, kind, a, b = owners[k]
            if score[k] >= model.thresholds[kind] and not taken[i].hold(a, b):
                kept[i].append((kind, a, b))
                taken[i].add(a, b)
    return [(b, sorted(k, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2]))) for b, k in zip(base, kept)]


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, and the base and all spans of each row as arrays of (kind, start, end)."""
    model = train(sample_texts(docs)) if model is None else model
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                found = find([t or "" for t in batch.column(1).slice(a, 500).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array([as_rows(f[0]) for f in found], span), pa.array([as_rows(f[1]) for f in found], span)], schema=arrow)

    kind = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def pii_query(docs: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return detect(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """Counts and digest of the base rules by the plain patterns, for tests."""
    text = text or ""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(_digits(s)) <= 19 and luhn(_digits(s)),
        "phone": lambda s: 9 <= len(_digits(s)) <= 15,
    }
    spans = [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(plain[k], text) if good[k](m.group())]
    n = {k: sum(s[0] == k for s in spans) for k in KINDS}
    return (*[n[k] for k in KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
