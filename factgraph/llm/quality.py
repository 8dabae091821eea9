"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean column that is true for a text to reject.  The base rules and their counts
are computed for all rows.  The other rules run as one ``CASE``: a row leaves it at the first rule
that rejects it, so their order decides the cost.  ``plan_cascade`` estimates, on a
bounded sample, what each rule costs (the characters it reads) and how many rows it rejects of those
that the rules before it leave, and orders the rules by rejections per cost.  The order never
changes the verdict.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule on
length; repeated rows are judged alike; rows with a null doc_id are kept as rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sample that the order of rules is planned on.
SAMPLE_ROWS = 2000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Words up to which a place fits the packed form below; longer texts take a wider one.
PACKED_BITS = 20
SPACES = "[ \\t-\\r]+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to reject; ``work`` is what that costs a row, in characters that it reads."""

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column] = lambda: F.lit(1)


def _reads_text() -> Column:
    return F.length("text")


def _reads_words() -> Column:
    return F.col("word_chars")


def _hashes_words() -> Column:
    """Each word is read, hashed and looked up."""
    return F.col("word_chars") + 16 * F.col("n_words")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def default_rules() -> list[Rule]:
    """Rules past the base ones, over ``text``, ``words``, ``lines`` and the base counts.

    The bounds lie far outside what prose of any language does, so that only junk is rejected.
    """
    n = F.col("n_words")
    return [
        Rule("mean_word_length", lambda: (_share(F.col("word_chars"), n) > 25) | (_share(F.col("word_chars"), n) < 1.5)),
        Rule("symbol_share", lambda: F.col("n_symbols") > 0.5 * n),
        Rule("duplicate_lines", lambda: F.col("n_dup_lines") > 0.6 * F.size("lines")),
        Rule("few_letters", lambda: F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < 0.5 * F.col("word_chars"), _reads_text),
        Rule("capitals", lambda: F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) > 0.7 * F.col("word_chars"), _reads_text),
        Rule("long_word", lambda: F.array_max(F.transform("words", F.length)) > 1000, _reads_words),
        Rule("few_distinct_words", lambda: F.size(F.array_distinct("words")) < 0.05 * n, _hashes_words),
        Rule("control_characters", lambda: F.length(F.regexp_replace("text", r"[^\x00-\x08\x0E-\x1F\x7F�]+", "")) > 0.05 * F.col("word_chars"), _reads_text),
        Rule("braces", lambda: F.length(F.regexp_replace("text", r"[^{}\[\]\\=;]+", "")) > 0.3 * F.col("word_chars"), _reads_text),
    ]


def _equal_neighbours(windows: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
    """Places of neighbours in ``windows`` that are the same, in order.

    ``same`` is true, false, or null where only the exact way can tell, which gives the place -1.
    """
    rest = F.greatest(F.size(windows) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(windows, 1, rest), F.slice(windows, 2, rest), lambda a, b: F.when(F.coalesce(same(a, b), F.lit(True)), F.struct(a.alias("a"), b.alias("b"))))
    hits = F.transform(F.filter(pairs, lambda p: p.isNotNull()), lambda p: F.when(same(p["a"], p["b"]), F.array(place(p["a"]), place(p["b"]))).otherwise(F.array(F.lit(-1))))
    return F.sort_array(F.array_distinct(F.flatten(hits)))


def _window(at: Column) -> list[Column]:
    """The three words at a place.  Items are read one by one: ``slice`` in a lambda would copy all words each time."""
    return [F.col("words")[at + k] for k in range(3)]


def _same_words(a: Column, b: Column) -> Column:
    """True if the windows at two places have the same words, else null."""
    one, two, three = (x == y for x, y in zip(_window(a), _window(b)))
    return F.when(one & two & three, F.lit(True))


def _repeat_starts_packed() -> Column:
    """Starts of 3-word windows found twice or more, from one sorted array of longs.

    A long holds 44 bits of a window's hash and its 20-bit place.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << PACKED_BITS) - 1)).cast("int")
    return _equal_neighbours(F.col("packed"), lambda a, b: F.when(F.shiftright(a, PACKED_BITS) != F.shiftright(b, PACKED_BITS), F.lit(False)).otherwise(_same_words(place(a), place(b))), place)


def _repeat_starts_wide() -> Column:
    """The same for a longer text, from a sorted array of whole hashes and places."""
    return _equal_neighbours(F.col("wide"), lambda a, b: F.when(a["h"] != b["h"], F.lit(False)).otherwise(_same_words(a["i"], b["i"])), lambda x: x["i"])


def _repeat_starts_exact() -> Column:
    """The same by sorting the windows themselves: for texts in which windows of other words have equal hashes."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.struct(*[w.alias(f"w{k}") for k, w in enumerate(_window(i))]).alias("w"), i.alias("i"))))
    return _equal_neighbours(windows, lambda a, b: a["w"] == b["w"], lambda x: x["i"])


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the base counts of each row.

    Steps stand in columns of their own, each used more than once after, so that Spark computes
    them once a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    df = df.withColumn("hashes", F.when(F.col("n_words") >= 3, hashes))
    n = F.size("hashes")
    # 3-word windows: the same array thrice, shifted
    second = F.slice("hashes", 2, F.greatest(n - 1, F.lit(0)))
    third = F.slice("hashes", 3, F.greatest(n - 2, F.lit(0)))
    joined = F.zip_with(F.zip_with("hashes", second, lambda a, b: F.xxhash64(a, b)), third, lambda h, c: F.xxhash64(h, c))
    df = df.withColumn("windows", F.slice(joined, 1, F.greatest(n - 2, F.lit(0))))
    packed = F.transform("windows", lambda h, i: F.shiftleft(h.bitwiseXOR(F.shiftrightunsigned(h, 31)), PACKED_BITS).bitwiseOR(i.cast("long")))
    wide = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    is_short = F.col("n_words") < 1 << PACKED_BITS
    df = df.withColumn("packed", F.when(is_short, F.sort_array(packed))).withColumn("wide", F.when(~is_short, F.sort_array(wide)))
    df = df.withColumn("starts", F.when(is_short, _repeat_starts_packed()).otherwise(_repeat_starts_wide()))
    df = df.withColumn(
        "starts",
        F.when(F.col("n_words") < 3, F.array().cast("array<int>")).when(F.array_contains("starts", -1), _repeat_starts_exact()).otherwise(F.col("starts")),
    )
    # three words from each start, but no further than the next start
    last = F.size("starts")
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(last - 1, F.lit(0))), lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
    return df.select(
        "doc_id",
        "text",
        "words",
        "lines",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def plan_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Each rule with its work and rejections on a sample, in the order to run them.

    The sample is the ``sample_rows`` different rows with the least hash of the whole table.  One job counts
    the rows and the work of all rules for each set of rules that reject a row.  Then, step by step,
    the rule comes next that rejects the most of the rows which are left, for the work that it does
    on them (ties by name).
    """
    rules = sorted(default_rules() if rules is None else rules, key=lambda r: r.name)
    draw = F.xxhash64("doc_id", "text")
    # hashes alone are sorted; texts are only read again for those drawn, and rows that repeat count once
    least = [r[0] for r in docs.select(draw.alias("draw")).distinct().orderBy("draw").limit(sample_rows).collect()]
    drawn = docs.where(draw <= least[-1] if least else F.lit(False)).groupBy(draw.alias("draw")).agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.*")
    verdicts = [F.coalesce(r.rejects(), F.lit(False)).alias(f"v{i}") for i, r in enumerate(rules)]
    works = [r.work().cast("double").alias(f"w{i}") for i, r in enumerate(rules)]
    # the base verdict is a key and no filter, which Spark would push below the steps and so compute them again
    judged = with_base(drawn).select(base_failed().alias("base_failed"), *verdicts, *works)
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(rules))]
    # at most a row for each row of the sample
    left = judged.groupBy("base_failed", *[f"v{i}" for i in range(len(rules))]).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    left = [r for r in left if not r["base_failed"]]
    open_, plan = list(range(len(rules))), []
    while open_:
        n = sum(r["n"] for r in left)
        found = {i: (sum(r["n"] for r in left if r[f"v{i}"]), sum(r[f"w{i}"] for r in left)) for i in open_}
        # a rule that rejects nothing in the sample may still do so; the cheaper one comes first
        rank = {i: (rejected + 1) / (n + 2) / max(work / max(n, 1), 1.0) for i, (rejected, work) in found.items()}
        best = max(open_, key=lambda i: (rank[i], -i))
        plan.append({"rule": rules[best], "work": found[best][1], "rejected": found[best][0], "rows": n, "rank": rank[best]})
        open_.remove(best)
        left = [r for r in left if not r[f"v{best}"]]
    return plan


def quality(docs: DataFrame, rules: list[Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """doc_id, text, the base counts, base_failed, failed_rule (of the cascade) and kept.

    ``order`` names the rules in the order to run and skips the planning.
    """
    rules = default_rules() if rules is None else rules
    if order is None:
        ranked = [p["rule"] for p in plan_cascade(docs, rules)]
    else:
        by_name = {r.name: r for r in rules}
        ranked = [by_name[name] for name in order]
    df = with_base(docs).withColumn("base_failed", base_failed())
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ranked:
        cascade = cascade.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name))
    df = df.withColumn("failed_rule", cascade)
    return df.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def quality_query(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The query in DuckDB.
_W = "[^ \\x09-\\x0D]+"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_W}')] AS lines FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, words, lines, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars > 25 * greatest(n_words, 1) OR word_chars < 1.5 * greatest(n_words, 1)
            OR n_symbols > 0.5 * n_words
            OR n_dup_lines > 0.6 * len(lines)
            OR length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) < 0.5 * word_chars
            OR length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) > 0.7 * word_chars
            OR coalesce(list_max([length(x) FOR x IN words]), 0) > 1000
            OR len(list_distinct(words)) < 0.05 * n_words
            OR length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F\\x7F\\x{{FFFD}}]+', '', 'g')) > 0.05 * word_chars
            OR length(regexp_replace(text, '[^{{}}\\[\\]\\\\=;]+', '', 'g')) > 0.3 * word_chars) AS kept
FROM b
"""
