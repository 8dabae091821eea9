"""What each filter of a chain removes in every order of the chain, by a recursive CTE.

1. Each row gets a mask: one bit per filter that it fails, judged on its own text; the last bit says
   that a smaller doc_id has the same text.  Rows become counts of mask cells: per part and mask, the
   rows and how many of them are labelled good and toxic.
2. A recursive CTE starts with the empty prefix of each mask and extends prefixes by letters not used
   yet, carrying the bits applied before.  Each level says what its step does with the mask: keeps it,
   removes it, finds it gone already.  It holds (orders' prefixes) x (masks) rows, whatever the data.
3. Its rows meet the mask cells of the parts by mask, and sums give the metrics of each part and prefix;
   a full order's steps are its prefixes.

Shuffles: a row of about a hundred bytes per document (written once) by text hash and by doc_id; no
text is shuffled.  Both joins have one row a key on the right, so Spark splits the partition of a hot
text or id, or broadcasts a small right side.

Defined results: a null text is empty (and so equal to other empty texts); a null source is the part
"" together with empty ones; rows with a null doc_id come after all others and have no label; rows that
repeat a doc_id are rows each, and equal texts of one doc_id don't make each other fail the last
filter; a doc_id with several labels is good (toxic) if one of them says so; an empty table gives an
empty result; other columns are ignored.  Texts are equal if their SHA-256 is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
LAST_ID = 2**63 - 1


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that a text decides alone, by letter."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * CAPITAL_PERCENT,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters=text_filters) -> tuple[DataFrame, str]:
    """doc_id, part and mask of each row, and the letters of the mask's bits; the last one is for repeated texts."""
    text = F.coalesce("text", F.lit(""))
    # the text's own conditions as one column, so each is worked out once
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"), F.coalesce("source", F.lit("")).alias("part"), text.alias("body"))
    found = filters(F.col("body"))
    letters = "".join(found) + chr(ord("A") + len(found))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())), F.lit(0))
    rows = materialize(own.select("key", "part", bits.alias("bits"), F.sha2("body", 256).alias("digest")), "filter-bits")
    firsts = materialize(rows.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first"), "first-texts")
    again = F.when(F.col("key") > F.col("first"), 1 << len(found)).otherwise(0)
    return rows.join(firsts, "digest", "left").select("key", "part", F.col("bits").bitwiseOR(again).alias("mask")), letters


def mask_cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good rows and toxic rows of each part and mask."""
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    return masked.join(known.where("key <> " + str(LAST_ID)), "key", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def walk_sql(letters: str) -> str:
    """The recursion over prefixes: each level's letter and bit, the bits applied before, and the mask."""
    listed = ", ".join(f"'{x}'" for x in letters)
    return f"""
    WITH RECURSIVE walk (prefix, step, letter, applied, bit, mask) AS (
      SELECT '', 0, '', 0, 0, mask FROM {{cells}} GROUP BY mask
      UNION ALL
      SELECT concat(w.prefix, l.letter), w.step + 1, l.letter, w.applied | w.bit, shiftleft(1, l.place), w.mask
      FROM walk w LATERAL VIEW posexplode(array({listed})) l AS place, letter
      WHERE ((w.applied | w.bit) & shiftleft(1, l.place)) = 0)
    SELECT *, (mask & (applied | bit)) = 0 AS kept, (mask & applied) = 0 AND (mask & bit) <> 0 AS removed,
           (mask & applied) <> 0 AND (mask & bit) <> 0 AS redundant, mask = bit AS only_here
    FROM walk WHERE step > 0"""


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Metrics of each part, order of the letters and step."""
    cells = materialize(cells, "mask-cells")
    walk = materialize(cells.sparkSession.sql(walk_sql(letters), cells=cells), "filter-orders")
    total = lambda n, flag: F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    steps = walk.join(cells, "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"), total("n", "only_here").alias("unique_fails"),
        total("n_good", "removed").alias("good_lost"), total("n_toxic", "removed").alias("toxic_lost"),
    )
    steps = materialize(steps, "filter-steps")
    # a prefix of k letters begins as many orders as the letters left can be arranged in
    begins = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * begins).alias("shapley"))
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    out = steps.join(places, ["prefix", "step"]).join(shares, ["part", "letter"])
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def filter_audit(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """All orders of ``filters`` and the filter of repeated texts, part by part."""
    masked, letters = masks(docs, filters)
    return audit(mask_cells(masked, labels), letters)


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id, {LAST_ID}) AS k, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(k) OVER (PARTITION BY t) AS k0 FROM d),
f AS (SELECT doc_id, part, len(ws) < {MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) AS b,
      100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITAL_PERCENT} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS e, k > k0 AS g FROM w),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * e::INT + 16 * g::INT AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE toxic) AS nt FROM m GROUP BY ALL),
o(p) AS (SELECT '' UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(p, x)),
s AS (SELECT p AS filter_order, i AS step, CAST(1 << (ascii(substr(p, i, 1)) - 65) AS INT) AS bit,
      list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(substr(p, j, 1)) - 65)))::INT AS before
      FROM (SELECT p, unnest(range(1, 6))::INT AS i FROM o WHERE length(p) = 5)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE (mask & (coalesce(before, 0) | bit)) = 0) AS kept, sum(n) FILTER (WHERE (mask & coalesce(before, 0)) = 0 AND (mask & bit) <> 0) AS removed,
      sum(n) FILTER (WHERE (mask & coalesce(before, 0)) <> 0 AND (mask & bit) <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
      sum(ng) FILTER (WHERE (mask & coalesce(before, 0)) = 0 AND (mask & bit) <> 0) AS good_lost, sum(nt) FILTER (WHERE (mask & coalesce(before, 0)) = 0 AND (mask & bit) <> 0) AS toxic_lost
      FROM s CROSS JOIN cells GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""
