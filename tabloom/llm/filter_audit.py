"""What filters do together, from the joint failures of all their subsets.

For each part, the number of documents that fail all filters of a subset is a sum of products of their flags, found for
all 2^n subsets in one aggregate. Signed sums over subsets turn these numbers into what any order of the filters keeps,
removes and finds gone already, and into what fails one filter alone (Möbius inversion). The game whose value is the
number of documents that a set of filters removes has the dividends +-(joint failures of a subset); a filter's Shapley
value is the sum of the dividends of its subsets, each shared evenly among the subset's members.

Duplicates take no join with their copies: rows are summed up by text and doc_id, then each text's rows by part and
labels, and the least doc_id is found over what is left, four rows at most for each part of a text. So many copies of
one text are summed before they meet, and no task holds them.

A null text is an empty one, a null lang is the part ''. A row without doc_id has no smaller one and no label; rows that
share a doc_id and a text are not each other's copies. A doc_id that labels has more than once is good or toxic if any of
its rows says so. An empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("failed", "good", "toxic")


def rules(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many rows fail just the filters in mask; bit k is the k-th filter, the last one that of copies."""
    text = F.coalesce("text", F.lit(""))
    mask = reduce(lambda a, b: a + b, [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(rules(text).values())])
    last = 1 << len(rules(text))  # the bit of copies
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "hash", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    rows = rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    texts = rows.groupBy("hash", "part", "mask", "good", "toxic").agg(first, F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("hash")))
    kept = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - kept).alias("n")))
    each = texts.select("part", "good", "toxic", F.inline(both))
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def joint_failures(each: DataFrame, n_filters: int) -> DataFrame:
    """(part, failed, good, toxic): arrays of the number of rows, of good and of toxic ones, that fail all filters of a subset; item s is the subset with bits s."""

    def together(subset: int) -> Column:
        bits = [F.col("mask").bitwiseAND(1 << k).cast("boolean").cast("long") for k in range(n_filters) if subset >> k & 1]
        return reduce(lambda a, b: a * b, bits, F.col("n"))

    of = {"failed": F.lit(1), "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")}
    sums = {f"{c}_{s}": F.sum(together(s) * of[c]) for c in COUNTS for s in range(1 << n_filters)}
    wide = each.groupBy("part").agg(*[x.alias(c) for c, x in sums.items()])
    return wide.select("part", *[F.array(*[F.col(f"{c}_{s}") for s in range(1 << n_filters)]).alias(c) for c in COUNTS])


def _signed(of: str, n_filters: int, factor: Callable[[Column], Column], among: Callable[[Column], Column]) -> Column:
    """The sum of +-factor(s) times the joint failures of s over the sets s with among(s); plus for an even number of filters."""
    failed = F.col(of)

    def add(total: Column, s: Column) -> Column:
        sign = F.when(F.bit_count(s) % 2 == 0, F.lit(1)).otherwise(-1)
        return total + F.when(among(s), sign * factor(s) * F.get(failed, s)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)), F.lit(0).cast("long"), add)


def _has(s: Column, k: Column) -> Column:
    return F.call_function("getbit", s, k) == 1


def _each(n: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def survivors(of: str, n_filters: int) -> Column:
    """Array: the rows that fail none of the filters of each set, by inclusion and exclusion."""
    return _each(1 << n_filters, lambda p: _signed(of, n_filters, lambda s: F.lit(1), lambda s: s.bitwiseAND(p) == s))


def unique_failures(of: str, n_filters: int) -> Column:
    """Array: the rows that fail each filter and no other."""
    return _each(n_filters, lambda k: -_signed(of, n_filters, lambda s: F.lit(1), lambda s: _has(s, k)))


def shapley(of: str, n_filters: int) -> Column:
    """Array: what each filter removes, summed over all orders: the dividends of the sets it is in, each shared among the set's filters."""
    orders = F.lit(factorial(n_filters))
    return _each(n_filters, lambda k: -_signed(of, n_filters, lambda s: F.floor(orders / F.bit_count(s)), lambda s: _has(s, k)))


def audit(docs: DataFrame, labels: DataFrame, copies: str = "E") -> DataFrame:
    """A row for each part, order of the filters and step; see the module."""
    letters = "".join(rules(F.col("text"))) + copies
    n = len(letters)
    joint = joint_failures(flags(docs, labels), n)
    numbers = joint.select(
        "part",
        F.col("failed").alias("joint"),
        survivors("failed", n).alias("left"),
        survivors("good", n).alias("good_left"),
        survivors("toxic", n).alias("toxic_left"),
        unique_failures("failed", n).alias("alone"),
        shapley("failed", n).alias("value"),
    )
    steps = []
    for order in permutations(range(n)):
        done, name = 0, "".join(letters[k] for k in order)
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "k": k, "before": done, "after": done | 1 << k})
            done |= 1 << k
    kind = "array<struct<filter_order:string,step:int,k:int,before:int,after:int>>"
    rows = numbers.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))

    def lost(c: str) -> Column:
        return F.col(c)[F.col("before")] - F.col(c)[F.col("after")]

    own = F.col("joint")[F.col("after") - F.col("before")]
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.col("left")[F.col("after")].alias("kept"),
        lost("left").alias("removed"),
        (own - lost("left")).alias("redundant"),
        F.col("alone")[F.col("k")].alias("unique_fails"),
        lost("good_left").alias("good_lost"),
        lost("toxic_left").alias("toxic_lost"),
        F.col("value")[F.col("k")].alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each order is applied to the counts of documents by the set of filters that they fail.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM texts t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l ON t.doc_id = l.doc_id),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS done
  FROM orders, range(1, 6) r(s)),
rows AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & done <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & done = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows
"""
