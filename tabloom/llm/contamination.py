"""Decontamination against benchmark items, in DataFrame operations only.

A window is ten consecutive words of an item, or all words of a shorter one. Any window in a document covers a gram of
just over half its length that starts at a multiple of a stride, so the first pass looks up only those grams of a
document, hashed, in the hash set of all grams of the items; the set is broadcast if it is small. Documents with a gram
are then read word by word, and their windows are compared as strings.

A text is known by two 64-bit hashes, so equal texts are searched once. Null texts have no words, like those without
letters or digits. Items without words have no window; repeated items count by their item_id. Without documents or items
the result has no rows or no hits. Other columns are ignored by hits() and kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, lower_ascii, small, table, unpacked, with_marks, without

WINDOW = 10
#: Documents with more than this share of their words in windows are left out, from others these words are.
MOST_HIT = 0.5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")


def text_key(text: Column) -> list[Column]:
    """128 bits for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _gram(n: int) -> tuple[int, int]:
    """The length of the grams, and the stride of their starts, for windows of n words."""
    return n // 2 + 1, n - n // 2


def _grams(ws: Column, n: int, stride: int) -> Column:
    length = _gram(n)[0]
    starts = F.when(F.size(ws) >= length, F.sequence(F.lit(1), F.size(ws) - (length - 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.xxhash64(F.lit(n), F.slice(ws, k, length)))


def _windows(ws: Column, n: int) -> Column:
    """Structs of place (from 0), n and the window's words."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct((k - 1).alias("place"), F.lit(n).alias("n"), F.array_join(F.slice(ws, k, n), " ").alias("window")))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, window, ws) with a row for each window of an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where("size(ws) > 0").withColumn("n", F.least(F.size("ws"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1)
    each = items.select("item_id", "n", F.explode(F.transform(starts, lambda k: F.slice("ws", k, F.col("n")))).alias("ws"))
    return each.select("item_id", "n", F.array_join("ws", " ").alias("window"), "ws")


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (doc_id, h1, h2, n_words); their hits (h1, h2, place, n, window), a row for each place; the items' windows."""
    items = cut(item_windows(benchmark, window))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most `window`
    grams = items.select(F.explode(F.flatten(F.array(*[F.when(F.col("n") == n, _grams(F.col("ws"), n, 1)).otherwise(F.array().cast("array<bigint>")) for n in lengths] or [F.array().cast("array<bigint>")]))).alias("gram")).distinct()
    grams = cut(grams)
    ws = docs.select("doc_id", *text_key(F.col("text")), words(F.col("text")).alias("ws"))
    probes = F.flatten(F.array(*[_grams(F.col("ws"), n, _gram(n)[1]) for n in lengths])) if lengths else F.array().cast("array<bigint>")
    rows = cut(ws.select("doc_id", "h1", "h2", F.size("ws").cast("long").alias("n_words"), probes.alias("probes")))
    every = rows.drop("probes")
    candidates = rows.select("doc_id", "h1", "h2", F.explode("probes").alias("gram")).join(small(grams), "gram", "left_semi")
    candidates = cut(candidates.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    # the text of one document of each
    one = (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    texts = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(text_key(F.col("text")), ("c1", "c2"), strict=True)]).join(small(candidates), one).select("h1", "h2", words(F.col("text")).alias("ws"))
    each = texts.select("h1", "h2", F.explode(F.concat(*[_windows(F.col("ws"), n) for n in lengths]) if lengths else F.expr("cast(array() as array<struct<place:int,n:int,window:string>>)")).alias("w")).select("h1", "h2", "w.*")
    known = items.select("n", "window").distinct()
    return every, cut(each.join(small(known), ["n", "window"], "left_semi").distinct()), items.select("item_id", "n", "window").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h1, h2, n_words, n_hit, n_items, items_sha256) of every document."""
    every, found, items = _found(docs, benchmark, window)
    places = found.select("h1", "h2", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place")).distinct()
    n_hit = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_hit"))
    which = found.select("h1", "h2", "n", "window").distinct().join(small(items), ["n", "window"]).select("h1", "h2", F.col("item_id").cast("string").alias("item_id")).distinct()
    which = which.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    of = cut(n_hit.join(which, ["h1", "h2"]))
    zero = F.lit(0).cast("long")
    return every.join(small(of), ["h1", "h2"], "left").select("doc_id", "h1", "h2", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hit: float = MOST_HIT) -> DataFrame:
    """docs, all columns, without words in windows and what stands before each; without the documents that mostly are such words. n_chars, if there, follows."""
    every, found, _ = _found(docs, benchmark, window)
    places = found.select("h1", "h2", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place")).distinct()
    # the places in a text are at most its words
    marks = places.groupBy("h1", "h2").agg(F.collect_list("place").alias("__places")).select(F.col("h1").alias("__1"), F.col("h2").alias("__2"), "__places")
    rows = with_marks(docs, text_key(F.col("text")), marks, ["__1", "__2"], "__places")
    # what stands before each word, and the word (null behind the last)
    pairs = F.arrays_zip(F.split("text", WORD, -1).alias("before"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))
    text = F.array_join(F.transform(without(pairs, F.col("__places")), lambda p: F.concat(p["before"], F.coalesce(p["word"], F.lit("")))), "")
    few = F.size("__places") <= most_hit * F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.where(F.when(F.col("__places").isNull(), True).otherwise(few)).withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(text))
    return unpacked(rows, docs)


def query(spark, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_TEXT}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS w
  FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS k FROM item WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT d.doc_id, d.k, d.n, win.item_id
  FROM (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS w
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM doc, size WHERE len(ws) >= n)) d
  JOIN win ON win.n = d.n AND win.w = d.w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
