"""Queries of table statistics, dataset preparation, formats and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import strip_signs
from tabloom.operators import evaluation as ev
from tabloom.operators import prep
from tabloom.operators import ranking as rk
from tabloom.operators.order import quantiles
from tabloom.plans.standin import SCORED, features, read
from tabloom.sources import tables

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def eda_columns(spark, sf_dir) -> DataFrame:
    n, docs = F.col("n_chars"), read(spark, sf_dir, "documents")
    sums = docs.groupBy("lang").agg(F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"))
    middle = quantiles(docs, ["lang"], "n_chars", [0.5]).select("lang", F.round("quantile", 6).alias("median"))
    return sums.join(middle, "lang").select("lang", "n", "mean", "median", "std", "least", "most")


@query("SELECT lang, round(p, 1) AS p, round(v, 6) AS v FROM (SELECT lang, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS p, unnest(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM documents GROUP BY lang)".replace("round(p, 1) AS p", "CAST(round(p, 1) AS DOUBLE) AS p"))
def eda_percentiles(spark, sf_dir) -> DataFrame:
    rows = quantiles(read(spark, sf_dir, "documents"), ["lang"], "n_chars", [k / 10 for k in range(1, 11)])
    return rows.select("lang", F.col("share").alias("p"), F.round("quantile", 6).alias("v"))


@query("SELECT event_type, count(*) AS n, count(v) AS n_filled, count(*) - count(v) AS n_missing, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY event_type")
def eda_nulls(spark, sf_dir) -> DataFrame:
    v = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    rows = read(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_filled"), ev.count_if(F.col("v").isNull()).alias("n_missing"), F.round(F.avg(F.col("v").isNull().cast("int")), 6).alias("share"))


_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@query(f"SELECT lang, sum(len({_WORDS}))::BIGINT AS n_words, max(len({_WORDS})) AS most FROM documents GROUP BY lang")
def eda_words(spark, sf_dir) -> DataFrame:
    n = F.size(F.array_remove(F.split("text", r"[ \t\n\x0b\f\r]+"), "")).cast("long")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("n_words"), F.max(n).alias("most"))


_TOKEN = f"SELECT doc_id, lang, regexp_replace(w, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g') AS token FROM (SELECT doc_id, lang, unnest({_WORDS}) AS w FROM documents)"


def _tokens(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array_remove(F.split("text", r"[ \t\n\x0b\f\r]+"), "")).alias("w"))
    return rows.select("doc_id", "lang", strip_signs(F.col("w")).alias("token")).where((F.length("token") >= 2) & ~F.col("token").rlike(r"^\p{N}+$"))


@query(f"SELECT token, count(*) AS n FROM ({_TOKEN}) WHERE length(token) >= 2 AND NOT regexp_full_match(token, '\\p{{N}}+') GROUP BY token ORDER BY n DESC, token LIMIT 50")
def eda_tokens(spark, sf_dir) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(f"WITH t AS (SELECT * FROM ({_TOKEN}) WHERE length(token) >= 2 AND NOT regexp_full_match(token, '\\p{{N}}+')), top AS (SELECT token, count(*) AS n FROM t WHERE lang = 'en' GROUP BY 1 ORDER BY n DESC, token LIMIT 20) SELECT top.token, round(coalesce(x.n, 0) / CAST((SELECT count(*) FROM t WHERE lang <> 'en') AS DOUBLE), 6) AS share FROM top LEFT JOIN (SELECT token, count(*) AS n FROM t WHERE lang <> 'en' GROUP BY 1) x ON x.token = top.token")
def token_compare(spark, sf_dir) -> DataFrame:
    t = _tokens(spark, sf_dir)
    counts = t.groupBy("token").agg(ev.count_if(F.col("lang") == "en").alias("n_en"), ev.count_if(F.col("lang") != "en").alias("n"))
    total = t.agg(ev.count_if(F.col("lang") != "en").alias("total"))
    top = counts.where("n_en > 0").orderBy(F.desc("n_en"), "token").limit(20)
    return top.crossJoin(F.broadcast(total)).select("token", F.round(ev.ratio(F.col("n"), F.col("total")), 6).alias("share"))


@query("SELECT 'quality' AS task, count(DISTINCT quality) AS n_labels, count(*) AS n FROM labels UNION ALL SELECT 'type', count(DISTINCT p_type), count(*) FROM part UNION ALL SELECT 'brand', count(DISTINCT p_brand), count(*) FROM part")
def gold_uniques(spark, sf_dir) -> DataFrame:
    one = lambda name, t, c: read(spark, sf_dir, t).agg(F.lit(name).alias("task"), F.count_distinct(c).alias("n_labels"), F.count(F.lit(1)).alias("n"))
    return one("quality", "labels", "quality").union(one("type", "part", "p_type")).union(one("brand", "part", "p_brand"))


_H = "(o_orderkey * 48271 + 11) % 2147483647"


@query(f"""WITH n AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, {_H} AS h FROM orders),
s AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS k FROM n WHERE n <= 3) WHERE k <= 250),
r AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 48271 + 12) % 2147483647, o_orderkey) AS k FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)) WHERE k <= 250)
SELECT o_orderkey AS tab_id, 'small' AS part FROM s UNION ALL SELECT o_orderkey, 'random' FROM r""")
def small_subset(spark, sf_dir) -> DataFrame:
    return prep.small_and_random(_sizes(spark, sf_dir), n_small=250, most=3, n_random=250, seed=11).select("tab_id", "part")


def _sizes(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tab_id")).agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tab_id")).join(n, "tab_id", "left").fillna(0, ["n"])


@query("SELECT tab_id, n FROM (SELECT *, row_number() OVER (ORDER BY has DESC, n, tab_id) AS k FROM (SELECT l_orderkey AS tab_id, count(*) AS n, CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 1 ELSE 0 END AS has FROM lineitem GROUP BY 1)) WHERE k <= 5")
def smoke_pick(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tab_id")).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("l_returnflag") == 3).alias("has"))
    return rows.orderBy(F.desc("has"), "n", "tab_id").limit(5).select("tab_id", "n")


@query(
    "WITH k AS (SELECT l_orderkey AS tab_id, 1 AS kind FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 2 FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT o_orderkey, 4 FROM orders WHERE o_orderpriority < '3'), "
    "t AS (SELECT tab_id, count(CASE WHEN kind = 1 THEN 1 END) AS n, bit_or(kind) = 7 AS complete FROM k WHERE tab_id % 3 > 0 GROUP BY 1) SELECT tab_id, n, complete FROM t WHERE n > 0 ORDER BY complete DESC, n, tab_id LIMIT 5"
)
def smoke_tables(spark, sf_dir) -> DataFrame:
    lines, orders = (read(spark, sf_dir, t).withColumnRenamed(c, "tab_id") for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")))
    return prep.smoke_tables(lines, lines.where("l_returnflag = 'A'"), orders.where("o_orderpriority < '3'"), 5, lines.where("tab_id % 3 > 0"))


@query(f"SELECT o_orderkey AS tab_id, CASE WHEN row_number() OVER (ORDER BY {_H}, o_orderkey) <= greatest(1, CAST(floor((SELECT count(*) FROM orders) * 0.1) AS BIGINT)) THEN 'valid' ELSE 'train' END AS split FROM orders")
def train_valid_split(spark, sf_dir) -> DataFrame:
    return prep.split_tables(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tab_id")), ratio=0.1, seed=11)


@query("WITH x AS (SELECT event_id, event_type = 'error' AS is_nil, (event_id * 48271 + 11) % 2147483647 AS h FROM events), cap AS (SELECT CAST(floor(count(CASE WHEN NOT is_nil THEN 1 END) * 0.1 / 0.9 + 1e-9) AS BIGINT) AS cap FROM x) SELECT event_id, is_nil FROM (SELECT *, row_number() OVER (PARTITION BY is_nil ORDER BY h, event_id) AS k FROM x), cap WHERE NOT is_nil OR k <= cap")
def nil_cap(spark, sf_dir) -> DataFrame:
    return prep.cap_nil(read(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("is_nil")), "event_id", share=0.1, seed=11)


def _example_sql(builder: str, first: str, margin: float, topk: int) -> str:
    return f"""SELECT '{builder}' AS builder, CASE WHEN {first} WHEN NOT coalesce(gap < {margin}, false) THEN 'not_gated' WHEN NOT coalesce(g{topk}, false) THEN 'gold_absent' WHEN d{topk} < 2 THEN 'trivial' ELSE 'kept' END AS status FROM cell LEFT JOIN x USING (tab_id, row_id)"""


@query(SCORED + f""", x AS (SELECT tab_id, row_id, count(*) AS n, bool_or(qid = gold AND rank <= 5) AS g5, bool_or(qid = gold AND rank <= 10) AS g10, max(CASE WHEN rank = 1 THEN gap END) AS gap,
  count(DISTINCT CASE WHEN rank <= 5 THEN qid END) AS d5, count(DISTINCT CASE WHEN rank <= 10 THEN qid END) AS d10 FROM ranked GROUP BY 1, 2),
st AS ({_example_sql("limited", "coalesce(x.n, 0) <= 1 THEN 'not_ambiguous'", 0.05, 5)} UNION ALL {_example_sql("context", "x.n IS NULL THEN 'no_candidates'", 0.1, 10)})
SELECT builder, status, count(*) AS n FROM st GROUP BY 1, 2""")
def example_status(spark, sf_dir) -> DataFrame:
    both = [F.struct(F.lit(b).alias("builder"), prep.example_status_of_cells(b, margin, topk).alias("status")) for b, margin, topk in (("limited", 0.05, 5), ("context", 0.10, 10))]
    rows = rk.ranked_cells(features(spark, sf_dir)).select(F.inline(F.array(*both)))
    return rows.groupBy("builder", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'k' AS pid, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
def json_explode(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("pid", "v"))


@query("WITH r AS (SELECT user_id AS tab_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_id, event_type AS v FROM events), n AS (SELECT tab_id, count(*) AS n FROM r GROUP BY 1), w AS (SELECT r.tab_id, r.row_id, CASE WHEN n <= 20 THEN 0 ELSE greatest(0, row_id - 10) END AS lo FROM r JOIN n USING (tab_id)) SELECT w.tab_id, w.row_id, count(*) AS n_rows, min(r.row_id) AS first_row, string_agg(r.v, '|' ORDER BY r.row_id) AS context FROM w JOIN r ON r.tab_id = w.tab_id AND r.row_id >= lo AND r.row_id < lo + 20 GROUP BY 1, 2")
def table_window(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("tab_id"), (F.row_number().over(w) - 1).cast("long").alias("row_id"), F.col("event_type").alias("text"))
    return prep.table_windows(rows, most=20)


@query("SELECT p, count(*) AS n FROM (SELECT unnest(list_filter(['the', 'de', 'und'], lambda p: contains(line, p))) AS p FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY p")
def triples_filter(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return tables.filter_triples(lines, ["the", "de", "und"]).groupBy(F.col("predicate").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, count(CASE WHEN s = 'train' THEN 1 END) AS train, count(CASE WHEN s = 'valid' THEN 1 END) AS valid, count(*) AS total FROM (SELECT r_name, CASE WHEN n_nationkey % 4 = 0 THEN 'valid' ELSE 'train' END AS s FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY r_name")
def pivot_examples(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = n.withColumn("s", F.when(F.col("n_nationkey") % 4 == 0, "valid").otherwise("train"))
    return s.groupBy("r_name").pivot("s", ["train", "valid"]).agg(F.count(F.lit(1))).fillna(0).withColumn("total", F.col("train") + F.col("valid"))


@query("SELECT s_suppkey, c, 0 AS sub, c AS obj FROM (SELECT s_suppkey, unnest([0, CAST(s_suppkey % 3 AS INTEGER)]) AS c FROM supplier)")
def metadata_codec(spark, sf_dir) -> DataFrame:
    c = F.array(F.lit(0), (F.col("s_suppkey") % 3).cast("int"))
    header = tables.metadata_header(c, F.transform(c, lambda x: F.array(F.lit(0), x)))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", header.alias("h")).select("s_suppkey", *tables.parse_metadata(F.col("h")))
    return rows.select("s_suppkey", F.explode(F.arrays_zip("cta", "cpa")).alias("z")).select("s_suppkey", F.col("z.cta").alias("c"), F.col("z.cpa")[0].alias("sub"), F.col("z.cpa")[1].alias("obj"))


@query("SELECT user_id, event_id, round(value - coalesce(lag(value) OVER w, 0), 6) AS delta, CAST(count(*) OVER w AS BIGINT) AS calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def cost_totals(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), 6).alias("delta"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("calls"))


_AFTER = "(({0}) * 48271 + 11) % 2147483647"
#: The walk of prep.noise() by recursion, an edit at a time.
_NOISE = f"""WITH RECURSIVE s AS (SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) || ' ' || p_size AS name, (p_partkey * 48271 + 7) % 2147483647 AS x0 FROM part),
t AS (SELECT *, string_split(name, '') AS chars, x0 % 4 AS kind FROM s),
u AS (SELECT *, list_filter(range(0, len(chars)), lambda p: regexp_matches(chars[p + 1], '^\\p{{L}}$')) AS places FROM t),
v AS (SELECT *, CASE WHEN kind = 2 THEN len(chars) ELSE len(places) END AS n FROM u),
w AS (SELECT *, CASE WHEN kind = 0 THEN 0 ELSE least(1 + ({_AFTER.format('x0')}) % greatest(n // 4, 1), CASE WHEN kind = 1 THEN n - 1 ELSE n END) END AS edits FROM v),
walk AS (
  SELECT p_partkey, kind, edits, 0::BIGINT AS done, {_AFTER.format(_AFTER.format('x0'))} AS x, chars, places FROM w
  UNION ALL
  SELECT p_partkey, kind, edits, done + 1, {_AFTER.format(_AFTER.format('x'))},
    CASE WHEN kind = 2 THEN list_concat(list_concat(chars[1:x % (len(chars) + 1)], [chr(CAST(97 + ({_AFTER.format('x')}) % 26 AS INTEGER))]), chars[x % (len(chars) + 1) + 1:])
    ELSE list_transform(chars, lambda c, p: CASE WHEN p - 1 <> places[x % len(places) + 1] THEN c WHEN kind = 1 THEN '' WHEN c <> lower(c) THEN upper(chr(CAST(97 + ({_AFTER.format('x')}) % 26 AS INTEGER))) ELSE chr(CAST(97 + ({_AFTER.format('x')}) % 26 AS INTEGER)) END) END,
    CASE WHEN kind = 2 THEN places ELSE list_filter(places, lambda p: p <> places[x % len(places) + 1]) END
  FROM walk WHERE done < edits)
SELECT p_partkey, array_to_string(chars, '') AS noisy, ['clean', 'delete', 'insert', 'substitute'][kind + 1] AS kind FROM walk WHERE done = greatest(edits, 0)"""


@query(_NOISE)
def noise_synth(spark, sf_dir) -> DataFrame:
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000), F.lit(" "), "p_size")
    rows = read(spark, sf_dir, "part").select("p_partkey", prep.noise(name, F.col("p_partkey"), seed=7).alias("n"))
    return rows.select("p_partkey", F.col("n.text").alias("noisy"), "n.kind")


@query("SELECT doc_id, quality, toxic, 'submission' AS kind, concat('http://www.wikidata.org/entity/Q', doc_id) AS entity FROM labels WHERE quality IS NOT NULL")
def submission_rows(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality", "toxic", F.lit("submission").alias("kind"), F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("entity"))
    return tables.submission(rows, "cea", value="entity")
