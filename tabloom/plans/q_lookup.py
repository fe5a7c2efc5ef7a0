"""Queries of knowledge-base lookups, row context, and comparison of versions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import lookup
from tabloom.operators import ranking as rk
from tabloom.plans.q_eval import gold, hits
from tabloom.plans.standin import BASE, HITS, RUNS, candidates, found, read

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def _names(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(
    "WITH k AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), q AS (SELECT DISTINCT name AS term FROM k UNION SELECT DISTINCT string_split(name, ' ')[1] FROM k UNION SELECT ''), "
    "m AS (SELECT term, id, CAST(row_number() OVER (PARTITION BY term ORDER BY name <> term, id) AS INTEGER) AS rank FROM q JOIN k ON name = term OR starts_with(name, term || ' ') WHERE term <> '') SELECT term, id, rank FROM m WHERE rank <= 10"
)
def kb_search(spark, sf_dir) -> DataFrame:
    names = _names(spark, sf_dir)
    terms = names.select(F.lower("name").alias("term")).union(names.select(F.substring_index(F.lower("name"), " ", 1))).union(names.select(F.lit(""))).distinct()
    return lookup.search(terms, names, limit=10)


@query(
    "WITH w AS (SELECT p_partkey AS id, p_name AS name, unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))) AS word FROM part), q AS (SELECT DISTINCT name AS term, word FROM w), "
    "m AS (SELECT term, id, count(*) AS shared FROM q JOIN w USING (word) GROUP BY 1, 2) SELECT term, id, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY shared DESC, id) AS rank FROM m) WHERE rank <= 10"
)
def kb_full_text(spark, sf_dir) -> DataFrame:
    names = _names(spark, sf_dir)
    return lookup.search_rare_words(names.select(F.col("name").alias("term")), names, limit=10)


#: A part's name, its type, which many share, and a number that few share.
_LONG = "lower(p_name || ' ' || p_type || ' no' || p_partkey % 97)"


@query(
    f"WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(list_filter(string_split({_LONG}, ' '), lambda x: x <> ''))) AS word FROM part), t AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE {_LONG} END AS term FROM part WHERE p_partkey % 10 = 3 OR p_partkey % 3 = 0), q AS (SELECT term, unnest(list_distinct(string_split(term, ' '))) AS word FROM t), "
    "m AS (SELECT term, id, count(*) AS shared FROM q JOIN w USING (word) GROUP BY 1, 2) SELECT term, id, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY shared DESC, id) AS rank FROM m) WHERE rank <= 10"
)
def kb_rare_words(spark, sf_dir) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    long = F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit(" no"), k % 97))
    terms = part.where((k % 10 == 3) | (k % 3 == 0)).select(F.when(k % 3 == 0, F.lower("p_name")).otherwise(long).alias("term"))
    return lookup.search_rare_words(terms, part.select(k.alias("id"), long.alias("name")), limit=10, frequent=30)


@query("SELECT s_suppkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, ' (fr)') END, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CAST(s_nationkey AS VARCHAR)) AS label FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def kb_labels(spark, sf_dir) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    one = lambda n, language, label: nation.where(F.col("n_nationkey") % n == 0).select(F.col("n_nationkey").alias("id"), F.lit(language).alias("language"), label.alias("label"))
    labels = one(2, "fr", F.concat("n_name", F.lit(" (fr)"))).unionByName(one(3, "en", F.col("n_name"))).unionByName(one(1, "de", F.concat("n_name", F.lit(" (de)"))))
    return lookup.labelled(read(spark, sf_dir, "supplier"), labels, "s_nationkey", "fr").select("s_suppkey", "label")


@query("SELECT id FROM (SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier) WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def missing_ids(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return lookup.missing(s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id")), "id", read(spark, sf_dir, "lineitem").select("l_suppkey"), s.select("s_suppkey"))


@query("SELECT event_id, greatest(CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 200 AS DOUBLE) ELSE 0.0 END, least(greatest(10.0, pow(2.0, event_id % 9)), 120.0)) AS seconds FROM events")
def retry_wait(spark, sf_dir) -> DataFrame:
    asked = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 200)
    return read(spark, sf_dir, "events").select("event_id", lookup.retry_wait(F.col("event_id") % 9, asked).alias("seconds"))


@query("SELECT user_id, event_type, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen, event_type) AS rank FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2)) WHERE rank <= 30")
def column_values(spark, sf_dir) -> DataFrame:
    return lookup.first_values(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", limit=30)


@query("SELECT user_id, subject, object, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS subject, CASE WHEN event_id % 5 <> 0 THEN event_id END AS object FROM events) WHERE trim(subject) <> '' AND object IS NOT NULL) WHERE rank <= 15")
def column_pairs(spark, sf_dir) -> DataFrame:
    subject = F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", subject.alias("subject"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("object"))
    return lookup.first_pairs(rows, ["user_id"], "subject", "object", "event_id", limit=15)


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_brand END, p_type, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN p_name END], lambda x: x IS NOT NULL AND trim(x) <> '')[1:5], '|') AS context FROM part")
def row_context(spark, sf_dir) -> DataFrame:
    row = [F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(F.col("p_brand")), F.col("p_type"), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))]
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(lookup.row_context(row, 0), "|").alias("context"))


_VERSIONS = "v AS (SELECT p_partkey, p_brand, p_name, replace(p_name, 'e', '') AS base, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN NULL ELSE replace(p_name, 'r', '') END AS value FROM part)"


def _versions(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.col("p_name")).when(k % 5 != 0, F.replace("p_name", F.lit("r"), F.lit("")))
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.replace("p_name", F.lit("e"), F.lit("")).alias("base"), value.alias("value"))


_DISTANCES = f"WITH {_VERSIONS}, d AS (SELECT *, levenshtein(base, p_name) AS d_base, levenshtein(coalesce(value, ''), p_name) AS d_value FROM v)"


@query(f"{_DISTANCES} SELECT p_brand, count(*) AS n, round(avg(d_base), 6) AS mean_base, round(avg(d_value), 6) AS mean_value, count(CASE WHEN d_value < d_base THEN 1 END) AS n_improved, count(CASE WHEN d_value > d_base THEN 1 END) AS n_worsened FROM d GROUP BY 1")
def label_distance(spark, sf_dir) -> DataFrame:
    return lookup.distance_summary(lookup.distances(_versions(spark, sf_dir), "p_name", "base", "value"), "p_brand")


@query(f"{_DISTANCES} SELECT p_partkey, CAST(d_value - d_base AS INTEGER) AS moved FROM d ORDER BY moved DESC, p_partkey LIMIT 20")
def worst_moved(spark, sf_dir) -> DataFrame:
    rows = lookup.distances(_versions(spark, sf_dir), "p_name", "base", "value")
    return rows.select("p_partkey", (F.col("d_value") - F.col("d_base")).alias("moved")).orderBy(F.desc("moved"), "p_partkey").limit(20)


@query(
    f"WITH {_VERSIONS}, p AS (SELECT 'base' AS version, 'p_name' AS other, base IS DISTINCT FROM p_name AS c FROM v UNION ALL SELECT 'value', 'p_name', value IS DISTINCT FROM p_name FROM v UNION ALL SELECT 'value', 'base', value IS DISTINCT FROM base FROM v) "
    "SELECT version, other, count(*) AS n, count(CASE WHEN c THEN 1 END) AS n_modified, round(100.0::DOUBLE * count(CASE WHEN c THEN 1 END) / count(*), 6) AS percent FROM p GROUP BY 1, 2"
)
def modified_matrix(spark, sf_dir) -> DataFrame:
    return lookup.modified_share(_versions(spark, sf_dir), "p_partkey", ["p_name", "base", "value"])


@query(HITS + " SELECT a.run, b.run AS other, round(avg(CASE WHEN a.qid IS NOT DISTINCT FROM b.qid THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM hit a JOIN hit b ON a.tab_id = b.tab_id AND a.row_id = b.row_id AND a.run < b.run GROUP BY 1, 2")
def run_agreement(spark, sf_dir) -> DataFrame:
    return lookup.agreement(hits(spark, sf_dir), sorted(RUNS), ["tab_id", "row_id"])


@query(HITS + ", p AS (SELECT run, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0 END) AS p, count(*) AS n FROM hit GROUP BY 1) SELECT run, round(p, 6) AS p, round(sqrt(p * (1 - p) / n), 6) AS sigma, row_number() OVER (ORDER BY p DESC, run) = 1 AS best FROM p")
def best_run(spark, sf_dir) -> DataFrame:
    return lookup.best_run(hits(spark, sf_dir))


@query(BASE + ", b AS (SELECT unnest([1, 2, 3, 4]) AS branch), f AS (SELECT DISTINCT tab_id, row_id, quality FROM cand) SELECT branch, count(*) AS n_cells, count(*) - count(f.quality) AS n_without, round((count(*) - count(f.quality))::DOUBLE / count(*), 6) AS share FROM cell CROSS JOIN b LEFT JOIN f ON f.tab_id = cell.tab_id AND f.row_id = cell.row_id AND f.quality = branch GROUP BY 1")
def branch_abstention(spark, sf_dir) -> DataFrame:
    return lookup.abstentions(gold(spark, sf_dir), candidates(spark, sf_dir), [1, 2, 3, 4], ["tab_id", "row_id"])


@query(
    "WITH e AS (SELECT min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 30.0::DOUBLE AS width, count(o_totalprice) AS total FROM orders) "
    "SELECT bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / max(total) / max(width), 15) AS density FROM (SELECT CAST(least(floor((o_totalprice - low) / width), 29) AS INTEGER) AS bin, total, width FROM orders, e) GROUP BY 1"
)
def price_histogram(spark, sf_dir) -> DataFrame:
    return lookup.histogram(read(spark, sf_dir, "orders"), "o_totalprice", bins=30).withColumn("density", F.round("density", 15))


@query(BASE + ", t AS MATERIALIZED (SELECT tab_id, col_id, type, pct, row_number() OVER w AS rank, lead(pct) OVER w AS next FROM sup WHERE prop = 'p31' WINDOW w AS (PARTITION BY tab_id, col_id ORDER BY pct DESC, type)), g AS (SELECT tab_id, col_id FROM t WHERE rank = 1 AND round(pct - next, 9) < 0.3) SELECT tab_id, col_id, type, CAST(rank AS INTEGER) AS rank FROM t JOIN g USING (tab_id, col_id) WHERE rank <= 5")
def cta_choice(spark, sf_dir) -> DataFrame:
    return lookup.shortlist(rk.type_support(found(spark, sf_dir), "p31"), margin=0.3, limit=5)
