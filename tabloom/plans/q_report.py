"""Queries of reports on annotations, and of tokens that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import STOP_WORDS, counts_as_token, strip_signs
from tabloom.operators import assembly as asm
from tabloom.operators import ranking as rk
from tabloom.operators import report
from tabloom.plans.q_eval import gold
from tabloom.plans.standin import BASE, CHOICES, RUNS, features, found, read

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


#: A customer's column is of its nation and another one; nations are a chain, the lesser keys above. Run a guesses, run b is often right.
_DETAILS = """WITH h AS (SELECT g.n_nationkey AS g, v.n_nationkey AS v, CASE WHEN v.n_nationkey < g.n_nationkey THEN 'ancestor' ELSE 'descendant' END AS direction, abs(g.n_nationkey - v.n_nationkey) AS depth FROM nation g, nation v WHERE g.n_nationkey <> v.n_nationkey AND (g.n_nationkey + v.n_nationkey) % 3 > 0),
a AS (SELECT 'a' AS run, c_custkey AS tab_id, c_nationkey AS g, (c_nationkey * 7 + c_custkey) % 25 AS v FROM customer UNION ALL SELECT 'b', c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END FROM customer),
t AS (SELECT run, tab_id, v, pos, CASE pos WHEN 0 THEN g ELSE (g + 11) % 25 END AS g FROM a, (SELECT unnest([0, 1]) AS pos)),
k AS (SELECT run, tab_id, pos, CASE WHEN t.v = t.g THEN 1.0 WHEN direction = 'ancestor' AND depth <= 5 THEN pow(0.8::DOUBLE, depth) WHEN direction = 'descendant' AND depth <= 3 THEN pow(0.7::DOUBLE, depth) ELSE 0.0 END AS score,
  CASE WHEN t.v = t.g THEN 'exact' WHEN direction IS NULL THEN 'miss' WHEN (direction = 'ancestor' AND depth > 5) OR depth > 3 AND direction = 'descendant' THEN direction || '_far' ELSE direction END AS kind, CASE WHEN t.v = t.g THEN 0 ELSE depth END AS depth
  FROM t LEFT JOIN h ON h.g = t.g AND h.v = t.v),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, tab_id ORDER BY kind = 'miss', score DESC, pos) AS r FROM k) WHERE r = 1)"""


def _details(spark, sf_dir) -> DataFrame:
    nation, c = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g")), read(spark, sf_dir, "customer")
    name = lambda x, letter="T": F.concat(F.lit(letter), x.cast("string"))
    v = nation.withColumnRenamed("g", "v")
    h = nation.join(v, (F.col("g") != F.col("v")) & ((F.col("g") + F.col("v")) % 3 > 0))
    h = h.select(name(F.col("g")).alias("type"), name(F.col("v")).alias("other"), F.when(F.col("v") < F.col("g"), "ancestor").otherwise("descendant").alias("direction"), F.abs(F.col("g") - F.col("v")).cast("int").alias("depth"))
    key, own = F.col("c_custkey"), F.col("c_nationkey")
    types = c.select(key.alias("tab_id"), F.lit(0).alias("col_id"), F.array(name(own), name((own + 11) % 25)).alias("types"))
    runs = {"a": name((own * 7 + key) % 25, "t"), "b": name(F.when(key % 2 == 0, own).otherwise((own + 1) % 25))}
    made = [c.select(F.lit(r).alias("run"), key.alias("tab_id"), F.lit(0).alias("col_id"), x.alias("value")) for r, x in runs.items()]
    return report.type_details(made[0].union(made[1]), types, h)


@query(
    f"{_DETAILS} SELECT run, count(*) AS annotations, count(CASE WHEN kind = 'exact' THEN 1 END) AS exact, count(CASE WHEN kind = 'ancestor' THEN 1 END) AS ancestor, count(CASE WHEN kind = 'descendant' THEN 1 END) AS descendant, count(CASE WHEN kind LIKE '%_far' THEN 1 END) AS far, count(CASE WHEN kind = 'miss' THEN 1 END) AS miss, "
    "round(100.0::DOUBLE * count(CASE WHEN kind = 'exact' THEN 1 END) / count(*), 2) AS exact_pct, round(100.0::DOUBLE * count(CASE WHEN kind IN ('ancestor', 'descendant') THEN 1 END) / count(*), 2) AS partial_pct, round(avg(score::DOUBLE), 4) AS mean_score FROM d GROUP BY 1"
)
def cta_kind_breakdown(spark, sf_dir) -> DataFrame:
    return report.type_breakdown(_details(spark, sf_dir))


@query(f"{_DETAILS}, n AS (SELECT run, kind, depth, count(*) AS n FROM d WHERE kind IN ('ancestor', 'descendant') GROUP BY 1, 2, 3) SELECT r.run, k.kind, CAST(k.depth AS INTEGER) AS depth, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT run FROM d) r CROSS JOIN (SELECT DISTINCT kind, depth FROM n) k LEFT JOIN n ON n.run = r.run AND n.kind = k.kind AND n.depth = k.depth")
def cta_kind_depths(spark, sf_dir) -> DataFrame:
    return report.depth_counts(_details(spark, sf_dir))


_MISSES = """, one AS (SELECT * FROM cand WHERE quality <> 2 OR tab_id % 2 = 0), cells AS (SELECT tab_id, row_id, count(*) AS n FROM one GROUP BY 1, 2),
g AS (SELECT c.tab_id, c.row_id, coalesce(n, 0) AS n, o.quality FROM cell c LEFT JOIN cells s ON s.tab_id = c.tab_id AND s.row_id = c.row_id LEFT JOIN one o ON o.tab_id = c.tab_id AND o.row_id = c.row_id AND o.qid = concat('Q', c.gold)),
p AS (SELECT c.tab_id, c.row_id, count(CASE WHEN o.quality = 1 THEN 1 END) AS q1, count(CASE WHEN o.quality = 2 THEN 1 END) AS q2, count(CASE WHEN o.quality = 3 THEN 1 END) AS q3, count(o.qid) = 0 AS empty FROM cell c LEFT JOIN one o ON o.tab_id = c.tab_id AND o.row_id = c.row_id GROUP BY 1, 2)
SELECT 'gold' AS measure, 0 AS quality, count(*) AS n FROM g UNION ALL SELECT 'with_candidates', 0, count(CASE WHEN n > 0 THEN 1 END) FROM g UNION ALL SELECT 'found', 0, count(quality) FROM g
UNION ALL SELECT 'only_one_wrong', 0, count(CASE WHEN quality IS NULL AND n = 1 THEN 1 END) FROM g UNION ALL SELECT 'over_five_wrong', 0, count(CASE WHEN quality IS NULL AND n > 5 THEN 1 END) FROM g
UNION ALL SELECT 'found', q, count(CASE WHEN quality = q THEN 1 END) FROM g, (SELECT unnest([1, 2, 3]) AS q) GROUP BY q UNION ALL SELECT 'placeholders', 0, count(CASE WHEN empty THEN 1 END) FROM p
UNION ALL SELECT 'rows', q, sum([q1, q2, q3][q])::BIGINT FROM p, (SELECT unnest([1, 2, 3]) AS q) GROUP BY q UNION ALL SELECT 'cells_without', q, count(CASE WHEN [q1, q2, q3][q] = 0 THEN 1 END) FROM p, (SELECT unnest([1, 2, 3]) AS q) GROUP BY q"""


@query(BASE + _MISSES)
def candidate_misses(spark, sf_dir) -> DataFrame:
    one = F.filter("of", lambda c: (c["quality"] != 2) | (F.col("tab_id") % 2 == 0))
    return report.candidate_misses_of_cells(found(spark, sf_dir).withColumn("of", one))


_PAIRS = """WITH g AS (SELECT o_orderkey AS tab_id, 0 AS sub_col, o_custkey % 2 + 1 AS obj_col, 'P' || o_custkey % 5 AS property FROM orders WHERE o_orderkey % 7 > 0),
m AS (SELECT DISTINCT l_orderkey AS tab_id, 0 AS sub_col, 1 AS obj_col, 'p' || l_orderkey % 5 AS property FROM lineitem WHERE l_orderkey % 4 > 0)
SELECT coalesce(g.property, m.property) AS property, CASE WHEN g.tab_id IS NULL THEN 'extra' WHEN lower(m.property) = lower(g.property) THEN 'correct' WHEN m.tab_id IS NOT NULL THEN 'wrong' WHEN t.tab_id IS NOT NULL THEN 'pair missing' ELSE 'table absent' END AS outcome, count(*) AS n
FROM g FULL JOIN m ON m.tab_id = g.tab_id AND m.sub_col = g.sub_col AND m.obj_col = g.obj_col LEFT JOIN (SELECT DISTINCT tab_id FROM m) t ON t.tab_id = g.tab_id GROUP BY 1, 2"""


@query(_PAIRS)
def cpa_pair_outcomes(spark, sf_dir) -> DataFrame:
    o, made = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("tab_id")).distinct()
    name = lambda letter, x: F.concat(F.lit(letter), (x % 5).cast("string"))
    g = o.where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("tab_id"), F.lit(0).alias("sub_col"), (F.col("o_custkey") % 2 + 1).cast("int").alias("obj_col"), name("P", F.col("o_custkey")).alias("property"))
    m = made.select("tab_id", F.lit(0).alias("sub_col"), F.lit(1).alias("obj_col"), name("p", F.col("tab_id")).alias("property"))
    return report.property_outcomes(g, m).groupBy("property", "outcome").agg(F.count(F.lit(1)).alias("n"))


_BINNED = """, acc AS (SELECT c.tab_id, avg(CASE WHEN h.qid = concat('Q', c.gold) THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM cell c LEFT JOIN (SELECT * FROM choice WHERE run = 'a_default') h ON h.tab_id = c.tab_id AND h.row_id = c.row_id GROUP BY 1),
s AS (SELECT accuracy, [1.0::DOUBLE, 0.8, 0.7, 0.0][tab_id % 4 + 1] AS score FROM acc), b AS (SELECT * FROM (VALUES ('[0.00, 0.25)', 0.0::DOUBLE, 0.25::DOUBLE), ('[0.25, 0.50)', 0.25, 0.5), ('[0.50, 0.75)', 0.5, 0.75), ('[0.75, 1.00)', 0.75, 1.0), ('1.00', 1.0, 1.01)) v(bin, low, high))
SELECT bin, count(score) AS n, round(avg(score), 6) AS mean_score, CASE WHEN count(score) > 0 THEN round(100.0::DOUBLE * count(CASE WHEN score = 1 THEN 1 END) / count(score), 6) END AS exact_pct, CASE WHEN count(score) > 0 THEN round(100.0::DOUBLE * count(CASE WHEN score >= 0.7 THEN 1 END) / count(score), 6) END AS good_pct FROM b LEFT JOIN s ON accuracy >= low AND accuracy < high GROUP BY 1"""


@query(CHOICES + _BINNED)
def accuracy_bins(spark, sf_dir) -> DataFrame:
    made = rk.best_by_setting(features(spark, sf_dir), {"a_default": RUNS["a_default"]}, ["qid"], ["gold"], every=True)
    hits = made.select("tab_id", "col_id", F.coalesce(F.col("qid") == F.col("gold"), F.lit(False)).alias("hit"))
    columns = gold(spark, sf_dir).select("tab_id", F.lit(0).alias("col_id")).distinct()
    score = F.element_at(F.array(*map(F.lit, (1.0, 0.8, 0.7, 0.0))), (F.col("tab_id") % 4).cast("int") + 1)
    return report.accuracy_bins(asm.column_accuracy(hits, columns.withColumn("score", score), columns))


@query("SELECT user_id, event_id, n_in, n_out, CAST(sum(n_in) OVER w AS BIGINT) AS total_n_in, CAST(sum(n_out) OVER w AS BIGINT) AS total_n_out, count(*) OVER w AS total_calls FROM (SELECT user_id, event_id, CAST(floor(value * 10) AS BIGINT) AS n_in, CASE WHEN event_id % 6 > 0 THEN event_id % 50 ELSE 0 END AS n_out FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def cost_running(spark, sf_dir) -> DataFrame:
    calls = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 10).alias("n_in"), F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 50).alias("n_out"))
    return report.cost_log(calls, ["user_id"], "event_id", ["n_in", "n_out"])


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


@query(
    "WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM documents), t AS (SELECT regexp_replace(w, '^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$', '', 'g') AS token FROM w) "
    f"SELECT token, count(*) AS n FROM t WHERE length(token) >= 2 AND token NOT IN ({_STOP}) AND NOT regexp_full_match(token, '\\p{{N}}+') GROUP BY 1 ORDER BY n DESC, token LIMIT 1000"
)
def eda_tokens_kept(spark, sf_dir) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split(F.lower("text"), r"[ \t\n\x0b\f\r]+"), "")).alias("w"))
    tokens = words.select(strip_signs(F.col("w")).alias("token")).where(counts_as_token(F.col("token")))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(1000)
