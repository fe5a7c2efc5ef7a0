"""Queries of the text and similarity functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import similarity as sim
from tabloom.functions import text as tx
from tabloom.operators import methods
from tabloom.operators import ranking as rk
from tabloom.plans.standin import read

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS cleaned FROM pages")
def clean_html(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tx.squeeze(tx.strip_tags(F.col("html"))).alias("cleaned"))


_UNWRAP = """CASE WHEN {0} LIKE '"""+'"""'+"""%' AND {0} LIKE '%"""+'"""'+"""' THEN substring({0}, 4, greatest(length({0}) - 6, 0)) ELSE {0} END"""


@query(f"""SELECT conv_id, turn, CASE WHEN y LIKE '**%' AND y LIKE '%**' THEN substring(y, 3, greatest(length(y) - 4, 0)) ELSE y END AS cleaned
FROM (SELECT conv_id, turn, {_UNWRAP.format('x')} AS y FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('{'"""'}', role, ' said', '{'"""'}') WHEN turn % 3 = 1 THEN concat('**', role, '**') ELSE role END AS x FROM conversations))""")
def clean_text_wrappers(spark, sf_dir) -> DataFrame:
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"""'), "role", F.lit(' said"""'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("**"), "role", F.lit("**"))).otherwise(F.col("role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.unwrap(x).alias("cleaned"))


@query("""SELECT p_partkey, CASE WHEN b LIKE '%.' AND NOT r LIKE '%..' THEN trim(substring(b, 1, length(b) - 1)) ELSE b END AS q
FROM (SELECT p_partkey, trim(x) AS r, trim(replace(replace(trim(x), '"', ''), '**', '')) AS b FROM
 (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(' "', p_name, '" ') WHEN 1 THEN concat('**', p_name, '**.') WHEN 2 THEN concat(p_name, '..') ELSE concat(p_name, '.') END AS x FROM part))""")
def query_clean(spark, sf_dir) -> DataFrame:
    n = F.col("p_name")
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat(F.lit(' "'), n, F.lit('" '))).when(k == 1, F.concat(F.lit("**"), n, F.lit("**."))).when(k == 2, F.concat(n, F.lit(".."))).otherwise(F.concat(n, F.lit(".")))
    return read(spark, sf_dir, "part").select("p_partkey", tx.clean_query(x).alias("q"))


_FUZZY = """CASE p_partkey % 6 WHEN 0 THEN concat('The ', p_name, ' (', p_brand, ') and (', p_type, ')') WHEN 1 THEN concat(p_name, ',', p_type) WHEN 2 THEN concat(p_name, ' - ', p_brand, ' - ', p_type) WHEN 3 THEN concat('"', p_name, '"') WHEN 4 THEN concat('*', p_brand, '* / ', p_type) ELSE concat('a ', p_brand) END"""


@query(f"""WITH t AS (SELECT p_partkey, x, trim(regexp_replace(x, '["*]', '', 'g')) AS b FROM (SELECT p_partkey, {_FUZZY} AS x FROM part)),
w AS (SELECT *, list_filter(string_split_regex(b, '\\s+'), lambda v: v <> '') AS ws, trim(string_split(b, ',')[1]) AS c1, trim(substring(b, length(string_split(b, ',')[1]) + 2)) AS c2,
  trim(regexp_replace(b, '\\s*\\(.*?\\)\\s*', ' ', 'g')) AS p, trim(regexp_replace(b, '^(?i:the|a|an)\\s+', '')) AS a FROM t),
v AS (SELECT p_partkey, x, list_concat([b, CASE WHEN p <> b THEN p END, CASE WHEN a <> b THEN a END, CASE WHEN contains(b, ',') AND c1 <> '' AND c2 <> '' THEN concat(c2, ' ', c1) END, CASE WHEN contains(b, ',') AND c1 <> '' AND c2 <> '' THEN c1 END,
   CASE WHEN lower(ws[1]) NOT IN ('the', 'a', 'an') AND ws[1] <> b THEN ws[1] END, CASE WHEN len(ws) >= 3 THEN concat(ws[1], ' ', ws[2]) END], regexp_extract_all(b, '\\(([^)]+)\\)', 1),
  CASE WHEN contains(b, ' - ') THEN string_split(b, ' - ') ELSE [] END, CASE WHEN contains(b, ' – ') THEN string_split(b, ' – ') ELSE [] END, CASE WHEN contains(b, ' / ') THEN string_split(b, ' / ') ELSE [] END) AS vs FROM w)
SELECT DISTINCT p_partkey, trim(s) AS variant FROM (SELECT p_partkey, x, unnest(vs) AS s FROM v) WHERE s IS NOT NULL AND trim(s) <> '' AND trim(s) <> x""")
def fuzzy_variants(spark, sf_dir) -> DataFrame:
    k, n, b, t = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    x = (
        F.when(k == 0, F.concat(F.lit("The "), n, F.lit(" ("), b, F.lit(") and ("), t, F.lit(")"))).when(k == 1, F.concat(n, F.lit(","), t)).when(k == 2, F.concat(n, F.lit(" - "), b, F.lit(" - "), t))
        .when(k == 3, F.concat(F.lit('"'), n, F.lit('"'))).when(k == 4, F.concat(F.lit("*"), b, F.lit("* / "), t)).otherwise(F.concat(F.lit("a "), b))
    )
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(tx.fuzzy_variants(x)).alias("variant"))



_CHANGED = "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE concat(source, '!') END"


@query(f"SELECT doc_id, CASE WHEN a = b THEN 'same' WHEN lower(a) = lower(b) THEN 'case' ELSE 'real' END AS change FROM (SELECT doc_id, source AS a, {_CHANGED} AS b FROM documents)")
def change_classify(spark, sf_dir) -> DataFrame:
    return _changes(spark, sf_dir).select("doc_id", "change")


def _changes(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 3
    after = F.when(k == 0, F.col("source")).when(k == 1, F.upper("source")).otherwise(F.concat("source", F.lit("!")))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", tx.change(F.col("source"), after).alias("change"))


@query(f"SELECT lang, count(*) AS n, count(CASE WHEN a = b THEN 1 END) AS n_same, count(CASE WHEN a <> b AND lower(a) = lower(b) THEN 1 END) AS n_case, count(CASE WHEN lower(a) <> lower(b) THEN 1 END) AS n_real FROM (SELECT lang, source AS a, {_CHANGED} AS b FROM documents) GROUP BY lang")
def edit_stats(spark, sf_dir) -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("change") == kind, 1)).alias(f"n_{kind}")
    return _changes(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), count("same"), count("case"), count("real"))


_PAIRS = "SELECT DISTINCT a.p_brand, a.p_name AS x, b.n_name AS y FROM part a JOIN nation b ON b.n_nationkey = a.p_size % 25"


def _pairs(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("k"), F.col("n_name").alias("y"))
    return read(spark, sf_dir, "part").withColumn("k", (F.col("p_size") % 25).cast("long")).join(n, "k").select("p_brand", F.col("p_name").alias("x"), "y").distinct()


@query(f"SELECT p_brand, x, y, round(CAST(greatest(length(x), length(y)) - levenshtein(lower(x), lower(y)) AS DOUBLE) / greatest(length(x), length(y)), 6) AS sim FROM ({_PAIRS})")
def lev_similarity(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("sim", F.round(sim.levenshtein_similarity(F.col("x"), F.col("y")), 6))


_TWO = "SELECT DISTINCT a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type"
_JAC = "round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6)"
_SETS = f"SELECT x, y, list_distinct(string_split(lower(x), ' ')) AS a, list_distinct(string_split(lower(y), ' ')) AS b FROM ({_TWO})"


def _two(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", "p_name")
    keys = ["p_brand", "p_size", "p_type"]
    return p.withColumnRenamed("p_name", "x").join(p.withColumnRenamed("p_name", "y"), keys).select("x", "y").distinct()


@query(f"SELECT x, y, {_JAC} AS sim FROM ({_SETS})")
def token_jaccard(spark, sf_dir) -> DataFrame:
    return _two(spark, sf_dir).withColumn("sim", F.round(sim.token_jaccard(F.col("x"), F.col("y")), 6))


@query(f"SELECT x, y, greatest({_JAC}, round(CAST(greatest(length(x), length(y)) - levenshtein(lower(x), lower(y)) AS DOUBLE) / greatest(length(x), length(y)), 6)) AS sim FROM ({_SETS})")
def best_string_sim(spark, sf_dir) -> DataFrame:
    return _two(spark, sf_dir).withColumn("sim", F.round(sim.best_similarity(F.col("x"), F.col("y")), 6))


@query("SELECT p_brand, count(*) AS n, count(CASE WHEN abs(a - b) <= greatest(0.5, 0.02 * greatest(abs(a), abs(b))) THEN 1 END) AS n_close FROM (SELECT a.p_brand, a.p_retailprice AS a, b.p_retailprice AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size) GROUP BY p_brand")
def numeric_match(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").groupBy("p_brand", "p_size", "p_retailprice").agg(F.count(F.lit(1)).alias("n"))  # equal prices are compared once
    rows = p.join(p.withColumnsRenamed({"p_retailprice": "other", "n": "m"}), ["p_brand", "p_size"])
    close = sim.numbers_close(sim.to_number(F.col("p_retailprice").cast("string")), F.col("other"))
    pairs = F.col("n") * F.col("m")
    return rows.groupBy("p_brand").agg(F.sum(pairs).alias("n"), F.sum(F.when(close, pairs).otherwise(0)).alias("n_close"))


@query("SELECT o_orderkey, (1990 + o_orderkey % 10) = CAST(year(o_orderdate) AS BIGINT) AS matched FROM orders")
def year_match(spark, sf_dir) -> DataFrame:
    time = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return read(spark, sf_dir, "orders").select("o_orderkey", sim.years_match(1990 + F.col("o_orderkey") % 10, time).alias("matched"))


@query("""SELECT tab_id, 0 AS col_id, avg(CASE WHEN v IS NOT NULL AND regexp_full_match(v, '[-+]?\\d[\\d,]*\\.?\\d*') THEN 1.0 ELSE 0.0 END) > 0.8 AS literal
FROM (SELECT user_id AS tab_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN NULL WHEN 2 THEN '1,234.5' ELSE CAST(event_id AS VARCHAR) END AS v FROM events) GROUP BY tab_id""")
def literal_type(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 7
    value = F.when(k == 0, F.col("event_type")).when(k == 1, None).when(k == 2, "1,234.5").otherwise(F.col("event_id").cast("string"))
    return rk.literal_types(read(spark, sf_dir, "events").select(F.col("user_id").alias("tab_id"), F.lit(0).alias("col_id"), value.alias("value")))


@query("SELECT user_id AS tab_id, 0 AS col_id, round(avg(CASE WHEN event_id % 7 > 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM events GROUP BY 1")
def numeric_share(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 7
    value = F.when(k == 0, F.col("event_type")).when(k == 1, None).when(k == 2, "1,234.5").otherwise(F.col("event_id").cast("string"))
    rows = rk.numeric_shares(read(spark, sf_dir, "events").select(F.col("user_id").alias("tab_id"), F.lit(0).alias("col_id"), value.alias("value")))
    return rows.withColumn("share", F.round("share", 6))


@query("""WITH t AS (SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN 'Answer - Q' WHEN 1 THEN 'I think Q' WHEN 2 THEN 'none of these Q' ELSE 'final: NIL, not Q' END, conv_id, ' and not Q', turn + 100) AS r FROM conversations)
SELECT conv_id, turn, regexp_extract(r, '\\bQ\\d+\\b', 0) AS first_id, CASE turn % 4 WHEN 0 THEN concat('Q', conv_id) WHEN 3 THEN 'NIL' ELSE concat('Q', turn + 100) END AS final_id,
  CASE turn % 4 WHEN 2 THEN concat('Q', conv_id) WHEN 3 THEN 'NIL' ELSE concat('Q', conv_id) END AS of_candidates, turn % 4 >= 2 AS nil FROM t""")
def llm_parse_ids(spark, sf_dir) -> DataFrame:
    k, conv = F.col("turn") % 4, F.concat(F.lit("Q"), F.col("conv_id").cast("string"))
    r = F.concat(F.when(k == 0, "Answer - ").when(k == 1, "I think ").when(k == 2, "none of these ").otherwise("final: NIL, not "), conv, F.lit(" and not Q"), (F.col("turn") + 100).cast("string"))
    rows = read(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", r.alias("r"), F.array(conv).alias("ids"))
    return rows.select("conv_id", "turn", tx.entity_id(F.col("r")).alias("first_id"), tx.final_answer(F.col("r")).alias("final_id"), tx.final_answer(F.col("r"), F.col("ids")).alias("of_candidates"), tx.is_nil(F.col("r")).alias("nil"))


@query("""SELECT DISTINCT conv_id, turn, trim(regexp_replace(trim(s), '^\\d+[.)]\\s*', '')) AS term FROM (SELECT conv_id, turn, unnest([concat('1. ', role), concat(' 2) ', turn), concat(' ', role)]) AS s FROM conversations)""")
def llm_parse_final(spark, sf_dir) -> DataFrame:
    r = F.concat(F.lit("Some thoughts. Candidates: x; FINAL: 1. "), "role", F.lit("; 2) "), F.col("turn").cast("string"), F.lit("; "), "role")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.llm_terms(r)).alias("term"))


@query("""WITH t AS (SELECT conv_id, turn % 3 AS sample, turn, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END AS term FROM conversations),
v AS (SELECT conv_id, lower(term) AS folded, count(DISTINCT sample) AS votes, min(sample * 1000000 + turn) AS first, arg_min(term, sample * 1000000 + turn) AS term FROM t GROUP BY 1, 2)
SELECT conv_id, term, votes, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, first) AS rank FROM v) WHERE rank <= 5""")
def sc_vote(spark, sf_dir) -> DataFrame:
    term = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("sample"), F.col("turn").alias("pos"), term.alias("term"))
    return methods.vote(rows, ["conv_id"], limit=5)


@query("SELECT p_partkey, concat('Cell: ', p_name, ' | Options: ', p_brand, ', ', p_type, ' ${x}') AS prompt FROM part")
def prompt_render(spark, sf_dir) -> DataFrame:
    prompt = tx.render("Cell: ${cell} | Options: ${options} ${x}", cell=F.col("p_name"), options=F.concat_ws(", ", "p_brand", "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('http://www.wikidata.org/entity/', 'Q', s_suppkey) ELSE concat('http://www.wikidata.org/entity/Q', s_suppkey) END AS uri, concat('Q', s_suppkey) AS tail FROM supplier")
def uri_normalise(spark, sf_dir) -> DataFrame:
    prefix = "http://www.wikidata.org/entity/"
    q = F.concat(F.lit("Q"), F.col("s_suppkey").cast("string"))
    u = tx.uri(F.when(F.col("s_suppkey") % 2 == 0, q).otherwise(F.concat(F.lit(prefix), q)), prefix)
    return read(spark, sf_dir, "supplier").select("s_suppkey", u.alias("uri"), tx.uri_tail(u).alias("tail"))
