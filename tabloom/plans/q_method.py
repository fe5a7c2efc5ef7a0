"""Queries of the methods that decide cells, with answers made up from the cells' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import nfkc
from tabloom.operators import methods
from tabloom.operators import ranking as rk
from tabloom.plans.q_eval import gold
from tabloom.plans.standin import SCORED, features, read

CATALOG: dict[str, tuple] = {}
THRESHOLD, REVIEW = 0.8, 0.9


def _decided(spark, sf_dir, name: str) -> DataFrame:
    cells = gold(spark, sf_dir).withColumn("col_id", F.lit(0))
    k = F.pmod(F.col("tab_id") + F.col("row_id"), F.lit(4))
    answers = cells.where(k != 3).withColumn("response", F.when(k == 0, F.concat(F.lit("I take "), "gold", F.lit("."))).when(k == 1, "none of these").otherwise("not sure"))
    return methods.decide(cells, rk.ranked_cells(features(spark, sf_dir)), answers, methods.METHODS[name], threshold=THRESHOLD, review=REVIEW).select("tab_id", "row_id", "qid", "source")


def _sql(name: str) -> str:
    m = methods.METHODS[name]
    several, doubt = "gap IS NOT NULL", f"score < {REVIEW}"
    ask = "true" if m.gate == "every" else f"{several} AND (gap < {m.margin} OR {doubt})" if m.one_is_sure else f"({several} AND gap < {m.margin}) OR {doubt}"
    return SCORED + f""",
s AS (SELECT tab_id, row_id, max(CASE WHEN rank = 1 THEN qid END) AS first, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 1 THEN gap END) AS gap, list(qid ORDER BY rank) FILTER (WHERE rank <= {m.topk}) AS ids FROM ranked GROUP BY 1, 2),
a AS (SELECT tab_id, row_id, CASE (tab_id + row_id) % 4 WHEN 0 THEN concat('I take Q', gold, '.') WHEN 1 THEN 'none of these' WHEN 2 THEN 'not sure' END AS response FROM cell),
j AS (SELECT a.tab_id, a.row_id, first, score, CASE WHEN {ask} THEN coalesce(list_filter(ids, lambda x: contains(response, x))[1], CASE WHEN response = 'none of these' THEN 'NIL' END) END AS answer FROM a LEFT JOIN s ON s.tab_id = a.tab_id AND s.row_id = a.row_id)
SELECT tab_id, row_id, CASE WHEN first IS NULL THEN 'NIL' WHEN answer IS NOT NULL THEN answer WHEN {str(m.by_score).lower()} AND score < {THRESHOLD} THEN 'NIL' ELSE first END AS qid,
  CASE WHEN first IS NULL THEN 'none' WHEN answer IS NOT NULL THEN 'model' WHEN {str(m.by_score).lower()} AND score < {THRESHOLD} THEN 'threshold' ELSE 'score' END AS source
FROM j WHERE first IS NOT NULL OR {str(m.by_score).lower()}"""


for _name in methods.METHODS:
    CATALOG[f"cea_{_name}"] = (lambda spark, sf_dir, _name=_name: _decided(spark, sf_dir, _name), _sql(_name))


def token_nfkc(spark, sf_dir) -> DataFrame:
    """Texts in compatibility form; SQL has no such function."""
    return read(spark, sf_dir, "documents").select("doc_id", nfkc("text").alias("text"))


CATALOG["token_nfkc"] = (token_nfkc, None)
