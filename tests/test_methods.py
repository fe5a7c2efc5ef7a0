import unicodedata

from pyspark.sql import functions as F

from tabloom.functions.text import nfkc
from tabloom.operators import lookup, methods

CELLS = "tab_id string, row_id int, col_id int"
SCORED = [("t", r, 0, o, q, s) for r, o, q, s in [(1, 1, "Q5", 0.9), (1, 2, "Q57", 0.88), (2, 1, "Q1", 0.3), (3, 1, "Q2", 0.9), (3, 2, "Q3", 0.5), (4, 1, "Q6", 0.7), (4, 2, "Q7", 0.7)]]
ANSWERS = [("t", 1, 0, "it is Q57"), ("t", 2, 0, "none of these"), ("t", 3, 0, "Q3"), ("t", 4, 0, None), ("t", 5, 0, "Q9")]


def run(spark, name, **how):
    cells = spark.createDataFrame([("t", r, 0) for r in range(1, 6)], CELLS)
    scored = spark.createDataFrame(SCORED, CELLS + ", ord int, qid string, score double")
    got = methods.decide(cells, scored, spark.createDataFrame(ANSWERS, CELLS + ", response string"), methods.METHODS[name], **how)
    return {r.row_id: (r.qid, r.source) for r in got.collect()}


def test_methods(spark):
    how = {"threshold": 0.4, "review": 0.8}
    # Q5 is part of Q57, and comes first
    limited = {1: ("Q5", "model"), 2: ("NIL", "threshold"), 3: ("Q2", "score"), 4: ("Q6", "score"), 5: ("NIL", "none")}
    assert run(spark, "limited", **how) == limited
    assert run(spark, "context", **how) == {**limited, 2: ("NIL", "model")}
    assert run(spark, "full", **how) == {1: ("Q5", "model"), 2: ("NIL", "model"), 3: ("Q3", "model"), 4: ("Q6", "score")}
    assert run(spark, "limited", allow_nil=False, **how) == {1: ("Q5", "model"), 2: ("Q1", "score"), 3: ("Q2", "score"), 4: ("Q6", "score")}
    switched = spark.createDataFrame([("t", 4, 0, "Q7"), ("t", 2, 0, "Q8")], CELLS + ", qid string")
    got = run(spark, "limited", switched=switched, **how)
    assert got[4] == ("Q7", "context") and got[2] == ("NIL", "threshold")


def test_nfkc(spark):
    texts = ["ﬁne Ａ１", "é", "", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nfkc("t").alias("t")).collect()]
    assert got == [unicodedata.normalize("NFKC", t) if t is not None else None for t in texts]


def test_lookup_edges(spark):
    names = spark.createDataFrame([(1, "Red ring"), (2, "red"), (3, None), (4, "redder"), (5, "red")], "id int, name string")
    terms = spark.createDataFrame([("red",), ("",), (None,), ("none",)], "term string")
    assert [(r.id, r.rank) for r in lookup.search(terms, names, 2).orderBy("rank").collect()] == [(2, 1), (5, 2)]
    assert [(r.id, r.rank) for r in lookup.search(terms, names, 9).orderBy("rank").collect()] == [(2, 1), (5, 2), (1, 3)]
    assert lookup.search_words(terms, names.limit(0), 3).count() == 0
    same = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert [tuple(r) for r in lookup.histogram(same, "x", 4).collect()] == [(0, 2, None)]
    ids = spark.createDataFrame([(1,), (1,), (None,), (2,)], "a int")
    assert [r.id for r in lookup.missing(ids.where("a = 2").select(F.col("a").alias("id")), "id", ids).collect()] == [1]
