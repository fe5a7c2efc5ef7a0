"""Reports on annotations, with ties, nulls and empty tables."""

from pyspark.sql import functions as F

from tabloom.functions.similarity import candidate_text
from tabloom.operators import assembly as asm
from tabloom.operators import methods, prep, report


def test_type_details(spark):
    made = spark.createDataFrame([("r", "t", k, v) for k, v in enumerate(["a", "B", "c", "d", "e", "f", "z", None])], "run string, tab_id string, col_id int, value string")
    gold = spark.createDataFrame([("t", k, ["A", "X"]) for k in range(8)] + [("u", 0, ["A"])], "tab_id string, col_id int, types array<string>")
    h = [("A", "b", "ancestor", 2), ("x", "B", "ancestor", 1), ("A", "c", "ancestor", 6), ("X", "c", "descendant", 4), ("A", "d", "descendant", 3), ("A", "d", "ancestor", 1), ("X", "e", "descendant", 1), ("X", "f", "ancestor", 9)]
    details = report.type_details(made, gold, spark.createDataFrame(h, "type string, other string, direction string, depth int"))
    got = {r["col_id"]: (round(r["score"], 6), r["kind"], r["depth"]) for r in details.collect()}
    assert got == {0: (1.0, "exact", 0), 1: (0.8, "ancestor", 1), 2: (0.0, "ancestor_far", 6), 3: (0.8, "ancestor", 1), 4: (0.7, "descendant", 1), 5: (0.0, "ancestor_far", 9), 6: (0.0, "miss", None), 7: (0.0, "miss", None)}
    r = report.type_breakdown(details).first()
    assert (r["annotations"], r["exact"], r["ancestor"], r["descendant"], r["far"], r["miss"], r["exact_pct"], r["partial_pct"]) == (8, 1, 2, 1, 2, 2, 12.5, 37.5)
    both = details.union(details.where("kind = 'miss'").withColumn("run", F.lit("other")))
    assert sorted(map(tuple, report.depth_counts(both).collect())) == [("other", "ancestor", 1, 0), ("other", "descendant", 1, 0), ("r", "ancestor", 1, 2), ("r", "descendant", 1, 1)]


def test_candidate_misses(spark):
    rows = [("t", 0, 0, 1, "Q1", 1), ("t", 0, 0, 2, "Q1", 3), ("t", 1, 0, 1, "Q9", 2), ("t", 3, 0, 1, "", 0)] + [("t", 2, 0, k, f"Q{10 + k}", 1) for k in range(6)]
    found = spark.createDataFrame(rows, "tab_id string, row_id int, col_id int, ord int, qid string, quality int")
    gold = spark.createDataFrame([("t", k, 0, "Q1") for k in range(5)], "tab_id string, row_id int, col_id int, qid string")
    got = {(r["measure"], r["quality"]): r["n"] for r in report.candidate_misses(gold, found).collect()}
    want = {("gold", 0): 5, ("with_candidates", 0): 3, ("found", 0): 1, ("only_one_wrong", 0): 1, ("over_five_wrong", 0): 1, ("found", 1): 0, ("found", 2): 0, ("found", 3): 1, ("placeholders", 0): 1}
    assert got == want | {("rows", 1): 7, ("rows", 2): 1, ("rows", 3): 1, ("cells_without", 1): 2, ("cells_without", 2): 3, ("cells_without", 3): 3}
    assert sum(r["n"] for r in report.candidate_misses(gold.limit(0), found.limit(0)).collect()) == 0


def test_outcomes_bins_and_costs(spark):
    pair = "tab_id string, sub_col int, obj_col int, property string"
    gold = spark.createDataFrame([("t", 0, 1, "P1"), ("t", 0, 2, "P2"), ("t", 0, 3, "P3"), ("u", 0, 1, "P1")], pair)
    made = spark.createDataFrame([("t", 0, 1, "p1"), ("t", 0, 2, "P9"), ("v", 0, 1, "P1")], pair)
    got = sorted((r["tab_id"], r["obj_col"], r["outcome"]) for r in report.property_outcomes(gold, made).collect())
    assert got == [("t", 1, "correct"), ("t", 2, "wrong"), ("t", 3, "pair missing"), ("u", 1, "table absent"), ("v", 1, "extra")]
    bins = {r["bin"]: tuple(r)[1:] for r in report.accuracy_bins(spark.createDataFrame([(0.0, 1.0), (0.2, 0.0), (1.0, 0.7), (0.75, 0.5)], "accuracy double, score double")).collect()}
    assert bins == {"[0.00, 0.25)": (2, 0.5, 50.0, 50.0), "[0.25, 0.50)": (0, None, None, None), "[0.50, 0.75)": (0, None, None, None), "[0.75, 1.00)": (1, 0.5, 0.0, 0.0), "1.00": (1, 0.7, 0.0, 100.0)}
    calls = spark.createDataFrame([("a", 2, 5), ("a", 1, None), ("a", 3, 7), ("b", 1, 1)], "stage string, at int, tokens long")
    log = report.cost_log(calls, ["stage"], "at", ["tokens"])
    assert sorted((r["stage"], r["at"], r["total_tokens"], r["total_calls"]) for r in log.collect()) == [("a", 1, 0, 1), ("a", 2, 5, 2), ("a", 3, 12, 3), ("b", 1, 1, 1)]
    grown = report.deltas(log, ["stage"], "at", ["total_tokens"])
    assert sorted((r["stage"], r["at"], r["total_tokens_delta"]) for r in grown.collect()) == [("a", 1, 0), ("a", 2, 5), ("a", 3, 7), ("b", 1, 1)]


def test_strict_ids_and_texts(spark):
    row = spark.createDataFrame([("I take Q57, not Q5x", ["Q5", "Q57"], "l", None, ["a", "b"])], "r string, ids array<string>, label string, d string, al array<string>")
    pick = row.select(methods.picked(F.col("r"), F.col("ids"), False).alias("a"), methods.picked(F.col("r"), F.col("ids"), False, strict=True).alias("b"), candidate_text(F.col("label"), F.col("d"), F.col("al")).alias("t")).first()
    assert tuple(pick) == ("Q5", "Q57", "l a b")


def test_enriched_and_corrected(spark):
    kinds = "qid string, description string, aliases array<string>, p31 array<string>, p279 array<string>, sitelink string"
    known = spark.createDataFrame([("Q1", "d", None, ["Q5"], None, "S"), ("Q1", "d", None, ["Q5"], None, "S"), ("Q2", None, ["a"], None, None, None)], kinds)
    rows = spark.createDataFrame([(1, "Q1"), (2, "Q2"), (3, "Q3"), (4, None)], "k int, qid string")
    got = {r["k"]: tuple(r)[2:] for r in asm.enriched(rows, known).collect()}
    assert got == {1: ("d", [], ["Q5"], [], "S"), 2: ("", ["a"], [], [], ""), 3: ("", [], [], [], ""), 4: ("", [], [], [], "")}
    values = spark.createDataFrame([("Bern",), ("Bern",), ("Rom",), ("x",), (None,)], "v string")
    answers = spark.createDataFrame([("Bern", "'Berne.'"), ("Rom", ""), ("x", "far too long an answer")], "value string, answer string")
    assert sorted(r["v"] or "" for r in asm.corrected(values, "v", answers).collect()) == ["", "Berne", "Berne", "Rom", "x"]


def test_windows(spark):
    rows = spark.createDataFrame([("t", k, f"r{k}") for k in range(7)] + [("u", 0, "only")], "tab_id string, row_id int, text string")
    got = {(r["tab_id"], r["row_id"]): (r["n_rows"], r["first_row"], r["context"]) for r in prep.table_windows(rows, 4).collect()}
    assert got["t", 0] == (4, 0, "r0|r1|r2|r3") and got["t", 6] == (3, 4, "r4|r5|r6") and got["t", 3] == (4, 1, "r1|r2|r3|r4") and got["u", 0] == (1, 0, "only")
    assert prep.table_windows(rows.limit(0), 4).count() == 0
