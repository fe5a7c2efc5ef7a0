"""Prompts asked once, the direct baseline, debate and verification, votes."""

import hashlib

from pyspark.sql import functions as F

from tabloom.operators import baseline, methods, prompts

SCHEMA = "tab_id string, row_id int, col_id int, ord int, mention string, qid string, label string, description string, score double, extra int"


def responses(spark, said):
    """said: (text, sample, response)"""
    return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), s, r) for t, s, r in said], prompts.RESPONSES)


def test_a_text_is_asked_once(spark):
    items = prompts.addressed(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (4, "b")], "id int, q string"), F.col("q"))
    table = prompts.prompt_table(items, items, samples=2)
    assert sorted((r["text"], r["sample"]) for r in table.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    known = responses(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 1, "z")])
    assert [(r["text"], r["sample"]) for r in prompts.unanswered(table, known).collect()] == [("b", 0)]
    assert sorted((r["id"], r["response"] or "") for r in prompts.answered(items, known).collect()) == [(1, "x"), (2, "x"), (3, ""), (4, ""), (4, "")]
    assert prompts.prompt_table(items.limit(0)).count() == 0


def test_votes_ties_and_nulls(spark):
    items = prompts.addressed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, q string"), F.col("q"))
    said = [("a", 0, "Q2"), ("a", 1, "Q1"), ("a", 2, "Q1"), ("a", 3, "Q2"), ("a", 4, None), ("b", 0, None), ("b", 1, "Q9"), ("c", 0, None)]
    got = prompts.voted(items, responses(spark, said), ["id"], F.col("response"))
    assert sorted((r["id"], r["choice"], r["votes"]) for r in got.collect()) == [(1, "Q2", 2), (2, "Q9", 1)]


def cells(spark, rows):
    return spark.createDataFrame(rows, "tab_id string, row_id int, col_id int, header string, value string")


def test_table_blocks(spark):
    rows = [("t", r, c, f"h{c}", f"{r}.{c}" if (r, c) != (12, 1) else None) for r in range(25) for c in range(3) if (r, c) != (3, 2)] + [("one", 0, 0, None, "x" * 100)]
    targets = cells(spark, rows).select("tab_id", "row_id", "col_id").where("tab_id = 'one' or (row_id in (0, 12, 24) and col_id = 1)")
    targets = targets.union(targets).union(spark.createDataFrame([("t", 25, 0), ("t", 0, 3), ("t", -1, 0), ("none", 0, 0)], "tab_id string, row_id int, col_id int"))
    got = {(r["tab_id"], r["row_id"]): r for r in baseline.table_blocks(cells(spark, rows), targets, 20).collect()}
    assert sorted(got) == [("one", 0), ("t", 0), ("t", 12), ("t", 24)]
    of = {k: r["table"].split("\n") for k, r in got.items()}
    assert of["one", 0] == ["columns: 0", "", ">>" + "x" * 80 + "<<"] and got["one", 0]["mention"] == "x" * 80
    assert of["t", 0][:3] == ["columns: 0 | 1 | 2", "h0 | h1 | h2", "0.0 | >>0.1<< | 0.2"] and len(of["t", 0]) == 22 and of["t", 0][5] == "3.0 | 3.1 | "
    assert of["t", 12][2] == "2.0 | 2.1 | 2.2" and of["t", 12][12] == "12.0 | >><< | 12.2" and len(of["t", 12]) == 22
    assert of["t", 24][2] == "14.0 | 14.1 | 14.2" and len(of["t", 24]) == 13 and got["t", 24]["header"] == "h1"


def test_baseline_annotations(spark):
    rows = [("t", r, c, f"h{c}", v) for r, (a, b) in enumerate([("x", None), ("x", "1"), (" ", "2"), ("y", "3")]) for c, v in enumerate((a, b))] + [("u", 0, 0, "h", None)]
    columns = spark.createDataFrame([("t", 0), ("u", 0), ("none", 0)], "tab_id string, col_id int")
    cta = {r["tab_id"]: r["text"] for r in baseline.cta_prompts(cells(spark, rows), columns, most=2).collect()}
    assert sorted(cta) == ["t", "u"] and "values: x |  \n" in cta["t"] and "values: \n" in cta["u"]
    pairs = spark.createDataFrame([("t", 0, 1), ("t", 1, 7)], "tab_id string, sub_col int, obj_col int")
    cpa = baseline.cpa_prompts(cells(spark, rows), pairs).collect()
    assert len(cpa) == 1 and "x -> 1\ny -> 3\n" in cpa[0]["text"]
    items = prompts.addressed(baseline.cpa_prompts(cells(spark, rows), pairs), F.col("text"))
    assert [r["id"] for r in baseline.annotations(items, responses(spark, [(cpa[0]["text"], 0, "XP1 is wrong, P22 or P3")]), "cpa").collect()] == ["P22"]
    assert baseline.annotations(items, responses(spark, []), "cpa").count() == 0


def scored(spark):
    rows = [("t", r, 0, k, f"m{r}", f"Q{10 * r + k}", f"l{k}", None, 0.9 - 0.1 * k, 1) for r in range(6) for k in (1, 2, 3)]
    return spark.createDataFrame([*rows, ("t", 6, 0, 1, "alone", "Q99", "l", "d", 0.2, 1)], SCHEMA)


def test_debate_then_verification(spark):
    context = spark.createDataFrame([("t", r, "red | 5") for r in (0, 1)], "tab_id string, row_id int, context string")
    asked = methods.questions(scored(spark), methods.METHODS["full"], context)
    seen = []

    def model(new):
        rows = new.collect()
        seen.append([r["text"] for r in rows])
        assert all(("Chosen" in r["text"]) == (len(seen) == 2) for r in rows)
        said = {"m0": "QID: Q2", "m1": "QID: Q12", "m2": "QID: Q22", "m3": "no idea", "m4": "Q42!", "m5": "Q51", "alone": "Q99"}
        check = {"m0": "Winning QID: Q3", "m1": "Winning QID: nil", "m2": "it holds", "m4": "Q41", "alone": "Winning QID: NIL"}
        of = lambda t: t.split("\n")[0].removeprefix("Cell: ")
        out = [(r["prompt_hash"], 0, (said if len(seen) == 1 else check).get(of(r["text"]))) for r in rows]
        return spark.createDataFrame([x for x in out if x[2]], prompts.RESPONSES)

    rounds = methods.debate_rounds()
    answers = prompts.converse(asked, rounds, model, keep=lambda df: spark.createDataFrame(df.collect(), prompts.RESPONSES))
    assert len(seen[0]) == 7 and len(seen[1]) == 6 and "Row: red | 5\n" in "".join(seen[0])
    got = {r["row_id"]: (r["qid"], r["source"], r["debate"], r["verify"]) for r in methods.decide_by_debate(asked, answers).collect()}
    assert got == {
        0: ("Q3", "model", "Q2", "Q3"),  # verification overturns the debate
        1: ("Q11", "score", "Q12", None),  # none fits: the first by score
        2: ("Q22", "model", "Q22", "Q22"),
        3: ("Q31", "score", None, None),  # no choice to verify
        4: ("Q41", "model", "Q42", "Q41"),
        5: ("Q51", "model", "Q51", "Q51"),  # no answer to the check
        6: ("Q99", "score", "Q99", None),
    }
    alone = {r["row_id"]: r["qid"] for r in methods.decide_by_debate(asked, answers, verify=False).collect()}
    assert alone == {0: "Q2", 1: "Q12", 2: "Q22", 3: "Q31", 4: "Q42", 5: "Q51", 6: "Q99"}
    again = prompts.converse(asked, rounds, lambda new: spark.createDataFrame([], prompts.RESPONSES).where(F.lit(new.count() > 1)), keep=lambda df: df, known=answers)
    assert again.count() == answers.count()


def test_context_votes(spark):
    method = methods.Method(0.15, 10)
    items = methods.context_questions(methods.questions(scored(spark), method), method)
    assert sorted(r["row_id"] for r in items.collect()) == [0, 1, 2, 3, 4, 5]  # one candidate leaves nothing to ask
    text = {r["row_id"]: r["prompt"] for r in items.collect()}
    said = [(text[0], 0, "Answer: Q2"), (text[0], 1, "maybe Q1, so Answer: Q2"), (text[0], 2, "Answer: Q3"), (text[1], 0, "Answer: NIL"), (text[2], 0, "Q5")]
    got = sorted((r["row_id"], r["choice"], r["votes"]) for r in methods.context_votes(items, responses(spark, said)).collect())
    assert got == [(0, "Q2", 2), (1, "NIL", 1)]
