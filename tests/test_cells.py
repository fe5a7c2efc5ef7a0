"""Candidates in an array of their cell: the same results as in rows, and no shuffle of candidates."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import methods
from tabloom.operators import ranking as rk
from tabloom.plans import catalog, standin
from tabloom.plans.standin import candidates, features, found

BY_CELL = ["accuracy_bins", "best_run", "candidate_misses", "candidate_recall", "candidate_recall_detail", "cea_cta_bins", "coherence_of_all_cells", "conditional_accuracy", "cta_from_selection", "example_status", "first_values", "gold_status", "llm_case", "margin_sweep", "placeholders", "rank_cell", "score_candidates", "type_merge", "type_support", "weight_grid"]


@pytest.mark.parametrize("name", BY_CELL)
def test_no_shuffle_of_candidates(spark, small_dir, name):
    plan = catalog.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "l_orderkey" not in line]
    assert not [line for line in shuffled if "row_id" in line]


def rows(df):
    return sorted(map(str, df.collect()))


def test_as_rows(spark, small_dir):
    c, f = candidates(spark, small_dir).where("tab_id % 7 = 0"), features(spark, small_dir).where("tab_id % 7 = 0")
    names = ["tab_id", "row_id", "col_id", "qid", "score", "rank", "gap"]
    by_rows, cells = rk.ranked(rk.scored(c)), rk.ranked_cells(f)
    assert rows(by_rows.select(*names)) == rows(cells.select("tab_id", "row_id", "col_id", F.inline("of")).select(*names))
    one = [*rk.CELL, "qid", "score", "gap"]
    assert rows(by_rows.where("rank = 1").select(*one)) == rows(rk.best(f, ["qid"]).select(*one))
    shares = ["tab_id", "prop", "type", "n_cells", "pct"]
    assert rows(rk.support(c).select(*shares)) == rows(rk.support(found(spark, small_dir).where("tab_id % 7 = 0")).select(*shares))
    assert rows(rk.support_of_selection(c, by_rows.where("rank = 1")).select(*shares)) == rows(rk.support_of_first(cells).select(*shares))
    m = methods.METHODS["limited"]
    assert rows(methods.shortlists(by_rows, m)) == rows(methods.shortlists(cells, m))


@pytest.mark.parametrize("name", ["cea_two_rounds", "cea_context_votes", "context_tiebreak"])
def test_neither_texts_nor_candidates_are_shuffled(spark, small_dir, name, monkeypatch):
    out = catalog.QUERIES[name](spark, small_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "prompt_hash" not in plan and "Window" not in plan
    assert [line for line in plan.splitlines() if "Exchange hashpartitioning(tab_id" in line and "col_id" not in line] == []
    by_number = rows(out)
    monkeypatch.setattr(standin, "few", lambda *_: False)
    assert rows(catalog.QUERIES[name](spark, small_dir)) == by_number
