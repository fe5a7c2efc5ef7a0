"""Plans whose work grows with the input alone, and their results on odd rows."""

from pyspark.sql import functions as F

from tabloom.operators import evaluation as ev
from tabloom.operators import lookup, prep
from tabloom.operators import ranking as rk
from tabloom.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numeric_match_compares_different_prices(spark, tmp_path):
    rows = [("b", 1, 10.0)] * 2000 + [("b", 1, 10.4)] * 1000 + [("b", 1, None), ("b", 2, 99.0), ("c", 1, 5.0)]
    spark.createDataFrame(rows, "p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["numeric_match"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("b", 3001**2 + 1, 3000**2 + 1), ("c", 1, 1)]
    plan = plan_of(out)
    assert "p_retailprice" in plan[plan.index("Join") :].split("HashAggregate(keys=[", 1)[1].split("]")[0]


def test_table_windows_shuffle_a_row_once(spark):
    rows = [(t, k, f"{t}{k}") for t, n in (("a", 25), ("b", 20), ("c", 3)) for k in range(n)] + [("d", 7, "x"), ("d", 0, None), (None, 0, "y"), ("e", None, "z")]
    out = prep.table_windows(spark.createDataFrame(rows, "tab_id string, row_id int, text string"), 20)
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.tab_id, r.row_id): (r.n_rows, r.first_row, r.context) for r in out.collect()}
    assert len(got) == 50 and got["a", 24] == (11, 14, "|".join(f"a{k}" for k in range(14, 25))) and got["a", 3] == (20, 0, "|".join(f"a{k}" for k in range(20)))
    assert got["b", 19] == (20, 0, "|".join(f"b{k}" for k in range(20))) and got["c", 2] == (3, 0, "c0|c1|c2") and got["d", 7] == (2, 0, "x")


def test_bootstrap_draws_are_no_rows(spark):
    rows = [(r, c, (c * 7 + k) % 50, 50 + c % 3) for c in range(300) for k, r in enumerate("abc") if (c + k) % 5]
    sums = spark.createDataFrame(rows, "run string, cluster long, hits long, n long")
    made = ev.bootstrap(sums, 40, ["a", "b", "c"], seed=3)
    assert "MapInArrow" in plan_of(made) and plan_of(ev.deltas(made, "a")).count("MapInArrow") == 1
    pairs = spark.range(40 * 300).selectExpr("id div 300 AS rep", "id % 300 AS j")
    slow = ev.draws(pairs, 300, 3).join(sums, F.col("k") == F.col("cluster")).groupBy("run", "rep").agg((F.sum("hits") / F.sum("n")).alias("rate"))
    want = sorted(map(tuple, slow.collect()))
    assert sorted(map(tuple, made.collect())) == want
    held = ev.MOST_CLUSTERS, ev.BLOCK, ev.SLICE
    try:
        ev.MOST_CLUSTERS, ev.BLOCK, ev.SLICE = 10, 64, 100
        assert sorted(map(tuple, ev.bootstrap(sums, 40, ["a", "b", "c"], seed=3).collect())) == want
    finally:
        ev.MOST_CLUSTERS, ev.BLOCK, ev.SLICE = held


def test_search_of_repeated_names_looks_up_each_once(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(lookup, "_by_rare_words", lambda terms, posts, limit, of=lookup._by_rare_words: looked.append((terms.count(), posts.count())) or of(terms, posts, limit))
    texts = [f"{a} {b} {c}" for a in "pqr" for b in "stu" for c in "vwx"]
    names = spark.createDataFrame([(k, texts[k * 7 % 27] if k % 2 else texts[k * 7 % 27].upper()) for k in range(540)], "id long, name string")
    some = [*texts, "v s p", "p p s", "p", "p s nothing", "p nothing"]
    queries = spark.createDataFrame([(t,) for t in some], "term string")
    for limit, unsettled in ((5, 0), (500, 31)):
        want = sorted(map(tuple, lookup.search_words(queries, names, limit).collect()))
        assert sorted(map(tuple, lookup.search_rare_words(queries, names, limit, 2).collect())) == want
        assert looked == ([] if not unsettled else [(90, 81)])


def test_candidates_are_found_once_a_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rk, "LIST_PART", 3)
    customers = [(k, k % 4) for k in range(60)] + [(7, 1), (7, 1), (30, 3), (5, None), (None, 2), (61, None)]
    suppliers = [(k, k % 5) for k in range(90)] + [(8, 1), (8, 3), (9, None), (None, 2)]
    c, s = spark.createDataFrame(customers, "c_custkey long, c_nationkey int"), spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int")
    c.write.parquet(str(tmp_path / "customer.parquet"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    cols = lambda gen: [F.col("c_custkey").alias("tab_id"), F.lit(0).alias("row_id"), F.lit(0).alias("col_id"), F.lit(gen).alias("gen"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("qid")]
    rows = c.join(s, c.c_nationkey == s.s_nationkey).select(cols(1)).unionByName(c.join(s, c.c_custkey % 25 == s.s_suppkey % 25).select(cols(2)))
    for name, cap in (("candidate_dedup", 0), ("candidate_cap", 5)):
        out, want = catalog.QUERIES[name](spark, str(tmp_path)), rk.dedup(rows, cap).select("tab_id", "gen", "qid", "ord")
        assert "Window" not in plan_of(out) and "tab_id" not in "".join(line for line in plan_of(out).splitlines() if "Exchange" in line)
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.dtypes == want.dtypes
