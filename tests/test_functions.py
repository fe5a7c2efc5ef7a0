from pyspark.sql import functions as F

from tabloom.functions import similarity as sim
from tabloom.functions import text as tx
from tabloom.operators import assembly as asm
from tabloom.operators import evaluation as ev
from tabloom.operators import ranking as rk
from tabloom.sources import tables
from tabloom.streaming.clean import clean_stream


def values(spark, xs, f):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string")
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_clean(spark):
    given = ["<b>x</b>", "a<i\nb>c", "<>", "a 　b\t", '"""q"""', "**b**", '"""', None, "a\x1cb"]
    assert values(spark, given, tx.clean) == ["x", "ac", "<>", "a b", "q", "b", "", None, "a b"]


def test_similarity(spark):
    rows = spark.createDataFrame([("", ""), ("Ab", "aB"), ("abcd", "abxd"), ("a b", "b c")], "a string, b string")
    got = rows.select(sim.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), sim.token_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [(r.l, round(r.j, 4)) for r in got] == [(0.0, 0.0), (1.0, 1.0), (0.75, 0.0), (1 / 3, 0.3333)]


def test_numbers(spark):
    assert values(spark, ["1,234.5", "1e5", "", None, "-3"], sim.to_number) == [1234.5, 1e5, None, None, -3.0]
    assert values(spark, ["12", "1,234.5", "1e5", "x", "12\n"], sim.is_numeric) == [True, True, False, False, True]


def test_ids(spark):
    given = ["Q57 or Q5", "answer: Q7. Q9", "none", "", "final Q8", "qid - NIL but Q5", "no match", "answer: Q99, or else Q5"]
    assert values(spark, given, tx.final_answer) == ["Q5", "Q7", None, None, "Q8", "NIL", "NIL", "Q99"]
    of = F.array(F.lit("Q5"), F.lit("Q7"))
    assert values(spark, given, lambda x: tx.final_answer(x, of)) == ["Q5", "Q7", None, None, None, "NIL", "NIL", "Q5"]
    assert values(spark, given, lambda x: tx.final_answer(x, of, allow_nil=False)) == ["Q5", "Q7", None, None, None, None, None, "Q5"]
    assert values(spark, ["NIL", "I don't know", "Q5", "none of it", "None of them", "not among the candidates"], tx.is_nil) == [True, True, False, False, True, True]


def test_queries_of_names(spark):
    assert values(spark, ['"Rome".', "**Oslo** .", "etc..", None], tx.clean_query) == ["Rome", "Oslo", "etc..", None]
    assert values(spark, ["FINAL: 1. a\nb; 2) c"], tx.llm_terms) == [["a b", "c"]]
    got = values(spark, ['The "Big" (old) Town (north)', "Paris,France", "z - b - c", "*x* / y", "the sea", "one", ""], tx.fuzzy_variants)
    assert got == [
        ["The Big (old) Town (north)", "The Big Town", "old", "north", "Big (old) Town (north)", "The Big"],
        ["France Paris", "Paris"],
        ["z", "b", "c", "z -"],
        ["x / y", "x", "y", "x /"],
        ["sea"],
        [],
        [],
    ]


def test_vote(spark):
    from tabloom.operators import methods

    rows = spark.createDataFrame([(1, 0, 0, "Rome"), (1, 0, 1, "ROME"), (1, 1, 0, "Oslo"), (1, 1, 1, "oslo"), (1, 2, 0, "OSLO"), (1, 2, 1, "Bern"), (2, 0, 0, None)], "k int, sample int, pos int, term string")
    assert [tuple(r) for r in methods.vote(rows, ["k"], 2).orderBy("rank").collect()] == [(1, "Oslo", 2, 1), (1, "Rome", 1, 2)]


def test_properties_by_kind(spark):
    subjects = spark.createDataFrame([(1, 0, "Q1"), (1, 1, "Q1")], "tab_id int, row_id int, qid string")
    objects = spark.createDataFrame([(1, 0, True, "Q5", "1990"), (1, 1, False, "Q5", "1990")], "tab_id int, row_id int, is_entity boolean, qid string, value string")
    claims = spark.createDataFrame([("Q1", "P1", "entity", "Q5", None, None, None), ("Q1", "P2", "quantity", None, 1991.0, None, None), ("Q1", "P3", "time", None, None, "+1990-01-01", None), ("Q1", "P4", "string", None, None, None, " 1990 "), ("Q1", "P5", "string", None, None, None, "")], "qid string, pid string, vtype string, v_entity string, v_num double, v_time string, v_str string")
    got = sorted((r.row_id, r.pid) for r in rk.matching_properties(subjects, objects, claims).collect())
    assert got == [(0, "P1"), (1, "P2"), (1, "P3"), (1, "P4")]


def test_placeholders(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, 0, " ")], "tab_id int, row_id int, col_id int, mention string")
    found = spark.createDataFrame([(1, 0, 0, "a", "Q1", "A", 1, ["T"], [])], "tab_id int, row_id int, col_id int, mention string, qid string, label string, quality int, p31 array<string>, p279 array<string>")
    got = asm.with_placeholders(cells, found)
    assert sorted((r.row_id, r.qid) for r in got.collect()) == [(0, "Q1"), (1, "")]
    assert [(r.type, r.pct) for r in rk.support(got).collect()] == [("T", 0.5)]
    assert asm.with_placeholders(cells, found, blank=True).count() == 3 and asm.with_placeholders(cells, found.limit(0)).count() == 2


def test_selection_shares(spark):
    rows = [(1, r, 0, 1, q, [t], ["S"]) for r, q, t in ((0, "Q1", "A"), (0, "Q2", "B"), (1, "Q3", "B"))] + [(2, 0, 0, 1, "Q4", ["C"], None)]
    c = spark.createDataFrame(rows, "tab_id int, row_id int, col_id int, ord int, qid string, p31 array<string>, p279 array<string>")
    chosen = spark.createDataFrame([(1, 0, 0, "Q1")], "tab_id int, row_id int, col_id int, qid string")
    got = sorted((r.tab_id, r.prop, r.type, r.pct) for r in rk.support_of_selection(c, chosen).collect())
    assert got == [(1, "p279", "S", 1.0), (1, "p31", "A", 1.0), (2, "p31", "C", 1.0)]
    assert rk.support(c.limit(0)).count() == 0


def test_small_and_random(spark):
    from tabloom.operators import prep

    sizes = spark.createDataFrame([(k, k % 10) for k in range(100)], "tab_id long, n int")
    got = prep.small_and_random(sizes, n_small=5, most=3, n_random=90, seed=1).collect()
    assert sum(r.part == "small" for r in got) == 5 and len({r.tab_id for r in got}) == 95
    assert any(r.n <= 3 for r in got if r.part == "random") and all(r.n <= 3 for r in got if r.part == "small")


def test_example_status(spark):
    from tabloom.operators import prep

    cells = spark.createDataFrame([(k, 0, g) for k, g in enumerate(["Q1", "Q1", "Q1", "Q9", "NIL", "Q1", "Q1"])], "tab_id int, row_id int, gold string")
    rows = []
    for k, gap, n in ((1, 0.5, 2), (2, 0.01, 2), (3, 0.01, 2), (4, 0.01, 2), (5, 0.01, 2), (6, None, 1)):
        rows += [(k, 0, f"Q{j + 1}" if k != 5 else "Q1", {3: "Q9", 4: "NIL"}.get(k, "Q1"), j + 1, gap if j == 0 else None, 0.9) for j in range(n)]
    ranked = spark.createDataFrame(rows, "tab_id int, row_id int, qid string, gold string, rank int, gap double, score double")
    of = lambda builder, **more: {r.tab_id: r.status for r in prep.example_status(cells, ranked, builder, 0.05, 5, **more).collect()}
    assert of("limited") == {0: "not_ambiguous", 1: "not_gated", 2: "kept", 3: "gold_absent", 4: "kept_nil", 5: "trivial", 6: "not_ambiguous"}
    assert of("context")[0] == "no_candidates" and of("context")[6] == "not_gated"
    assert of("limited", review=0.95)[1] == "kept" and of("limited", switched=cells.where("tab_id = 2"))[2] == "resolved_by_tiebreak"


def test_bootstrap_draws(spark):
    """The standard error is that of independent draws, and both ways to sum draws agree."""
    import numpy as np

    rng = np.random.default_rng(0)
    hits = rng.normal(500, 100, 200).astype(int).tolist()
    sums = spark.createDataFrame([("a", k, h, 1000) for k, h in enumerate(hits)], "run string, cluster long, hits long, n long")
    rates = [r.rate for r in ev.bootstrap(sums, 4000, ["a"]).collect()]
    x = np.array(hits) / 1000
    assert abs(np.std(rates) / (x.std() / len(x) ** 0.5) - 1) < 0.03 and abs(np.mean(rates) - x.mean()) < 0.001
    few = sorted((r.rep, r.rate) for r in ev.bootstrap(sums, 50, ["a"]).collect())
    most, ev.MOST_CLUSTERS = ev.MOST_CLUSTERS, 10
    try:
        assert sorted((r.rep, r.rate) for r in ev.bootstrap(sums, 50, ["a"]).collect()) == few
    finally:
        ev.MOST_CLUSTERS = most
    assert ev.bootstrap(sums.limit(0), 3, ["a"]).count() == 0


def drawn(reps, m, seed=0):
    """The draws in numpy: an array of m numbers for each replicate."""
    import numpy as np

    def mixed(x):
        for _ in range(2):
            x = ((x >> np.uint64(16)) ^ x) * np.uint64(73244475) & np.uint64(0xFFFFFFFF)
        return (x >> np.uint64(16)) ^ x

    reps, j = reps.astype(np.uint64)[:, None], np.arange(m, dtype=np.uint64)[None, :]
    one, two = (mixed((reps * np.uint64(odd) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)) for odd in (40503, 60493))
    return mixed(mixed(one ^ j) + two & np.uint64(0xFFFFFFFF)) % np.uint64(m)


def test_no_two_replicates_are_alike(spark):
    import numpy as np

    some = np.array([0, 1, 23980, 32668, 42774, 49999])
    rows = spark.createDataFrame([(int(r), j) for r in some for j in range(300)], "rep long, j long")
    got = sorted(tuple(r) for r in ev.draws(rows, 300, 7).collect())
    assert got == sorted((int(r), int(k)) for r, of in zip(some, drawn(some, 300, 7), strict=True) for k in of)
    # a sample is told by the sum of a random number for each cluster that is drawn
    rng = np.random.default_rng(0)
    for m, reps, at_once in ((4096, 50_000, 500), (65_536, 2000, 100)):
        weight = rng.integers(0, 1 << 62, m, np.uint64)
        sums = np.concatenate([weight[drawn(np.arange(k, k + at_once), m)].sum(axis=1) for k in range(0, reps, at_once)])
        assert len(np.unique(sums)) == reps
    weight = rng.integers(0, 1 << 62, 65_536, np.uint64)
    assert len(np.unique(weight[drawn(some, 65_536)].sum(axis=1))) == len(some)


def test_standard_error_of_many_clusters():
    import numpy as np

    rng = np.random.default_rng(1)
    for m, reps in ((200, 20_000), (65_536, 3000)):
        x = rng.normal(0.5, 0.1, m)
        means = np.concatenate([x[drawn(np.arange(k, k + 100), m)].mean(axis=1) for k in range(0, reps, 100)])
        assert abs(np.std(means) / (x.std() / m**0.5) - 1) < 0.03


def test_exact_p(spark):
    rows = spark.createDataFrame([(5, 5), (0, 0), (1, 3), (40, 90)], "b long, c long")
    p = [r.p for r in rows.select(ev.exact_p(F.col("b"), F.col("c")).alias("p")).collect()]
    assert abs(p[0] - 1.24609375) < 1e-9 and p[1] == 1.0 and abs(p[2] - 0.625) < 1e-9 and 0 < p[3] < 1e-4


def test_type_fallback_and_ties(spark):
    p31 = spark.createDataFrame([(1, 0, "Qb", 0.5), (1, 0, "Qa", 0.5)], "tab_id int, col_id int, type string, pct double")
    p279 = spark.createDataFrame([(1, 0, "Qz", 1.0), (2, 0, "Qy", 0.4)], p31.schema)
    got = {r.tab_id: (r.type, r.uncertain) for r in rk.column_types(p31, p279).collect()}
    assert got == {1: ("Qa", True), 2: ("Qy", False)}


def test_margin_zero_never_asks(spark, small_dir):
    from tabloom.plans.standin import candidates

    tops = rk.top(rk.scored(candidates(spark, small_dir)))
    assert tops.where(rk.gated(0.0)).count() == 0


def test_ragged_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('col0,col1\n1,"x, ""y"""\nNA,\n')
    (tmp_path / "b.csv").write_text("col0,col1,col2\n9.008999999999999,NULL,z\n")
    got = {(r.tab_id, r.row_id, r.col_id): r.value for r in tables.read_tables(spark, str(tmp_path)).collect()}
    assert got[("a", 0, 1)] == 'x, "y"' and got[("a", 1, 0)] is None and got[("b", 0, 0)] == "9.008999999999999" and got[("b", 0, 2)] == "z" and len(got) == 7
    assert tables.read_headerless(spark, str(tmp_path / "none.csv"), tables.TARGETS["cea"]).count() == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("<b>x</b>",)], "value string").write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark, str(tmp_path / "in"), "value string").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert [r.cleaned for r in spark.sql("select cleaned from cleaned").collect()] == ["x"]
