"""Two versions of tables at the same places."""

from tabloom.operators import versions

CELLS = "tab_id string, row_id int, col_id int, value string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CELLS)


def test_compare(spark):
    before = frame(spark, [("t", 0, 0, "a"), ("t", 0, 1, "B  c"), ("t", 1, 0, None), ("t", 1, 1, "z"), ("t", 2, 0, "cut"), ("t", 2, 1, " "), ("gone", 0, 0, "g"), (None, 0, 0, "n")])
    after = frame(spark, [("t", 0, 0, "a"), ("t", 0, 1, "b c"), ("t", 0, 2, "new"), ("t", 1, 0, "filled"), ("new", 0, 0, "h"), ("t", 1, 2, "")])
    targets = frame(spark, [("t", 0, 1, ""), ("t", 1, 0, ""), ("t", 1, 0, ""), ("t", 9, 9, "")])
    got = {(r["tab_id"], r["row_id"], r["col_id"]): (r["kind"], r["is_target"]) for r in versions.compare(before, after, targets).collect()}
    assert got == {
        ("t", 0, 0): ("same", False),
        ("t", 0, 1): ("case", True),
        ("t", 0, 2): ("only_after", False),
        ("t", 1, 0): ("real", True),
        ("t", 1, 1): ("real", False),  # the later version is wide enough, its row only lacks the cell
        ("t", 2, 0): ("only_before", False),
        ("gone", 0, 0): ("only_before", False),
        ("new", 0, 0): ("only_after", False),
    }
    shapes = {r["tab_id"]: tuple(r)[1:] for r in versions.shapes(before, after).collect()}
    assert shapes == {"t": ("both", 2, 2, 3, 2, 2, 3), "gone": ("before", 0, 0, 1, 1, 0, 0), "new": ("after", 0, 0, 0, 0, 1, 1)}
    t = {r["tab_id"]: r for r in versions.tally(versions.compare(before, after, targets), "tab_id").collect()}["t"]
    assert (t["n"], t["n_same"], t["n_case"], t["n_real"], t["n_only_before"], t["n_only_after"], t["target_n"], t["target_n_real"]) == (4, 1, 1, 2, 1, 1, 2, 1)
    moved = {(r["row_id"], r["col_id"]): r["distance"] for r in versions.changes(versions.compare(before, after)).collect()}
    assert moved == {(0, 1): 1, (1, 0): 6, (1, 1): 1}


def test_empty_versions(spark):
    one = frame(spark, [("t", 0, 0, "a")])
    assert [r["kind"] for r in versions.compare(one, one.limit(0)).collect()] == ["only_before"]
    assert versions.compare(one.limit(0), one.limit(0)).count() == 0
