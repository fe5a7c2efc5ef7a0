"""Sinks round trip, checks of sets, and the odd cases of texts for models."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import assembly as asm
from tabloom.sources import sinks


def test_tasks():
    assert asm.tasks(" CPA, cea") == ["cea", "cpa"]
    with pytest.raises(ValueError, match="ctx"):
        asm.tasks("ctx")


def test_disjoint(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",)], "k string")
    with pytest.raises(ValueError, match="y"):
        asm.require_disjoint(a, b, ["k"])
    asm.require_disjoint(a, b.where("false"), ["k"])


def test_alias_target(spark):
    rows = spark.createDataFrame([("Rome", ["rome", "Roma", None, " ", "ROMA", "a", "b", "c", "d", "e"]), (None, ["x"]), ("y", None)], "label string, aliases array<string>")
    assert [r[0] for r in rows.select(asm.alias_target(F.col("label"), F.col("aliases"))).collect()] == ["Rome; Roma; a; b; c; d", "x", "y"]


def test_few_shot(spark):
    rows = spark.createDataFrame([("a -> b; c->d -> e;f",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(asm.few_shot(F.col("t"))).collect()] == [[["a", "b"], ["c", "d -> e"]], None, None]


def test_missing_tables(spark):
    gold = spark.createDataFrame([("t", 0, 0), ("u", 1, 0)], "tab_id string, row_id long, col_id int")
    raw = asm.with_header(spark.createDataFrame([("t", 0, 0, "h", None)], "tab_id string, row_id long, col_id int, header string, value string"))
    found, missing = asm.mentions(gold, raw)
    assert [r.value for r in found.collect()] == ["h"] and [r.tab_id for r in missing.collect()] == ["u"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, ["a", "b"], "train"), ("u", 1, [], "valid")], "tab_id string, row_id int, aliases array<string>, split string")
    sinks.write_training(rows, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t/split=valid").first()["tab_id"] == "u"
    for _ in range(2):
        sinks.append_log(rows.select("tab_id"), f"{tmp_path}/log")
    assert sorted(r["tab_id"] for r in sinks.read_log(spark, f"{tmp_path}/log").collect()) == ["t", "t", "u", "u"]
    with pytest.raises(ValueError, match="xml"):
        sinks.write_tokens(rows, f"{tmp_path}/x", "xml")
    sinks.write_entities(rows, f"{tmp_path}/some")
    assert sorted(r.tab_id for r in sinks.read_entities(spark, f"{tmp_path}/some").collect()) == ["t", "u"]
    assert (tmp_path / "log" / "0-header.csv").read_text() == "tab_id\n"


def test_runs(spark, tmp_path):
    for name, files in (("a/b", sinks.RESULTS), ("c", sinks.RESULTS[:2])):
        (tmp_path / name).mkdir(parents=True)
        for f in files:
            (tmp_path / name / f).write_text("x")
    assert list(sinks.find_runs(spark, str(tmp_path))) == ["a/b"]


def test_prepared(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, "[0]")], "tab_id string, row_id int, col_id int, value string")
    body, last = sinks.prepared(cells)
    assert [r.value for r in body.collect()] == ["a"] and [r.value for r in last.collect()] == ["[0]"]
