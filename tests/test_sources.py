"""Files and folders: what can't be read is kept apart, what is done is left alone, what is written is whole."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.sources import files, folders, sinks, tables


@pytest.fixture
def folder(tmp_path):
    good = {"a.csv": b"x,y\n1,\"two, 2\"\n\n3\n", "b.csv": "﻿name\né\n".encode(), "head.csv": b"only,header\n", "quote.csv": b'x\n"a"b\n'}
    bad = {"enc.csv": b"x\n\xff\xfe\n", "open.csv": b'x\n"never closed\n1\n', "none.csv": b"", "blank.csv": b" \n\n"}
    for name, content in {**good, **bad, "a_candidates.csv": b"z\n1\n", "notes.txt": b"no table"}.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_files_that_cant_be_read(spark, folder):
    listed = folders.listing(spark, folder, without=folders.CANDIDATES)
    (rows,) = folders.read_listed(spark, listed)
    cells, errors = tables.split_errors(rows)
    assert {(r["tab_id"], r["error"]) for r in errors.collect()} == {("enc", "bad encoding"), ("open", "unbalanced quotes"), ("none", "empty file"), ("blank", "empty file")}
    got = {(r["tab_id"], r["row_id"], r["col_id"]): (r["header"], r["value"]) for r in cells.collect()}
    assert got == {("a", 0, 0): ("x", "1"), ("a", 0, 1): ("y", "two, 2"), ("a", 1, 0): ("x", "3"), ("b", 0, 0): ("name", "é"), ("quote", 0, 0): ("x", "ab")}
    assert sorted(r["tab_id"] for r in tables.read_tables(spark, folder).select("tab_id").distinct().collect()) == ["a", "a_candidates", "b", "quote"]


def test_only_what_isnt_done_is_read(spark, folder, tmp_path):
    out = tmp_path / "out"
    inputs = folders.listing(spark, folder, without=folders.CANDIDATES)
    assert inputs.count() == 8
    done = lambda: folders.listing(spark, str(out), folders.CANDIDATES)
    assert {r["state"] for r in folders.states(inputs, done()).collect()} == {"new"}
    out.mkdir()
    now = time.time()
    for name, content, age in (("a", b"x", 5), ("b", b"", 5), ("quote", b"y", -900)):
        (out / f"{name}_candidates.csv").write_bytes(content)
        os.utime(out / f"{name}_candidates.csv", (now + age, now + age))
    states = {r["tab_id"]: r["state"] for r in folders.states(inputs, done()).collect()}
    assert states == {"a": "done", "b": "broken", "quote": "stale", **dict.fromkeys(("head", "enc", "open", "none", "blank"), "new")}
    batches = list(folders.read_listed(spark, folders.pending(inputs, done()).where("tab_id in ('b', 'quote')"), most=1))
    assert len(batches) == 2 and [[r["tab_id"] for r in b.collect()] for b in batches] == [["b"], ["quote"]]
    assert list(folders.read_listed(spark, inputs.where("tab_id = 'a'").transform(lambda df: folders.pending(df, done())))) == []
    assert folders.listing(spark, f"{folder}/nowhere").count() == 0


def test_candidates_without_a_prepared_table(spark):
    one = lambda *rows: spark.createDataFrame(rows, "tab_id string, path string, length long")
    got = folders.paired(one(("a", "ca", 5), ("b", "cb", 5), ("c", "cc", 0), ("d", "cd", 5)), one(("a", "pa", 9), ("a", "pz", 9), ("c", "pc", 9), ("d", "pd", 0), ("e", "pe", 9)))
    assert {(r["tab_id"], r["prepared"], r["reason"]) for r in got.collect()} == {("a", "pa", None), ("b", None, "no prepared table"), ("c", "pc", "no candidates"), ("d", "pd", "the prepared table is empty")}


CANDIDATES = "tab_id string, row_id int, col_id int, ord int, mention string, label string, qid string, quality int, description string, aliases array<string>, p31 array<string>, p279 array<string>, sitelink string"


def test_candidates_there_and_back(spark, tmp_path):
    rows = [
        ("t a", 1, 0, 1, "m", 'say "hi", you', "Q1", 1, "two\nlines", ["a", "b"], ["Q5"], [], ""),
        ("t a", 0, 0, 2, "m", "l", "Q3", 0, "", [], [], ["Q6", "Q7"], "S"),
        ("t a", 0, 0, 1, "m", "l", "Q2", 3, "é", [], [], [], ""),
        ("u=v %", 0, 1, 1, " ", "l", "", 99, "d", [], [], [], ""),
    ]
    frame = spark.createDataFrame(rows, CANDIDATES)
    assert sinks.write_candidates(frame, str(tmp_path)) == 2
    assert files.names(spark, str(tmp_path)) == ["t a_candidates.csv", "u=v %_candidates.csv"]
    assert (tmp_path / "t a_candidates.csv").read_text().startswith("data,candidates,QID,row,columns,quality,description,aliases,P31,P279,sitelink\nm,l,Q2,0,0,3,")
    back = tables.read_candidates(spark, str(tmp_path)).select(*frame.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))
    assert sinks.write_candidates(frame.where("tab_id = 't a' and ord = 1").drop("ord", "aliases"), str(tmp_path)) == 1
    assert sorted((r["tab_id"], r["qid"], r["aliases"]) for r in tables.read_candidates(spark, str(tmp_path)).collect()) == [("t a", "Q1", []), ("t a", "Q2", []), ("u=v %", "", [])]


def test_submission_is_one_file(spark, tmp_path):
    rows = spark.createDataFrame([("t", r % 7, r // 7, "NIL" if r == 3 else f"Q{r}") for r in range(40)], "tab_id string, row_id int, col_id int, qid string").repartition(5)
    made = tables.submission(rows, "cea")
    sinks.write_submission(made, str(tmp_path), "cea")
    lines = (tmp_path / "cea.csv").read_text().splitlines()
    assert len(lines) == 40 and lines[0] == "t,1,0,http://www.wikidata.org/entity/Q0" and "t,4,0,NIL" in lines
    back = tables.read_text(spark, str(tmp_path / "cea.csv"), tables.GOLD["cea"])
    assert sorted(map(tuple, back.collect())) == sorted((r[0], str(r[1]), str(r[2]), r[3]) for r in made.collect())
    sinks.write_submission(made, str(tmp_path), "cea", nil=False)
    assert len((tmp_path / "cea.csv").read_text().splitlines()) == 39
    sinks.write_submission(made.limit(0), str(tmp_path), "cta")
    assert (tmp_path / "cta.csv").read_text() == ""
    broken = made.withColumn("qid", F.when(F.col("row_id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("qid")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_submission(broken, str(tmp_path), "cea")
    assert len((tmp_path / "cea.csv").read_text().splitlines()) == 39  # the old file is whole
    assert sorted(os.listdir(tmp_path)) == [".cea.csv.crc", ".cta.csv.crc", "cea.csv", "cta.csv"]


def test_copies(spark, folder, tmp_path):
    ids = spark.createDataFrame([("a",), ("quote",), ("a",), (None,)], "tab_id string")
    assert sinks.copy_tables(tables.read_tables(spark, folder), ids, f"{tmp_path}/copy") == 2
    assert (tmp_path / "copy" / "a.csv").read_text() == 'x,y\n1,"two, 2"\n3\n'
    (tmp_path / "gold.txt").write_text('a,1,0,Q1\nb,2,0,Q2\n"a",3,0,"Q3, Q4"\naa,4,0,Q5\n')
    sinks.copy_rows(spark, str(tmp_path / "gold.txt"), f"{tmp_path}/some/gold.csv", ids)
    assert (tmp_path / "some" / "gold.csv").read_text() == 'a,1,0,Q1\n"a",3,0,"Q3, Q4"\n'


def test_targets_and_headers(spark):
    cells = spark.createDataFrame([("t", 0, 0, "h", "a"), ("t", 0, 1, "h", "b"), ("t", 1, 0, "h", "c")], "tab_id string, row_id int, col_id int, header string, value string")
    cea = spark.createDataFrame([("t", 1, 1), ("t", 1, 0), ("t", 0, 0), ("u", 1, 0)], tables.TARGETS["cea"])
    got = {r["row_id"]: r["targets"] for r in tables.attach_targets(cells, cea).collect()}
    assert got == {0: [0, 1], 1: []}
    values = spark.createDataFrame([("[0, 2]",), ("[]",), ("[1",), (None,), ("x",)], "v string")
    assert [r[0] for r in values.select(tables.parse_targets(F.col("v"))).collect()] == [[0, 2], [], None, None, None]


def test_gold_and_hierarchy(spark, tmp_path):
    uri = "http://www.wikidata.org/entity/"
    rows = [("t", "1", "0", f"{uri}Q5 {uri}Q6"), ("t", "2", "1", "Q7"), ("t", "0", "0", "Q8"), ("t", "x", "0", "Q9"), ("t", "3", "0", "NIL"), ("t", "4", "0", None), ("t", "5", "0", f"{uri}P31")]
    gold = spark.createDataFrame(rows, tables.GOLD["cea"])
    got = lambda **how: sorted((r["row_id"], r["col_id"], r["qid"]) for r in tables.gold_cells(gold, **how).collect())
    assert got() == [(0, 0, "Q5"), (1, 1, "Q7")]
    assert got(nil="NIL", row_offset=0) == [(0, 0, "Q8"), (1, 0, "Q5"), (2, 1, "Q7"), (3, 0, "NIL"), (4, 0, "NIL"), (5, 0, "NIL")]
    (tmp_path / "up.json").write_text('{"A": {"B": 1,\n "C": 2}, "D": {}}')
    (tmp_path / "down.json").write_text('{"A": {"E": 1}}')
    found = tables.read_hierarchy(spark, str(tmp_path / "up.json"), str(tmp_path / "down.json"))
    assert sorted(map(tuple, found.collect())) == [("A", "B", "ancestor", 1), ("A", "C", "ancestor", 2), ("A", "E", "descendant", 1)]


def test_many_files_are_parsed_in_few_batches(monkeypatch):
    contents = [b"a,b\n1,2,3\n\n4\n", b"x\n\xff", b'x\n"open\n1', None, b'x\n"a"b\n', b"only,head\n", "﻿é\nü\n".encode()] * 300
    paths = [f"in/{k}.csv" for k in range(len(contents))]
    batch = pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])
    out = list(tables._parsed(iter([batch, batch.slice(0, 0)])))
    assert len(out) == 1
    got = [(int(r["tab_id"]), *list(r.values())[1:]) for r in out[0].to_pylist()]
    one = [[(0, 0, "a", "1", None), (0, 1, "b", "2", None), (0, 2, None, "3", None), (1, 0, "a", "4", None)], [(None, None, None, None, "bad encoding")], [(None, None, None, None, "unbalanced quotes")], [(None, None, None, None, "empty file")], [(0, 0, "x", "ab", None)], [], [(0, 0, "é", "ü", None)]]
    assert got == [(k, *cell) for k in range(len(contents)) for cell in one[k % 7]]
    monkeypatch.setattr(tables, "BATCH_CELLS", 50)
    parts = list(tables._parsed(iter([batch])))
    assert len(parts) > 20 and max(p.num_rows for p in parts) < 55 and [r for p in parts for r in p.to_pylist()] == out[0].to_pylist()
