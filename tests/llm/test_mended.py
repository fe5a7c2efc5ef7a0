"""Cases of single operators: shared doc_ids in training, and rules without the gate on content."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import quality, toxicity


def test_training_takes_one_text_of_a_doc_id(spark):
    rows = [(k, f"word{k % 7} {'awful swine' if k % 3 == 0 else 'kind friend'} end", None) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    again = docs.union(docs).union(docs.select("doc_id", F.concat("text", F.lit(" zzz")).alias("text"), "toxic")).repartition(5)
    one, two = toxicity.train(docs, labels, 40, epochs=2), toxicity.train(again, labels, 40, epochs=2)
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    some = docs.where("doc_id < 3").union(spark.createDataFrame([(None, None, 1)], docs.schema))
    assert sorted(r["doc_id"] for r in toxicity.score(some, one).collect() if r["doc_id"] is not None) == [0, 1, 2]


def test_gate_on_content_can_be_off(spark):
    def copy(k):
        words = [[f"w{i}x{j}" for j in range(12)] for i in range(6)]
        words[k % 6][k // 6 + 2] = f"edit{k}"
        return "\n".join(map(" ".join, words))

    rows = [(k, copy(k), "h") for k in range(40)] + [(100 + k, " ".join(f"t{k}y{j}" for j in range(40)), "h") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.decisions(docs).collect()}
    assert all(kept[k] for k in range(40))  # near copies, whose common lines are no boilerplate
    strict = {r["doc_id"]: r["kept"] for r in quality.decisions(docs, diverse=0).collect()}
    assert not any(strict[k] for k in range(40))
    assert {d for d in strict if d >= 100 and strict[d]} == {d for d in kept if d >= 100 and kept[d]}
