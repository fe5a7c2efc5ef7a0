"""The audit against the filters applied one document at a time, and against SQL."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tabloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n int, mask int, good boolean, least string, part string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = (text or "").encode().split()
    n = len(text or "")
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text or "") > 3 * n,
        "D": any(c in "#$%&*|" for c in text or ""),
    }


def simulated(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, lang in docs:
        rows.append((d, lang or "", fails(text) | {"E": d is not None and d > least[text or ""]}))
    out = {}
    for part in {lang for _, lang, _ in rows}:
        of = [(d, f) for d, lang, f in rows if lang == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = of
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if f[letter]]
                left = [(d, f) for d, f in left if not f[letter]]
                removed_by[letter] += len(gone)
                failing = sum(f[letter] for _, f in of)
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in of)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def of(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in frame.collect()}


def test_cases(spark):
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", long, long, long.upper(), "same " * 300, "same " * 300, "a # b", long + " $", "ÄÖ" * 500, long + " 50% OFF " + "x" * 2000]
    docs = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts)]
    docs += [docs[2], docs[2], (3, long, "de"), (None, long, "en"), (None, "", None), (12, long, "en"), (1, long, "de")]
    labels = [(2, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (12, 1, 1), (5, None, 1)]
    frame = spark.createDataFrame([(d, t, g, None, 1, 2, True, "x", "p") for d, t, g in docs], DOCS)
    got = of(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)))
    assert got == simulated(docs, labels)
    assert filter_audit.audit(frame.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert len(of(filter_audit.audit(frame, spark.createDataFrame([], LABELS)))) == 3 * 600


def test_sql(spark, small_dir):
    ours = filter_audit.query(spark, small_dir).toPandas()
    with duckdb.connect() as con:
        for t in ("documents", "labels"):
            con.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
        theirs = con.sql(filter_audit.SQL).df()
    key = ["part", "filter_order", "step"]
    theirs = theirs[list(ours.columns)]
    assert ours.sort_values(key).values.tolist() == theirs.sort_values(key).values.tolist()
    assert dict(ours.dtypes)["step"] == dict(theirs.dtypes)["step"]


def test_survivors(spark):
    each = spark.createDataFrame([("p", 0, True, False, 5), ("p", 1, True, True, 3), ("p", 3, False, False, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    joint = filter_audit.joint_failures(each, 2)
    got = joint.select("failed", filter_audit.survivors("failed", 2).alias("left"), filter_audit.unique_failures("good", 2).alias("alone"), filter_audit.shapley("failed", 2).alias("value"), F.col("toxic")).first()
    assert list(got["failed"]) == [10, 5, 2, 2] and list(got["left"]) == [10, 5, 8, 5]
    assert list(got["alone"]) == [3, 0] and list(got["value"]) == [8, 2] and list(got["toxic"]) == [3, 3, 0, 0]
