"""Ranks and quantiles over ranges, against sorting everything."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabloom.operators import order, prep


def test_running(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 3000), "v": rng.integers(0, 500, 3000), "w": rng.integers(0, 9, 3000), "i": np.arange(3000)})
    frame.loc[frame.k == 3, "k"] = 0  # one key has half of the rows
    rows = spark.createDataFrame(frame).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    got = order.running(rows, ["v", "i"], ("k",), "w").toPandas()
    got["k"] = got.k.fillna(0)
    want = frame.sort_values(["v", "i"])
    want["before"] = want.groupby("k").w.cumsum() - want.w
    both = got.merge(want, on="i")
    assert len(both) == 3000 and (both.before_x == both.before_y).all()
    whole = order.running(rows, ["v", "i"]).toPandas().sort_values(["v", "i"])
    assert whole.before.tolist() == list(range(3000))
    assert order.running(rows.limit(0), ["v"]).count() == 0


def test_first_rows(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(500)] + [(None, 500)], "v int, i int").repartition(6)
    got = sorted((r["v"] is not None, r["v"] or 0, r["i"]) for r in order.first_rows(rows, 100, [F.col("v")], "i").collect())
    want = sorted([(True, k % 7, k) for k in range(500)] + [(False, 0, 500)])[:100]
    assert got == want
    assert order.first_rows(rows, 0, [F.col("v")], "i").count() == 0 and order.first_rows(rows, 900, [F.col("v")], "i").count() == 501
    assert prep.most_examples(rows, 3, "i").count() == 3 and prep.most_examples(rows, None, "i").count() == 501


def test_ranks_and_correlations(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"x": np.round(rng.normal(size=2000), 1), "y": rng.integers(0, 30, 2000).astype(float)})
    frame.loc[:600, "x"] = 0.5  # many ties
    frame["y"] += 3 * frame.x
    rows = spark.createDataFrame(frame)
    ranks = {r["x"]: r["rank"] for r in order.average_ranks(rows, "x").collect()}
    assert all(abs(ranks[x] - r) < 1e-9 for x, r in zip(frame.x, frame.x.rank(), strict=True))
    more = rows.union(spark.createDataFrame([(1.0, None), (None, 2.0)], "x double, y double"))
    got = order.correlations(more, "x", "y").first()
    assert got["n"] == 2000 and abs(got["pearson"] - frame.x.corr(frame.y)) < 1e-12
    assert abs(got["spearman"] - frame.x.rank().corr(frame.y.rank())) < 1e-12
    assert tuple(order.correlations(rows.where("x = 0.5"), "x", "x").first()) == (None, None, (frame.x == 0.5).sum())
    assert tuple(order.correlations(rows.limit(0), "x", "y").first()) == (None, None, 0)


def test_quantiles(spark):
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": ["big"] * 5000 + ["ties"] * 3000 + ["one"], "v": [*rng.normal(size=5000), *rng.integers(0, 3, 3000), 7.5]})
    rows = spark.createDataFrame(frame).union(spark.createDataFrame([("big", None), ("none", None), (None, 4.0), (None, 6.0)], "k string, v double")).repartition(5)
    got = {(r["k"], r["share"]): r["quantile"] for r in order.quantiles(rows, ["k"], "v", shares).collect()}
    assert len(got) == 4 * len(shares) and got[None, 0.25] == 4.5
    for k in ("big", "ties", "one"):
        want = np.quantile(frame[frame.k == k].v, shares)
        assert all(abs(got[k, s] - w) < 1e-12 for s, w in zip(shares, want, strict=True))
    whole = order.quantiles(rows, [], "v", [0.5]).collect()
    assert abs(whole[0]["quantile"] - np.quantile([*frame.v, 4.0, 6.0], 0.5)) < 1e-12
    assert order.quantiles(rows.limit(0), ["k"], "v", shares).count() == 0


def test_one_group_of_ten_million(spark):
    rows = spark.range(10_000_000).select(((F.col("id") * 7919) % 9_999_991).alias("v"))
    got = {r["share"]: r["quantile"] for r in order.quantiles(rows, [], "v", [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 0 and got[1.0] == 9_999_990 and abs(got[0.5] - 4_999_995) < 5
