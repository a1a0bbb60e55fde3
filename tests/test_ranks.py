"""Ranks, quantiles and pair distances against plain computations, with hot groups, ties, nulls and few rows."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cuetide.operators import evaluation, ranks


def test_ranks_and_quantiles(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([0, 0, 0, 1, 2, 5])) if rng.random() < 0.7 else rng.random()) for _ in range(900)]
    rows += [("one", 4.0), (None, 1.0), (None, 3.0), ("void", None), ("two", None), ("two", 8.0)] + [("w", rng.random() * 10) for _ in range(41)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    for r in ranks.ranked(df.where("v is not null"), ["g"], ["v"]).collect():
        assert r["n"] == groups[r["g"]].count(r["v"]) and r["before"] == sum(x < r["v"] for x in groups[r["g"]])
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    low = {r["g"]: r["b"] for r in ranks.quantiles(df, ["g"], "v", {"b": 0.95}, lower=True).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        if not v:
            assert got[g]["b"] is None and low[g] is None
            continue
        assert np.allclose([got[g][c] for c in "abc"], np.quantile(v, [0.05, 0.5, 1.0])) and low[g] == v[95 * (len(v) - 1) // 100]
    assert ranks.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
    ids = df.select("v", F.monotonically_increasing_id().alias("id")).where("v is not null")
    held = [(r["v"], r["id"]) for r in ids.collect()]
    assert sorted((r["v"], r["id"]) for r in ranks.top_rows(ids, ["v", "id"], 37).collect()) == sorted(held)[:37]


def test_no_order_in_one_task(spark):
    """A global rank has no stage that holds all rows: the only single partition is of totals."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"), F.lit("x").alias("t"))
    held = ranks.ranked(df, [], ["v"])
    assert held.where("before <> v").count() == 0
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1


def test_pair_distances(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 0, 0, 1, 2, 5]), [rng.random() < 0.5 for _ in range(12)]) for k in range(150)] + [(900, None, [True] * 12), (901, 1, None)]
    df = spark.createDataFrame(rows, "id long, state int, sig array<boolean>")
    want = Counter()
    for a, s, x in rows:
        for b, t, y in rows:
            if None not in (s, t, x, y) and a < b and abs(s - t) <= 1:
                want["same" if s == t else "adjacent", sum(p != q for p, q in zip(x, y, strict=True)) / 12] += 1
    for block in (7, 50, 1000):
        got = {(r["kind"], r["distance"]): r["n"] for r in evaluation.pair_distances(df, id_col="id", state="state", signature="sig", block=block).collect()}
        assert got == dict(want)
    assert evaluation.pair_distances(df.limit(0), id_col="id", state="state", signature="sig").count() == 0
