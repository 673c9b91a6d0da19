"""Ranks, running totals and quantiles in ranges against brute force: ties, skew, nulls, empty tables; and their plans."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contestlab.operators import evaluation as E
from contestlab.operators import ranks as R


def table(spark, n=4000, seed=1):
    rng = random.Random(seed)
    value = lambda: rng.choice([1.0, 1.0, 1.0, 2.5, rng.random() * 100, rng.random() * 1e-3, -rng.expovariate(1.0), None])  # noqa: E731  three eighths are one value
    rows = [(rng.choice("aaab"), value(), i, int(rng.random() < 0.4)) for i in range(n)] + [("lone", 3.0, n, 1), ("none", None, n + 1, 0)]
    return rows, spark.createDataFrame(rows, "g string, x double, i long, y int")


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_totals(spark, ranges):
    rows, df = table(spark)
    got = {r.i: (r.before, r.before_all) for r in R.running_totals(df, ["g"], ["x", "i"], {"before": F.lit(1).cast("long")}, ranges).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == [(k, len(mine)) for k in range(len(mine))]


@pytest.mark.parametrize("by,ranges", [([], 3), ([], 50), (["g"], 2), (["g"], 40)])
def test_exact_quantiles(spark, by, ranges):
    rows, df = table(spark, 3000, 2)
    probs = [0.0, 0.025, 0.1, 1 / 3, 0.5, 0.9, 0.99, 1.0]
    got = {tuple(r[c] for c in by): r["quantiles"] for r in R.exact_quantiles(df, by, "x", probs, ranges=ranges).collect()}
    want = {}
    for r in rows:
        if r[1] is not None:
            want.setdefault((r[0],) if by else (), []).append(r[1])
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], np.quantile(v, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_of_little(spark):
    one = spark.createDataFrame([(5.0,)], "x double")
    assert R.exact_quantiles(one, [], "x", [0.0, 0.5, 1.0]).first()[0] == [5.0, 5.0, 5.0]
    same = spark.createDataFrame([(5.0,)] * 500 + [(None,)], "x double")
    assert R.exact_quantiles(same, [], "x", [0.25]).first()[0] == [5.0]
    assert R.exact_quantiles(one.limit(0), [], "x", [0.5]).collect() == [] and R.running_totals(one.limit(0), [], ["x"], {"n": F.lit(1)}).collect() == []


def test_metrics_without_groups(spark):
    rows, df = table(spark, 2000, 3)
    p = [(1 / (1 + np.exp(-r[1] / 10)), r[3]) for r in rows if r[1] is not None]
    m = E.binary_metrics(df.withColumn("p", 1 / (1 + F.exp(-F.col("x") / 10))), "y", "p").first()
    pos, neg = [a for a, y in p if y], [a for a, y in p if not y]
    auc = np.mean([(a > np.array(neg)).mean() + (a == np.array(neg)).mean() / 2 for a in pos])
    assert m.n == len(p) and abs(m.auc - auc) < 1e-9 and abs(m.brier - np.mean([(a - y) ** 2 for a, y in p])) < 1e-12
    b = {r.i: r.bucket for r in E.rank_buckets(df, "x", ["i"], 10).collect()}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]))
    edges = np.quantile(np.arange(1, len(order) + 1), np.arange(11) / 10)
    assert [b[r[2]] for r in order] == [max(1, int(np.searchsorted(edges, k + 1))) for k in range(len(order))]


def test_no_task_sorts_a_whole_table(spark):
    _, df = table(spark, 500)
    for out in (E.binary_metrics(df.withColumn("p", F.col("x") / 200 + 0.5), "y", "p"), E.rank_buckets(df, "x", ["i"], 10), E.rank_correlation(df, "x", "i"), R.exact_quantiles(df, [], "x", [0.5])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"Window \[.*", plan)
        assert windows and all("__range" in w for w in windows)
        for m in re.finditer(r"Exchange SinglePartition.*\n(.*)", plan):  # only what aggregates of tasks or ranges leave
            assert "Aggregate" in m[1] or "Project" in m[1]


@pytest.mark.parametrize("by,ranges", [([], 3), ([], 200), (["g"], 7), (["g"], 64)])
def test_rank_bucket_by_group(spark, by, ranges):
    rows, df = table(spark, 3000, 5)
    got = {r.i: r.b for r in R.rank_bucket(df.where("x is not null"), by, ["x", "i"], 10, "b", ranges).collect()}
    for g in {r[0] for r in rows} if by else {None}:
        mine = sorted((r for r in rows if r[1] is not None and (not by or r[0] == g)), key=lambda r: (r[1], r[2]))
        last, q = len(mine) - 1, min(10, len(mine))
        assert [got.pop(r[2]) for r in mine] == [max(1, -(-k * q // last)) if last else 1 for k in range(len(mine))]
    assert not got


def test_contrast_moves_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 4, 1), ("a", None, 1), ("b", 2, 0)], "g string, bucket int, y int")
    out = E.segment_contrast(df, ["g"], "bucket", "y")
    assert {r.g: tuple(r)[1:] for r in out.collect()} == {"a": (2, 1, 0.5, 1.0, -0.5), "b": (1, 1, 0.0, 0.0, 0.0)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_counts_pairs_and_broadcasts_no_rows(spark):
    rows = [(g, float(i % 7), float((i * i) % 5), 1.0) for g in ("a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, y double, one double")
    out = E.rank_correlation(df, "x", "y", ["g"])
    want = pd.DataFrame(rows, columns=list("gxy1")).query("g == 'a'")[["x", "y"]].corr("spearman").iloc[0, 1]
    assert {r.g: (round(r.rank_correlation, 10), r.n) for r in out.collect()} == {g: (round(want, 10), 3000) for g in ("a", "b")}
    pairs = [n for n in out._jdf.queryExecution().executedPlan().toString().splitlines() if "__m" in n and "BroadcastExchange" in n]
    assert not pairs and "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert E.rank_correlation(df, "x", "one").first().rank_correlation is None
