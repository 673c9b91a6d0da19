"""Alternating fits over cells against numpy: convergence, null keys and values, bounded plans."""

import random

import numpy as np
from pyspark.sql import functions as F

from contestlab.operators import effects as X


def test_double_center_converges(spark):
    rng = random.Random(4)
    rows = [(f"a{i}" if i else None, f"b{j}", rng.random() * 5 if rng.random() < 0.9 else None, float(rng.randrange(1, 9))) for i in range(12) for j in range(7) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "a string, b string, v double, w double")
    got = {(r.a, r.b): r.v for r in X.double_center(df, "a", "b", "v", "w", 200).collect()}
    assert len(got) == len(rows)
    v = {(a, b): x for a, b, x, _ in rows}
    w = {(a, b): y if x is not None else 0.0 for a, b, x, y in rows}
    for _ in range(300):
        for k in (0, 1):
            for key in {c[k] for c in v}:
                mine = [c for c in v if c[k] == key and v[c] is not None]
                m = sum(v[c] * w[c] for c in mine) / sum(w[c] for c in mine)
                for c in mine:
                    v[c] -= m
    assert all((got[c] is None) == (v[c] is None) and (v[c] is None or abs(got[c] - v[c]) < 1e-9) for c in v)


def test_main_effects_reach_the_optimum(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(8) if k % 3 else 0, rng.choice("xyz"), int(rng.random() < 0.3)) for k in range(900)]
    out = X.main_effects(spark.createDataFrame(rows, "e_key int, c_key string, y int"), "e_key", "c_key", "y").collect()
    e, c = {r.e_key: r.e for r in out}, {r.c_key: r.c for r in out}
    base = np.log(np.mean([y for *_, y in rows]) / (1 - np.mean([y for *_, y in rows])))
    p = lambda r: 1 / (1 + np.exp(-(base + e[r[0]] + c[r[1]])))
    for found, k in ((e, 0), (c, 1)):  # the gradient of the shrunk likelihood is zero
        for key, x in found.items():
            assert abs(sum(r[2] - p(r) for r in rows if r[k] == key) - 10 * x) < 1e-8


def test_a_step_has_few_exchanges(spark):
    df = spark.range(200).select((F.col("id") % 9).alias("a"), (F.col("id") % 5).alias("b"), F.rand(1).alias("v"), F.lit(1.0).alias("w"))
    plan = X.double_center(df, "a", "b", "v", "w", 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and "Window" not in plan
