"""Nested confirmation of pairs: each verdict, no look at later rows, and folds by hand."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from contestlab.operators import confirmation as N


def events(spark, n=6000, seed=2):
    """Pair strong has a real interaction; none has nothing at all; late has one that turns against itself in time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i * 1200 // n)
        e, c, f, g, h = rng.randrange(6), rng.randrange(3), rng.randrange(40), rng.randrange(3), rng.randrange(8)
        z = rng.choice([-1.5, -0.7, 0.2])
        shift = 1.1 * (1 if (e + c) % 2 else -1) + (0.9 if (h + g) % 2 else -0.9) * (1 if day.year < 2022 else -1)
        rows.append((i // 4, day, str(e), str(c), str(f), str(h), str(g), float(1 / (1 + np.exp(-z))), int(rng.random() < 1 / (1 + np.exp(-z - shift)))))
    return spark.createDataFrame(rows, "contest int, day date, e string, c string, f string, h string, g string, p double, y int")


def test_each_verdict_is_reached(spark):
    df = events(spark)
    pairs = {"strong": ("e", "c"), "against": ("h", "g"), "small": ("f", "one")}
    policy = N.ConfirmationPolicy(folds=4, months=4, draws=100, rounds=5)
    out = {r.pair: r for r in N.confirm_pairs(df.withColumn("one", F.lit("1")), pairs, "day", "contest", "p", "y", "2021-12-01", policy).collect()}
    assert out["strong"].decision == "confirmed" and out["strong"].delta_logloss_high < 0 and out["strong"].win_rate == 1.0 and out["strong"].fold_count == 4
    assert out["against"].decision == "rejected" and out["against"].delta_logloss > 0
    assert out["small"].decision in ("rejected", "inconclusive") and abs(out["small"].delta_logloss) < 0.01
    few = N.confirm_pairs(df, {"strong": ("e", "c"), "absent": ("e", "c")}, "day", "contest", "p", "y", "2023-03-20", policy).collect()
    assert {(r.decision, r.inconclusive_reason) for r in few} == {("inconclusive", "insufficient_folds")}


def test_folds_by_hand(spark):
    policy = N.ConfirmationPolicy(folds=2, months=6)
    days = [dt.date(2020, 1, 1), dt.date(2020, 7, 1), dt.date(2021, 1, 1), dt.date(2021, 7, 1), dt.date(2022, 1, 1)]
    got = {(r.day, r.fold, r.stage, r.part) for r in N.fold_samples(spark.createDataFrame([(d,) for d in days], "day date"), "day", "2021-01-01", policy).collect()}
    t, v = "train", "validation"
    assert got == {
        (days[0], 0, "outer", t), (days[0], 0, "inner", t), (days[1], 0, "outer", t), (days[1], 0, "inner", v), (days[2], 0, "outer", v),
        (days[0], 1, "outer", t), (days[0], 1, "inner", t), (days[1], 1, "outer", t), (days[1], 1, "inner", t), (days[2], 1, "outer", t), (days[2], 1, "inner", v), (days[3], 1, "outer", v),
    }


def test_fits_by_entity_are_those_in_turn(spark):
    df = events(spark, 900, 5)
    z = F.round(F.ln(F.col("p") / (1 - F.col("p"))), 6)
    counts = df.groupBy(F.lit("x").alias("pair"), F.col("e").alias("entity"), F.col("c").alias("cond"), z.alias("z"), (F.year("day") - 2020).alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    policy = N.ConfirmationPolicy(rounds=40, taus=(0.1, 0.8))
    (a, c), (b, d) = N.fit_by_entity(counts.where("cut < 3"), 3, policy), N.fit_in_turn(counts.where("cut < 3"), 3, policy)
    flat = lambda x: {(r.entity, r.cut, k): (r.e, n, *w) for r in x.collect() for k, n, w in zip(r.conds, r.ns, r.ws, strict=True)}
    got, want = flat(a), flat(b)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    level = lambda x: {(r.cut, r.cond): r.c for r in x.collect()}
    assert all(abs(level(c)[k] - v) < 1e-6 for k, v in level(d).items())
    many = N.fit_by_entity(counts.where("cut < 3"), 3, policy, hot=1)[0]  # rows too many for one entity: the other way, whole
    assert flat(many).keys() == want.keys()
