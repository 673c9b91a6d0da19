"""Fits side by side against plain numpy: logistic designs, effects with controls and interactions, boosted trees, slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.operators import boosting as B
from contestlab.operators import evaluation as E
from contestlab.operators import regression as G


def table(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 2), rng.randrange(4)
        p = 1 / (1 + np.exp(-(0.8 * a - 0.3 * (b - 5) + 0.4 * a * (b - 5) / 2 + 0.2 * c - 0.5)))
        rows.append((i, a if i % 31 else None, b, float(c), "xyz"[i % 3] if i % 41 else "few", 2000 + i % 5, int(rng.random() < p) if i % 53 else None))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, g string, year int, y int")


def newton(x, y, strength=1.0):
    """A plain penalised logistic fit."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge, beta = np.r_[0.0, np.full(x.shape[1] - 1, strength)], np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
    return beta


def test_designs_are_fitted_as_by_numpy(spark):
    rows, df = table(spark)
    designs = {"one": ["a"], "two": ["b", "c"], "all": ["a", "b", "c"], "same": ["k"], "none": ["a"]}
    df = df.withColumn("k", F.lit(3.0))
    fits = G.logistic_fits(df, "y", {k: v for k, v in designs.items() if k != "none"})
    at = {"a": 1, "b": 2, "c": 3}
    for name in ("one", "two", "all"):
        have = [r for r in rows if r[6] is not None and all(r[at[c]] is not None for c in designs[name])]
        want = newton(np.array([[r[at[c]] for c in designs[name]] for r in have]), np.array([r[6] for r in have], float))
        f = fits[name]
        assert f.rows == len(have) and abs(f.intercept - want[0]) < 1e-8 and np.allclose([f.coef[c] for c in designs[name]], want[1:], atol=1e-8)
    assert abs(fits["same"].coef["k"]) < 1  # penalised, though the column tells nothing beside the intercept
    single = G.logistic_fits(df.where("y = 1"), "y", {"none": ["a"]})["none"]
    assert single.coef is None and single.positives == single.rows > 0
    assert G.logistic_fits(df.limit(0), "y", {"none": ["a"]})["none"].rows == 0


def test_effects_with_controls_and_interactions(spark):
    rows, df = table(spark)
    out = {r.column_name: r for r in E.effect_summary(df, ["a", "b"], "y", ["c"]).collect()}
    have = [r for r in rows if r[6] is not None and r[1] is not None]
    a, y, c = np.array([r[1] for r in have]), np.array([r[6] for r in have], float), np.array([r[3] for r in have])
    z = (a - a.mean()) / a.std()
    assert abs(out["a"].effect - newton(z[:, None], y)[1]) < 1e-8 and abs(out["a"].effect_controlled - newton(np.column_stack([z, c]), y)[1]) < 1e-8
    assert out["a"].n == len(have) and abs(out["a"].mean_difference - (a[y == 1].mean() - a[y == 0].mean())) < 1e-9 and out["a"].auc > 0.6
    r = E.interaction_effects(df, {"p": ("a", "b")}, "y", lambda x, w: (F.col(w) - F.col(x)) / 3 - F.col(x), ["c"]).first()
    b = np.array([q[2] for q in have])
    zb, d = (b - b.mean()) / b.std(), (b - a) / 3 - a
    want = newton(np.column_stack([-z, -zb, z * zb]), y)
    assert abs(r.product_effect - want[3]) < 1e-8 and abs(r.derived_effect - newton(np.column_stack([(d - d.mean()) / d.std(), c]), y)[1]) < 1e-8 and r.n == len(have)


def plain_trees(x, y, edges, iterations, depth, rate, strength, least):
    """Level by level, by trying every cut of every feature in every node."""
    bins = np.column_stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left")) for v, e in zip(x.T, edges)])
    share = y.mean()
    score = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-score))
        g, h, leaf, node = p - y, p * (1 - p), np.zeros(len(y)), np.zeros(len(y), int)
        open_ = {0}
        for _ in range(depth):
            new = set()
            for k in sorted(open_):
                here, best = node == k, (1e-12, None)
                for f in range(bins.shape[1]):
                    for cut in np.unique(bins[here, f])[:-1]:
                        left = here & (bins[:, f] <= cut)
                        right = here & ~left
                        if left.sum() < least or right.sum() < least:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + strength) for s in (left, right)) - g[here].sum() ** 2 / (h[here].sum() + strength)
                        if gain > best[0] + 1e-12:
                            best = (gain, left, right)
                if best[1] is None:
                    leaf[here] = -rate * g[here].sum() / (h[here].sum() + strength)
                    continue
                for j, side in enumerate(best[1:]):
                    node[side] = 2 * k + 1 + j
                    leaf[side] = -rate * g[side].sum() / (h[side].sum() + strength)
                    new.add(2 * k + 1 + j)
            open_ = new
        score = score + leaf
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_of_many_models_are_those_grown_alone(spark, depth):
    rows, df = table(spark)
    members = F.array_compact(F.array(F.lit("all"), F.when(F.col("g") != "few", F.concat(F.lit("g:"), "g"))))
    trees = B.grow(df, ["a", "b", "c"], "y", members, 4, depth, least_rows=15, bins=8)
    assert sorted(trees.names) == ["all", "g:x", "g:y", "g:z"]
    got = {r.id: r.p for r in trees.probabilities(df, F.array(F.lit("all"), F.lit("g:x"), F.lit("no such model"))).collect()}
    for j, mine in ((0, [r for r in rows if r[6] is not None]), (1, [r for r in rows if r[6] is not None and r[4] == "x"])):
        x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in mine], float)
        want = plain_trees(x, np.array([r[6] for r in mine], float), trees.edges, 4, depth, B.RATE, B.LEAF_STRENGTH, 15)
        assert np.allclose([got[r[0]][j] for r in mine], want, atol=1e-9)
    assert all(p[2] is None for p in got.values())
    assert {m for m, *_ in trees.importance()} == set(trees.names) and sum(n for *_, n in trees.importance()) > 0


def test_slices_and_their_weights(spark):
    rows, df = table(spark, 1500)
    out = {r.g: r for r in E.condition_split(df, "g", ["a", "b", "c"], "y", F.col("year") < 2003, 50, 3, 2).collect()}
    assert out["few"].skip_reason == "too_few_rows" and out["few"].auc_local is None and out["few"].auc_base is not None
    assert all(out[g].skip_reason is None and abs(out[g].delta_auc - (out[g].auc_local - out[g].auc_base)) < 1e-12 for g in "xyz")
    s = E.summarise_slices(spark.createDataFrame([*out.values()])).first()
    n = np.array([out[g].test_rows for g in "xyz"])
    assert abs(s.weighted_delta_logloss - np.average([out[g].delta_logloss for g in "xyz"], weights=n)) < 1e-12
    assert (s.slices, s.compared_slices, s.skipped_slices, s.compared_test_rows, s.test_rows) == (4, 3, 1, n.sum(), n.sum() + out["few"].test_rows)
    assert s.improved_slices == sum(out[g].delta_logloss < 0 for g in "xyz")


def test_folds_grow_together_and_see_no_later_year(spark):
    rows, df = table(spark)
    df = df.withColumn("contest", F.col("id"))
    p = {r.id: r.p for r in E.oof_predictions(df, "year", "contest", ["a", "b"], "y", 2, 2).collect()}
    assert p.keys() == {r[0] for r in rows if r[5] > 2000}
    changed = df.withColumn("y", F.when(F.col("year") >= 2002, 1 - F.col("y")).otherwise(F.col("y")))
    q = {r.id: r.p for r in E.oof_predictions(changed, "year", "contest", ["a", "b"], "y", 2, 2).collect()}
    assert all(abs(p[i] - q[i]) < 1e-12 for i in p if 2000 + i % 5 <= 2002) and any(abs(p[i] - q[i]) > 1e-6 for i in p if 2000 + i % 5 > 2002)
    with pytest.raises(ValueError):
        E.oof_predictions(df.withColumn("contest", F.lit(1)), "year", "contest", ["a"], "y")


def test_equal_rows_grow_as_one(spark, monkeypatch):
    from contestlab.operators import boosting

    rows = [(float(i % 5), float(i % 3), int(i % 7 < 3), ["a"] if i % 2 else ["a", "b"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "u double, v double, y int, m array<string>")
    kept, write = [], boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda d: kept.append(write(d)) or kept[-1])
    trees = boosting.grow(df, ["u", "v"], "y", F.col("m"), 2, 2)
    assert kept[-1].count() == 30 and sum(r["m"] for r in kept[-1].collect()) == 3000
    assert trees.rows.tolist() == [3000.0, 1500.0] and trees.positives[0] == sum(r[2] for r in rows)
