"""Confirmation of entity-by-condition effects out of sample: expanding folds with a tuning split inside each, all pairs, folds and
prior widths fitted by the same passes over rows that lie by entity, and a block bootstrap whose draws all pairs share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.functions.columns import logit_clip
from contestlab.operators.effects import HOT_CELL, alternate, fit_cells, monday_week, poisson_weight, shifts
from contestlab.sources.tables import settled


@dataclass(frozen=True)
class ConfirmationPolicy:
    """months: length of a validation span and of the tuning span before it. taus: prior widths of interactions, the best of
    which the tuning span chooses. strength: penalty of main effects."""

    folds: int = 4
    months: int = 6
    taus: Sequence[float] = (0.05, 0.2, 0.8)
    strength: float = 10.0
    rounds: int = 20
    draws: int = 400
    seed: int = 11
    least_folds: int = 3
    least_blocks: int = 8
    least_rms: float = 0.005
    least_wins: float = 0.6


def _sigma(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _loss(p: Column, y: str) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - p))


def fold_samples(rows: DataFrame, date: str, start, policy: ConfirmationPolicy) -> DataFrame:
    """Rows by fold, stage and part. Stage outer: training before the fold's span, validation in it. Stage inner: the same for the
    span just before, which lies in the outer training part."""
    f = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(policy.folds - 1))))
    edge = lambda k: F.add_months(F.lit(start).cast("date"), (F.col("fold") + k) * policy.months)
    d = F.col(date)

    def part(stage: str, k: int) -> Column:
        p = F.when(d < edge(k), "train").when(d < edge(k + 1), "validation")
        return F.when(p.isNotNull(), F.struct(F.lit(stage).alias("stage"), p.alias("part")))

    return f.withColumn("__s", F.explode(F.array_compact(F.array(part("outer", 0), part("inner", -1))))).select("*", "__s.*").drop("__s")


#: Conditions of a pair up to which main effects are fitted by entity; their outer products are what a pass sends.
MOST_CONDITIONS = 64


def _edges(start, policy: ConfirmationPolicy) -> Column:
    """Where a fit's training ends and its validation begins, for cuts 0, 1, ...: cut f is fold f's inner stage, cut f + 1 its outer
    stage, which is also the inner stage of the fold after; and where the last validation ends."""
    return F.array(*[F.add_months(F.lit(start).cast("date"), (k - 1) * policy.months) for k in range(policy.folds + 2)])


def _first_cut(day: str, start, policy: ConfirmationPolicy) -> Column:
    """The first cut that trains on the day; the day validates the cut before. folds + 1: none, and the last validates; null: after."""
    at = F.size(F.filter(_edges(start, policy), lambda x: x <= F.col(day)))
    return F.when(at <= policy.folds + 1, at)


def fit_by_entity(counts: DataFrame, cuts: int, policy: ConfirmationPolicy, hot: int = HOT_CELL) -> tuple[DataFrame, DataFrame]:
    """Two tables. For each pair, entity and cut with rows in training: e (the entity's main effect), and for each condition that
    the entity has there (conds) its rows (ns) and its effect by prior width (ws). For each pair, cut and condition: c, its main
    effect. counts: pair, entity, cond, z, cut (the first that trains on the rows), n, k. Main effects are penalised shifts of the
    log-odds z; cell effects come on top.

    An entity's rows lie in one array. Given the condition effects its own effect needs no other entity; a pass solves it, and sends
    the gradient and curvature that condition effects have when entity effects follow them. So condition effects take Newton steps
    that allow for all entities, a few passes in all, and no pass writes or moves rows. More than MOST_CONDITIONS conditions, or
    an entity with more than `hot` rows of counts: entity and condition effects are fitted in turn over the table of counts."""
    counts = settled(counts)
    sizes = counts.groupBy("pair", "entity").agg(F.count(F.lit(1)).alias("d")).groupBy("pair").agg(F.max("d").alias("d"))
    levels = counts.groupBy("pair").agg(F.count_distinct("cond").alias("c"))
    if sizes.agg(F.max("d")).first()[0] is None or sizes.where(F.col("d") > hot).count() or levels.where(F.col("c") > MOST_CONDITIONS).count():
        return fit_in_turn(counts, cuts, policy)
    conds: dict[str, list[str]] = {}  # at most MOST_CONDITIONS a pair
    for r in counts.select("pair", "cond").distinct().orderBy("pair", "cond").collect():
        conds.setdefault(r["pair"], []).append(r["cond"])
    place = F.array_position(F.create_map(*[x for p, cs in conds.items() for x in (F.lit(p), F.array(*[F.lit(c) for c in cs]))])[F.col("pair")], F.col("cond")) - 1
    one = F.struct(place.cast("double").alias("c"), F.col("cut").cast("double").alias("t"), "z", F.col("n").cast("double").alias("m"), F.col("k").cast("double").alias("y"))
    lists = counts.groupBy("pair", "entity").agg(F.array_sort(F.collect_list(one)).alias("a"))
    held = settled(lists.select("pair", "entity", *[F.col(f"a.{c}").alias(c) for c in "ctzmy"]))
    strength, taus = policy.strength, policy.taus
    effects = {(p, t): np.zeros(len(cs)) for p, cs in conds.items() for t in range(cuts)}

    def solved(b: pd.DataFrame, pair: str, cut: int, c: np.ndarray) -> tuple | None:
        """Rows in training, which entity each is of, and the entities' effects given those of conditions."""
        own = np.repeat(np.arange(len(b)), b["z"].str.len())
        cond, t, z, m, y = (np.concatenate(b[x].to_numpy()) for x in "ctzmy")
        use = t <= cut
        if not use.any():
            return None
        own, cond, z, m, y = own[use], cond[use].astype(int), z[use], m[use], y[use]
        e, total = np.zeros(len(b)), lambda v: np.bincount(own, v, len(b))
        for _ in range(60):
            p = 1 / (1 + np.exp(-(z + c[cond] + e[own])))
            step = (total(y - m * p) - strength * e) / (total(m * p * (1 - p)) + strength)
            e = e + np.clip(step, -2.0, 2.0)
            if np.abs(step).max() < 1e-12:
                break
        return own, cond, z, m, y, e

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for batch in batches:
            for pair, b in batch.groupby("pair"):
                for t in range(cuts):
                    c = effects[pair, t]
                    if (got := solved(b, pair, t, c)) is None:
                        continue
                    own, cond, z, m, y, e = got
                    p, k = 1 / (1 + np.exp(-(z + c[cond] + e[own]))), len(c)
                    v = np.bincount(own * k + cond, m * p * (1 - p), len(b) * k).reshape(len(b), k)
                    curve = np.diag(v.sum(0)) - v.T @ (v / (v.sum(1) + strength)[:, None])
                    new = np.concatenate([np.bincount(cond, y - m * p, k), curve.ravel()])
                    found[pair, t] = found.get((pair, t), 0.0) + new
        rows = [(p, t, i, x) for (p, t), s in found.items() for i, x in enumerate(s)]
        yield pd.DataFrame(rows, columns=["pair", "cut", "place", "value"])

    for _ in range(policy.rounds):
        rows = held.mapInPandas(sums, "pair string, cut int, place int, value double").groupBy("pair", "cut", "place").agg(F.sum("value").alias("value")).collect()
        totals = {key: np.zeros(len(c) * (len(c) + 1)) for key, c in effects.items()}
        for r in rows:
            totals[r["pair"], r["cut"]][r["place"]] = r["value"]
        moved = 0.0
        for key, c in effects.items():
            k = len(c)
            step = np.linalg.solve(totals[key][k:].reshape(k, k) + strength * np.eye(k), totals[key][:k] - strength * c)
            effects[key] = c + np.clip(step, -2.0, 2.0)
            moved = max(moved, np.abs(step).max())
        if moved <= 1e-9:
            break

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair, b in batch.groupby("pair"):
                for t in range(cuts):
                    c = effects[pair, t]
                    if (got := solved(b, pair, t, c)) is None:
                        continue
                    own, cond, z, m, y, e = got
                    order = np.argsort(own * len(c) + cond, kind="stable")
                    cell, z, m, y = (own * len(c) + cond)[order], (z + c[cond] + e[own])[order], m[order], y[order]
                    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    at, rows = cell[starts], np.add.reduceat(m, starts)
                    found = np.stack([shifts(z, m, y, starts, tau) for tau in taus])
                    there, first = np.unique(at // len(c), return_index=True)
                    names, ends = [conds[pair][i] for i in at % len(c)], np.r_[first[1:], len(at)]
                    out = [(pair, b["entity"].iloc[i], t, e[i], names[f:g], rows[f:g].tolist(), found[:, f:g].T.tolist()) for i, f, g in zip(there, first, ends, strict=True)]
                    yield pd.DataFrame(out, columns=["pair", "entity", "cut", "e", "conds", "ns", "ws"])

    made = held.mapInPandas(fitted, "pair string, entity string, cut int, e double, conds array<string>, ns array<double>, ws array<array<double>>")
    c = counts.sparkSession.createDataFrame([(p, t, n, float(x)) for (p, t), xs in effects.items() for n, x in zip(conds[p], xs, strict=True)], "pair string, cut int, cond string, c double")
    return settled(made), F.broadcast(c)


def fit_in_turn(counts: DataFrame, cuts: int, policy: ConfirmationPolicy) -> tuple[DataFrame, DataFrame]:
    """The same, whatever the number of conditions and of an entity's rows: rows of counts stand under each cut that trains on them,
    and entity and condition effects are fitted in turn, each a pass over all."""
    long = counts.withColumn("cut", F.explode(F.sequence(F.col("cut"), F.lit(cuts - 1)))).groupBy("pair", "cut", "entity", "cond", "z").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    long = long.withColumns({"e_key": F.concat_ws("|", "pair", "cut", "entity"), "c_key": F.concat_ws("|", "pair", "cut", "cond")})
    p = _sigma(F.col("z") + F.col("e") + F.col("c"))

    def newton(name: str) -> Column:
        x = F.max(name)
        return x + (F.sum(F.col("k") - F.col("n") * p) - policy.strength * x) / (F.sum(F.col("n") * p * (1 - p)) + policy.strength)

    main = settled(alternate(long, [("e_key", "e"), ("c_key", "c")], newton, policy.rounds, 1e-9))
    fit = ["pair", "cut", "entity"]
    cells = fit_cells(main.withColumn("z", F.col("z") + F.col("e") + F.col("c")), [*fit, "cond"], policy.taus)
    of = {float(t): F.max(F.when(F.col("tau") == float(t), F.col("effect"))) for t in policy.taus}
    cells = cells.groupBy(*fit, "cond").agg(F.max("n").cast("double").alias("n"), F.array(*of.values()).alias("w")).groupBy(*fit).agg(F.collect_list(F.struct("cond", "n", "w")).alias("x"))
    e = main.groupBy(*fit).agg(F.max("e").alias("e")).join(cells, fit)
    return settled(e.select("pair", "entity", "cut", "e", F.col("x.cond").alias("conds"), F.col("x.n").alias("ns"), F.col("x.w").alias("ws"))), main.groupBy("pair", "cut", "cond").agg(F.max("c").alias("c"))



def confirm_pairs(df: DataFrame, pairs: Mapping[str, tuple[str, str]], date: str, contest: str, prob: str, label: str, start, policy: ConfirmationPolicy = ConfirmationPolicy()) -> DataFrame:
    """One row for each pair of an entity and a condition column: whether cell effects beside main effects (over the log-odds of
    prob) improve the log-loss of later contests: confirmed, rejected or inconclusive, with the figures of the decision.

    A pair is rejected if its effects are too small to matter (their weighted root mean square at a probability of 20 % in the
    last fold is below least_rms) or the interval of the log-loss difference lies above 0; it is confirmed if the interval lies
    below 0 and enough folds improve. Too few folds or bootstrap blocks leave it inconclusive. Rows with a null among date,
    contest, prob, label or a pair's columns don't count for it; entities and conditions that a fold has not seen have no effect."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(e).cast("string").alias("entity"), F.col(c).cast("string").alias("cond")) for k, (e, c) in pairs.items()]))
    rows = df.select(F.col(date).cast("date").alias("day"), F.col(contest).alias("contest"), logit_clip(prob).alias("z"), F.col(label).cast("int").alias("y"), each.alias("x")).select("day", "contest", "z", "y", "x.*")
    rows = settled(rows.where("day is not null and contest is not null and z is not null and y is not null and entity is not null and cond is not null"))
    cuts = policy.folds + 1
    rows = rows.withColumn("cut", _first_cut("day", start, policy))
    counts = rows.where(F.col("cut") < cuts).groupBy("pair", "entity", "cond", "z", "cut").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    fitted, c = fit_by_entity(counts, cuts, policy)

    test = rows.where(F.col("cut") > 0).withColumn("cut", F.col("cut") - 1)
    effects = fitted.select("pair", "entity", "cut", "e", F.map_from_arrays("conds", "ws").alias("w"))
    held = test.join(effects, ["pair", "entity", "cut"], "left").join(c, ["pair", "cut", "cond"], "left")
    held = settled(held.select("pair", "cut", "contest", "day", "y", (F.col("z") + F.coalesce("e", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))).alias("z"), F.try_element_at("w", F.col("cond")).alias("w")))
    shifted = lambda at: _sigma(F.col("z") + F.coalesce(F.get("w", at), F.lit(0.0)))
    # a fold tunes where it trained on less: cut f for fold f, which is validated by cut f + 1
    tuned = held.where(F.col("cut") < policy.folds).groupBy("pair", F.col("cut").alias("fold"))
    losses = [F.struct(F.avg(_loss(shifted(F.lit(i)), "y")).alias("loss"), F.lit(float(t)).alias("tau"), F.lit(i).alias("at")) for i, t in enumerate(policy.taus)]
    # one row for each pair and fold; ties go to the narrower prior
    best = settled(tuned.agg(F.array_min(F.array(*losses)).alias("x")).select("pair", "fold", "x.at"))
    outer = held.where(F.col("cut") > 0).withColumn("fold", F.col("cut") - 1).join(F.broadcast(best), ["pair", "fold"])
    p0, p1 = _sigma(F.col("z")), shifted(F.col("at"))
    diffs = settled(outer.select("pair", "fold", "contest", monday_week("day").alias("week"), (_loss(p1, "y") - _loss(p0, "y")).alias("logloss"), (F.pow(p1 - F.col("y"), 2) - F.pow(p0 - F.col("y"), 2)).alias("brier")))

    folds = diffs.groupBy("pair", "fold").agg(F.avg("logloss").alias("d")).groupBy("pair").agg(F.count(F.lit(1)).alias("fold_count"), F.avg((F.col("d") < 0).cast("double")).alias("win_rate"))
    weeks = diffs.groupBy("pair", "contest").agg(F.min("week").alias("week"), F.avg("logloss").alias("logloss"), F.avg("brier").alias("brier"))
    weeks = weeks.groupBy("pair", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("logloss").alias("logloss"), F.sum("brier").alias("brier"))
    drawn = weeks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(policy.draws)))).withColumn("w", poisson_weight(F.col("week").cast("string"), F.col("rep"), policy.seed))
    means = drawn.groupBy("pair", "rep").agg(*[(F.sum(F.col(m) * F.col("w")) / F.nullif(F.sum(F.col("n") * F.col("w")), F.lit(0))).alias(m) for m in ("logloss", "brier")])
    spread = means.groupBy("pair").agg(*[F.percentile(m, F.lit(q)).alias(f"delta_{m}_{side}") for m in ("logloss", "brier") for side, q in (("low", 0.025), ("high", 0.975))], F.avg((F.col("logloss") < 0).cast("double")).alias("p_improves"))
    middle = weeks.groupBy("pair").agg(F.count(F.lit(1)).alias("blocks"), *[(F.sum(m) / F.sum("n")).alias(f"delta_{m}") for m in ("logloss", "brier")])

    last = best.groupBy("pair").agg(F.max("fold").alias("fold"), F.max_by("at", "fold").alias("at")).select("pair", (F.col("fold") + 1).alias("cut"), "at")
    cells = fitted.join(F.broadcast(last), ["pair", "cut"]).select("pair", "at", F.explode(F.arrays_zip("ns", "ws")).alias("x"))
    moved = _sigma(F.lit(-1.3862943611198906) + F.get("x.ws", F.col("at"))) - 0.2
    rms = cells.groupBy("pair").agg(F.sqrt(F.sum(F.col("x.ns") * moved * moved) / F.sum("x.ns")).alias("effect_rms"))

    names = df.sparkSession.createDataFrame([(k,) for k in pairs], "pair string")
    out = names.join(folds, "pair", "left").join(middle, "pair", "left").join(spread, "pair", "left").join(rms, "pair", "left")
    out = out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("fold_count", "blocks")})
    reason = F.when(F.col("fold_count") < policy.least_folds, "insufficient_folds").when(F.col("blocks") < policy.least_blocks, "insufficient_blocks")
    verdict = F.when(reason.isNotNull(), "inconclusive").when(F.col("effect_rms") < policy.least_rms, "rejected")
    verdict = verdict.when((F.col("delta_logloss_high") < 0) & (F.col("win_rate") >= policy.least_wins), "confirmed").when(F.col("delta_logloss_low") >= 0, "rejected").otherwise("inconclusive")
    return out.withColumns({"decision": verdict, "inconclusive_reason": reason})
