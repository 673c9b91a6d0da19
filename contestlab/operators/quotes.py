"""Quotes as known at a cutoff, market status, price features, edges and stakes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import kelly_stake, row_hash, safe_ln
from contestlab.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class QuotePolicy:
    """Cutoff: a fixed instant (as_of), or some minutes before the scheduled start. Quotes older than max_age seconds at
    the cutoff are stale; the bound itself is fresh."""

    minutes_before_start: int | None = 10
    as_of: object = None
    max_age: float = 300.0
    require_available: bool = False

    def cutoff(self, start: str = "scheduled_start_at") -> Column:
        if self.as_of is not None:
            return F.lit(self.as_of).cast("timestamp")
        return F.col(start) - F.make_dt_interval(mins=F.lit(self.minutes_before_start))


def age(published: Column, cutoff: Column) -> Column:
    return cutoff.cast("timestamp").cast("double") - published.cast("timestamp").cast("double")


def market_status(prices: Sequence[str], max_age: float, published: str = "published_at", cutoff: str = "cutoff_at") -> Column:
    """unknown_cutoff, missing, stale, unavailable, available or invalid, the first that holds. One price must be at least
    1; of two, the first at least 1 and the second no smaller."""
    fine = F.lit(True)
    for i, p in enumerate(prices):
        fine = fine & (F.col(p) >= (F.lit(1.0) if i == 0 else F.col(prices[i - 1]))) & (F.abs(F.col(p)) < float("inf"))
    none = F.lit(False)
    for p in prices:
        none = none | F.col(p).isNull()
    return (
        F.when(F.col(cutoff).isNull(), "unknown_cutoff").when(F.col(published).isNull(), "missing").when(age(F.col(published), F.col(cutoff)) > max_age, "stale")
        .when(none, "unavailable").when(fine, "available").otherwise("invalid")
    )


def select_quotes(entries: DataFrame, quotes: DataFrame, keys: Sequence[str], prices: Sequence[str], policy: QuotePolicy) -> tuple[DataFrame, DataFrame]:
    """Entries, all kept, with the newest quote published, and available if that is known, by the cutoff; the newest wins
    even if unusable. Second: violations, rows that break the contract (prices without time, availability before
    publication, several revisions with one identity, availability missing where required). Exact repeats count once."""
    target = entries.withColumn("cutoff_at", policy.cutoff())
    priced = F.coalesce(*[F.col(p).cast("double") for p in prices]).isNotNull()
    source = quotes.join(target.select(*keys, "cutoff_at"), list(keys)).distinct()
    early = (F.col("published_at") <= F.col("cutoff_at")) & (F.col("available_at").isNull() | (F.col("available_at") <= F.col("cutoff_at")))
    same = F.count("*").over(Window.partitionBy(*keys, "published_at", "available_at"))
    wrong = F.when(F.col("published_at").isNull() & priced, "price_without_time").when(F.col("available_at") < F.col("published_at"), "available_before_published").when((same > 1) & early, "conflicting_revisions")
    if policy.require_available:
        wrong = wrong.when(F.col("available_at").isNull() & (F.col("published_at") <= F.col("cutoff_at")), "availability_missing")
    violations = source.withColumn("violation", wrong).where("violation is not null")
    rest = [c for c in quotes.columns if c not in keys]
    newest = source.where(early).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("published_at", F.coalesce(F.col("available_at").cast("timestamp").cast("double"), F.lit(float("-inf"))))).alias("__q"))
    out = target.join(newest, list(keys), "left").select(*target.columns, *[F.col("__q")[c].alias(c) for c in rest])
    return out.withColumn("quote_id", F.when(F.col("published_at").isNotNull(), row_hash([*keys, *rest]))), violations


def quote_features(df: DataFrame, price: str, popularity: str, starters: str, max_age: float) -> DataFrame:
    """Price if available, its logarithm, popularity if fresh and a positive integer, and its ratio to the field."""
    p = F.when(market_status([price], max_age) == "available", F.col(price))
    fresh = age(F.col("published_at"), F.col("cutoff_at")) <= max_age
    pop = F.when(fresh & (F.col(popularity) >= 1) & (F.col(popularity) % 1 == 0), F.col(popularity))
    return df.withColumns({"quote_price": p, "quote_ln_price": safe_ln(p), "quote_popularity": pop, "quote_popularity_ratio": pop / F.nullif(F.col(starters), F.lit(0))})


def features_ready(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return out


def edge_frame(df: DataFrame, prob: str, odds: str, scale: float = 0.8) -> DataFrame:
    """Rows with probability and positive odds, with implied and market probability, edge and expected value."""
    p, o = F.least(F.greatest(F.col(prob).cast("double"), F.lit(0.0)), F.lit(1.0)), F.col(odds).cast("double")
    out = df.where(F.col(prob).isNotNull() & (o > 0)).withColumns({"prob": p, "odds": o, "implied_prob": 1.0 / o})
    out = out.withColumn("market_prob", F.least(F.greatest(scale * F.col("implied_prob"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumns({"edge": F.col("prob") - F.col("market_prob"), "ev": F.col("prob") * F.col("odds") - 1.0})


def edge_candidates(df: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("edge") >= threshold).orderBy(*keys, F.desc("edge"))


def kelly_ev(df: DataFrame, prob: str, odds: str, bankroll: float, fraction: float, cap: float) -> DataFrame:
    f = kelly_stake(prob, odds, fraction, cap)
    return df.withColumns({"ev_gross": F.col(prob) * F.col(odds), "ev_profit": F.col(prob) * F.col(odds) - 1.0, "kelly_fraction": f, "stake": f * bankroll})


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], contest: str, tie: str, label: str, mode: str = "flat", top_n: int | None = 1, stake: float = 1.0, target: float = 1.0, unit: float = 0.1) -> DataFrame:
    """One row per threshold: bets, stake, return, rate of return, hits, mean edge and value. Each row meets the few
    thresholds that it passes inside its own task; one partial aggregate then serves all thresholds."""
    if top_n:
        w = Window.partitionBy(contest).orderBy(F.desc("edge"), tie)
        df = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top_n)
    money = {"flat": F.lit(float(stake)), "target_payout": F.lit(float(target)) / F.greatest(F.col("odds"), F.lit(1e-12)), "edge_proportional": F.greatest(stake * F.col("edge") / unit, F.lit(0.0))}[mode]
    df = df.withColumns({"__s": money, "__t": F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))})
    hit, won = F.col("edge") >= F.col("__t"), F.coalesce(F.col(label), F.lit(0)) == 1
    out = df.groupBy(F.col("__t").alias("threshold")).agg(
        F.count("*").alias("n_pool"), F.count_if(hit).alias("n_bets"), F.coalesce(F.sum(F.when(hit, F.col("__s"))), F.lit(0.0)).alias("total_stake"), F.coalesce(F.sum(F.when(hit & won, F.col("__s") * F.col("odds"))), F.lit(0.0)).alias("total_return"),
        F.avg(F.when(hit, won.cast("double"))).alias("hit_rate"), F.avg(F.when(hit, F.col("edge"))).alias("avg_edge"), F.avg(F.when(hit, F.col("ev"))).alias("avg_ev"),
    )
    return out.withColumns({"bets_rate": F.col("n_bets") / F.nullif(F.col("n_pool"), F.lit(0)), "roi": F.when(F.col("total_stake") > 0, F.col("total_return") / F.col("total_stake"))})


def logit_shift(df: DataFrame, group: str, order: str, prob: str, k: Column | None = None, steps: int = 60) -> DataFrame:
    """Probabilities moved on the logit scale so that each contest's sum is k (2 of fields up to 7, else 3, at most the
    field): bisection in native expressions over the contest's few logits."""
    z = F.ln(F.least(F.greatest(F.col(prob), F.lit(1e-9)), F.lit(1 - 1e-9)) / (1 - F.least(F.greatest(F.col(prob), F.lit(1e-9)), F.lit(1 - 1e-9))))
    whole = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), z.alias("z")))).alias("__z"))
    n = F.size("__z")
    goal = k if k is not None else F.least(F.when(n <= 7, 2).otherwise(3), n)
    total = lambda shift: F.aggregate("__z", F.lit(0.0), lambda a, x: a + 1 / (1 + F.exp(-(x["z"] + shift))))
    # target sums equal to the field's size are met only at infinity: the bounds stand for it
    move = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(-40.0).alias("lo"), F.lit(40.0).alias("hi")),
        lambda s, _: F.when(total((s["lo"] + s["hi"]) / 2) < goal, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
        lambda s: (s["lo"] + s["hi"]) / 2,
    )
    return df.join(whole.select(group, move.alias("shift")), group).withColumn("p_shifted", 1 / (1 + F.exp(-(z + F.col("shift")))))


def complete_contests(group: str, prob: str, declared: str) -> Column:
    """Whether every entry of the contest has a probability and their number is the declared one."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    return (F.count(prob).over(w) == n) & (F.count(declared).over(w) == n) & (F.min(declared).over(w) == n) & (F.max(declared).over(w) == n)


def prediction_status(start: str, as_of: Column, ready: Column, calibrated: Column) -> Column:
    return F.when(F.col(start).isNull(), "unknown_start").when(F.col(start) <= as_of, "race_closed").when(~ready, "missing_model_odds").when(~calibrated, "missing_calibration_odds").otherwise("predicted")


def ev_status(prob: str, status: str) -> dict[str, Column]:
    s = F.when(F.col(prob).isNull(), "prediction_unavailable").when(F.col(status) == "available", "calculated").otherwise(F.col(status))
    return {"ev_status": s, "skip_reason": F.when(s == "calculated", "").otherwise(s)}


def normalize_in_group(df: DataFrame, group: str, prob: str, name: str = "p_norm") -> DataFrame:
    """p over the contest's sum; 1 / n where the sum is 0."""
    w = Window.partitionBy(group)
    total = F.sum(prob).over(w)
    return df.withColumn(name, F.when(total > 0, F.col(prob) / total).otherwise(F.lit(1.0) / F.count("*").over(w)))


def delta_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean, deviation, exact upper percentiles and maximum of what b has over a."""
    d, size = F.col(b) - F.col(a), F.abs(F.col(b) - F.col(a))
    q = exact_quantiles(df.select(size.alias("__abs")), [], "__abs", [0.95, 0.99]).first()
    high = [F.lit(x).cast("double") for x in (q[0] if q else (None, None))]
    return df.agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.max(size).alias("abs_max")).select("mean", "sd", high[0].alias("abs_p95"), high[1].alias("abs_p99"), "abs_max")


def pair_probabilities(df: DataFrame, group: str, order: str, prob: str, rounds: int = 200) -> DataFrame:
    """Probabilities of pairs (i, j) whose marginals are the entries' probabilities scaled to sum 2, by iterative
    proportional fitting. A contest is one row of two short arrays; a task fits all contests of one size of a batch at
    once."""
    kind = dict(df.dtypes)[order]
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(prob).cast("double").alias("p")))).alias("a")).where(F.size("a") > 1)

    def fit(p: np.ndarray) -> np.ndarray:
        goal = np.minimum(2 * p / np.maximum(p.sum(1, keepdims=True), 1e-300), 1 - 1e-9)
        q = goal[:, :, None] * goal[:, None, :] * (1 - np.eye(p.shape[1]))
        for _ in range(rounds):
            f = np.sqrt(goal / np.maximum(q.sum(2), 1e-300))
            q *= f[:, :, None] * f[:, None, :]
        i, j = np.triu_indices(p.shape[1], 1)
        return q[:, i, j]

    @F.pandas_udf("array<double>")
    def fitted(arrays: pd.Series) -> pd.Series:
        sizes = arrays.map(len).to_numpy()
        out: list = [None] * len(arrays)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for k, v in zip(at, fit(np.stack([arrays.iloc[x] for x in at])), strict=True):
                out[k] = v
        return pd.Series(out)

    numbered = F.transform("a", lambda x, k: F.struct(x["o"].alias("o"), k.alias("k")))
    names = F.flatten(F.transform(numbered, lambda x: F.transform(F.filter(numbered, lambda y: y["k"] > x["k"]), lambda y: F.struct(x["o"].alias("i"), y["o"].alias("j")))))
    both = rows.where(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["p"]) > 0).select(group, names.alias("n"), fitted(F.transform("a", lambda x: x["p"])).alias("q"))
    return both.select(group, F.explode(F.arrays_zip("n", "q")).alias("x")).select(group, F.col("x.n.i").cast(kind).alias("i"), F.col("x.n.j").cast(kind).alias("j"), F.col("x.q").alias("p_pair"))


def excess_vs_market(df: DataFrame, bucket: str, label: str) -> DataFrame:
    """Label less the mean label of the row's price bucket."""
    means = df.groupBy(bucket).agg(F.avg(label).alias("expected"))
    return df.join(means, bucket).withColumn("excess", F.col(label) - F.col("expected"))


def residual_scores(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Each column less its median for the key, and the mean of these that are there."""
    med = df.groupBy(key).agg(*[F.median(c).alias(f"__{c}") for c in cols])
    out = df.join(med, key).withColumns({f"{c}_residual": F.col(c) - F.col(f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])
    n = sum((F.col(f"{c}_residual").isNotNull().cast("int") for c in cols), F.lit(0))
    return out.withColumn("residual_mean", sum((F.coalesce(F.col(f"{c}_residual"), F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(n, F.lit(0)))
