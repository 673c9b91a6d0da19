"""Entity-by-condition effects, bootstraps, screening, stability, reviews and decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import cut_bands, logit_clip
from contestlab.sources.tables import SMALL, settled


def poisson_weight(block: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) weight from the hash of block, draw and seed: the same wherever and for whatever it is drawn."""
    u = F.pmod(F.xxhash64(block, draw, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    w, cum, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 12):
        cum += p
        p /= k
        w = w + (u >= cum).cast("int")
    return w


def block_bootstrap(df: DataFrame, value: str, block: str, reps: int, seed: int) -> DataFrame:
    """Mean of value and its central 95 % when whole blocks are drawn anew: each block's (sum, n) gets Poisson(1) weights
    from a hash of block, draw and seed, so draws are the same wherever they run."""
    blocks = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    draws = blocks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = poisson_weight(F.col(block).cast("string"), F.col("rep"), seed)
    means = draws.withColumn("w", w).groupBy("rep").agg((F.sum(F.col("s") * F.col("w")) / F.nullif(F.sum(F.col("n") * F.col("w")), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).crossJoin(blocks.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("blocks")))


def monday_week(date: str) -> Column:
    return F.date_trunc("week", F.col(date)).cast("date")


def cell_table(df: DataFrame, entity: str, cond: str, prob: str, label: str) -> DataFrame:
    """Per cell the sums that effects need: rows, labels, expected labels and variances."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.groupBy(entity, cond).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("k"), F.sum(p).alias("expected"))


#: Distinct offsets of a cell from which on it is split over several rows.
HOT_CELL = 50_000


def _at_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined with other by keys, null being a key like others."""
    renamed = other.select(*[F.col(k).alias(f"__on_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"__on_{k}" for k in keys])


def _offset_arrays(offsets: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return offsets.groupBy(*keys).agg(F.collect_list(F.struct("z", F.col("n").cast("double").alias("m"), F.coalesce(F.col("k").cast("double"), F.lit(0.0)).alias("y"))).alias("a"), *more)


def _cell_totals() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum(F.col("k").cast("double")).alias("k"), F.sum(F.col("n") / (1 + F.exp(-F.col("z")))).alias("expected")]


def _likelihood(z: np.ndarray, m: np.ndarray, y: np.ndarray, starts: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, curvature and value of the log-likelihood of runs of offsets (which begin at starts) when each run is shifted."""
    at = z + np.repeat(shift, np.diff(np.r_[starts, len(z)]))
    p = 1 / (1 + np.exp(-at))
    return np.add.reduceat(y - m * p, starts), np.add.reduceat(m * p * (1 - p), starts), np.add.reduceat(y * at - m * np.logaddexp(0, at), starts)


def shifts(z: np.ndarray, m: np.ndarray, y: np.ndarray, starts: np.ndarray, tau: float, newton: int = 8) -> np.ndarray:
    """The shift of each run of offsets z (m rows and y labels each) under a normal prior of width tau."""
    prec, effect = 1 / (tau * tau), np.zeros(len(starts))
    for _ in range(newton):
        slope, curvature, _ = _likelihood(z, m, y, starts, effect)
        effect = effect + (slope - effect * prec) / (curvature + prec)
    return effect


def _runs(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    z, m, y = (np.concatenate(b[f"__{c}"].to_numpy()) for c in "zmy")
    return z, m, y, np.r_[0, b["__z"].str.len().cumsum().to_numpy()[:-1]].astype(int)


def _schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def fit_cells(offsets: DataFrame, keys: Sequence[str], taus: Sequence[float], newton: int = 8, hot: int = HOT_CELL) -> DataFrame:
    """For each cell (keys) and prior width tau the shift of the log-odds over the offsets of its rows: keys, n, k, expected, tau,
    effect, se, marginal. offsets has keys, z (the log-odds), n and k (rows and labels with this offset). Several fits at once are
    several values of a key.

    A cell is one row with its offsets, and the Newton steps of many cells run side by side in a task. A cell with more than
    `hot` distinct offsets is split into parts by the offsets' hash, and each of its steps adds up the parts' sums: the same
    fit, up to the order of additions. A null key is a key like others; no rows: empty result. Writes the offsets once."""
    offsets = settled(offsets)
    many = offsets.groupBy(*keys).agg(F.count("*").alias("__d")).where(F.col("__d") > hot)
    many = settled(many.select(*keys, F.ceil(F.col("__d") / hot).cast("int").alias("__parts")))
    if not many.limit(1).count():
        return _fit_whole(offsets, keys, taus, newton)
    return _fit_whole(_at_keys(offsets, many, keys, "left_anti"), keys, taus, newton).unionByName(_fit_split(offsets, many, keys, taus, newton))


def _fit_whole(offsets: DataFrame, keys: Sequence[str], taus: Sequence[float], newton: int) -> DataFrame:
    cells = _offset_arrays(offsets, keys, *_cell_totals())
    cells = cells.select(*keys, "n", "k", "expected", *[F.transform("a", _part(c)).alias(f"__{c}") for c in "zmy"])
    own = len(keys) + 3

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z, m, y, starts = _runs(b)
            for tau in taus:
                prec, effect = 1 / (tau * tau), shifts(z, m, y, starts, tau, newton)
                _, curvature, like = _likelihood(z, m, y, starts, effect)
                none = _likelihood(z, m, y, starts, np.zeros(len(b)))[2]
                marginal = like - none - effect * effect * prec / 2 - np.log((curvature + prec) / prec) / 2
                yield b.iloc[:, :own].assign(tau=tau, effect=effect, se=1 / np.sqrt(curvature + prec), marginal=marginal)

    return cells.mapInPandas(fit, _schema_of(cells, cells.columns[:own]) + ", tau double, effect double, se double, marginal double")


def _fit_split(offsets: DataFrame, many: DataFrame, keys: Sequence[str], taus: Sequence[float], newton: int) -> DataFrame:
    """The fits of the cells that many lists, with the number of parts of each."""
    own = _at_keys(offsets, many, keys)
    parts = _offset_arrays(own.withColumn("__part", F.pmod(F.xxhash64("z"), "__parts")), [*keys, "__part"])
    parts = settled(parts.select(*keys, "__part", *[F.transform("a", _part(c)).alias(f"__{c}") for c in "zmy"]))
    named = [*keys, "tau", "effect"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                slope, curvature, like = _likelihood(*_runs(b), b["effect"].to_numpy())
                yield b[named].assign(slope=slope, curvature=curvature, like=like)

    def at(effects: DataFrame) -> DataFrame:
        """Sums of each cell and width at its effect."""
        rows = _at_keys(parts, effects, keys).select(*named, "__z", "__m", "__y")
        out = rows.mapInPandas(sums, _schema_of(rows, named) + ", slope double, curvature double, like double")
        return out.groupBy(*named).agg(*[F.sum(c).alias(c) for c in ("slope", "curvature", "like")])

    start = settled(many.select(*keys, F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"), F.lit(0.0).alias("effect")))
    effects, prec = start, 1 / (F.col("tau") * F.col("tau"))
    for _ in range(newton):
        moved = F.col("effect") + (F.col("slope") - F.col("effect") * prec) / (F.col("curvature") + prec)
        effects = settled(at(effects).select(*keys, "tau", moved.alias("effect")))
    none = at(start).select(*keys, "tau", F.col("like").alias("none"))
    found = _at_keys(at(effects), none, [*keys, "tau"])
    hess = F.col("curvature") + prec
    marginal = F.col("like") - F.col("none") - F.col("effect") * F.col("effect") * prec / 2 - F.log(hess / prec) / 2
    totals = own.groupBy(*keys).agg(*_cell_totals())
    return _at_keys(totals, found.select(*named, (1 / F.sqrt(hess)).alias("se"), marginal.alias("marginal")), keys).select(*keys, "n", "k", "expected", "tau", "effect", "se", "marginal")


def cell_effects(df: DataFrame, entity: str, cond: str, prob: str, label: str, taus: Sequence[float] = (0.05, 0.1, 0.2, 0.4, 0.8), bins: int | None = None, newton: int = 8) -> DataFrame:
    """Shift of the log-odds of each cell over the offset prob, with a normal prior whose width tau is the one of the grid
    with the largest Laplace marginal likelihood. Rows are counted by cell and offset first; then the Newton steps run side
    by side over a batch of cells and all widths, those of cells with very many offsets over parts of them (see fit_cells).
    `bins` rounds offsets to so many logit steps, which makes fewer of them and moves the effects."""
    z = logit_clip(prob)
    if bins is not None:
        z = F.round(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)) * (bins / 16)) * (16 / bins)
    offsets = df.groupBy(entity, cond, z.alias("z")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("k"))
    long = settled(fit_cells(offsets, [entity, cond], taus, newton))
    best = long.groupBy("tau").agg(F.sum("marginal").alias("m")).orderBy(F.desc("m"), "tau").limit(1).select("tau")
    return long.join(F.broadcast(best), "tau")


def _part(name: str):
    return lambda x: x[name]


def _with_effect(cells: DataFrame, effects: DataFrame | None, key: str, name: str) -> DataFrame:
    if effects is None:
        return cells.withColumn(name, F.lit(0.0))
    return cells.join(effects, F.col(key).eqNullSafe(F.col(f"__key_{name}"))).drop(f"__key_{name}")


def alternate(cells: DataFrame, keys: Sequence[tuple[str, str]], update: Callable[[str], Column], rounds: int, tolerance: float) -> DataFrame:
    """cells with an effect for each (key, name), fitted in turn: update(name) is the aggregate over a key's cells that gives its
    new effect. Between steps only one small table for each key is kept, written so that no plan grows; a step joins them to
    the cells and aggregates by the key, a hot key's cells before they are shuffled. It ends when no effect moves by more than
    tolerance in a round, or after so many rounds. Null keys are keys."""
    held = settled(cells)
    found: dict[str, DataFrame | None] = {name: None for _, name in keys}

    def fitted() -> DataFrame:
        out = held
        for key, name in keys:
            out = _with_effect(out, found[name], key, name)
        return out

    for _ in range(rounds):
        moved = 0.0
        for key, name in keys:
            new, seen = fitted().groupBy(F.col(key).alias(f"__key_{name}")).agg(update(name).alias("__new"), F.max(name).alias("__old")), Observation()
            new = settled(new.observe(seen, F.max(F.abs(F.col("__new") - F.col("__old"))).alias("moved"), F.count(F.lit(1)).alias("rows")))
            moved, e = max(moved, seen.get["moved"] or 0.0), new.select(f"__key_{name}", F.coalesce("__new", "__old").alias(name))
            found[name] = F.broadcast(e) if seen.get["rows"] <= SMALL else e
        if moved <= tolerance:
            break
    return fitted()


def main_effects(df: DataFrame, entity: str, cond: str, label: str, strength: float = 10.0, rounds: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """Cells with an offset of entity and condition effects on the log-odds, both shrunk: Newton steps in turn over the table of
    cell counts, which is all that is read again."""
    cells = df.groupBy(entity, cond).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("k"))
    rate = df.agg(F.sum(F.col(label).cast("double")) / F.count("*")).first()[0] or 0.5
    p = 1 / (1 + F.exp(-(logit_clip(F.lit(float(rate))) + F.col("e") + F.col("c"))))

    def newton(name: str) -> Column:
        e = F.max(name)
        return e + (F.sum(F.col("k") - F.col("n") * p) - strength * e) / (F.sum(F.col("n") * p * (1 - p)) + strength)

    return alternate(cells, [(entity, "e"), (cond, "c")], newton, rounds, tolerance).withColumn("offset_p", p)


def double_center(cells: DataFrame, a: str, b: str, value: str, weight: str, rounds: int = 20, tolerance: float = 1e-12) -> DataFrame:
    """Weighted double centring: the means of rows and of columns are taken off in turn, until they no longer move. Cells with a
    null value have no weight."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))

    def mean(name: str) -> Column:
        return F.sum((F.col(value) - F.col("__b" if name == "__a" else "__a")) * w) / F.nullif(F.sum(w), F.lit(0.0))

    out = alternate(cells, [(a, "__a"), (b, "__b")], mean, rounds, tolerance)
    return out.withColumn(value, F.col(value) - F.col("__a") - F.col("__b")).drop("__a", "__b")


def screen_pairs(cells: DataFrame, min_cell: int, min_coverage: float, min_rms: float) -> DataFrame:
    """One row for a pair of entity and condition: coverage by cells of enough rows, weighted RMS of the effects, the gain
    in log-likelihood per row, and whether it is eligible."""
    big = F.col("n") >= min_cell
    out = cells.agg(F.sum("n").alias("rows"), (F.sum(F.when(big, F.col("n"))) / F.sum("n")).alias("coverage"), F.sqrt(F.sum(F.col("n") * F.col("effect") * F.col("effect")) / F.sum("n")).alias("effect_rms"), (-F.sum("marginal") / F.sum("n")).alias("delta_logloss"))
    return out.withColumn("eligible", (F.coalesce(F.col("coverage"), F.lit(0.0)) >= min_coverage) & (F.col("effect_rms") >= min_rms) & (F.col("delta_logloss") < 0))


def confirm(folds: DataFrame, interval: DataFrame, practical_rms: float, least_rms: float, least_wins: float) -> DataFrame:
    """Verdict from fold-wise log-loss differences and their bootstrap interval."""
    wins = folds.agg(F.avg((F.col("delta_logloss") < 0).cast("double")).alias("win_rate"))
    verdict = F.when(F.lit(practical_rms < least_rms), "rejected").when((F.col("high") < 0) & (F.col("win_rate") >= least_wins), "confirmed").when(F.col("low") >= 0, "rejected").otherwise("inconclusive")
    return interval.crossJoin(wins).withColumn("decision", verdict)


def cell_stability(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over folds: mean and central 95 % of the effect, share of the more frequent sign among effects off zero, the
    latest training size, and what the mean effect does to a probability of 20 %."""
    e, off = F.col("effect"), F.abs(F.col("effect")) > 1e-12
    up = F.avg(F.when(off, (F.col("effect") > 0).cast("double")))
    out = folds.groupBy(*keys).agg(F.count("*").alias("fold_count"), F.avg(e).alias("effect_mean"), F.percentile("effect", F.lit(0.025)).alias("effect_low"), F.percentile("effect", F.lit(0.975)).alias("effect_high"), F.coalesce(F.greatest(up, 1 - up), F.lit(0.0)).alias("sign_stability"), F.max_by("n", "fold").alias("latest_n"))
    return out.withColumn("effect_at_20pct", 1 / (1 + F.exp(-(F.lit(-1.3862943611198906) + F.col("effect_mean")))) - 0.2)


def contest_metric_diff(df: DataFrame, contest: str, date: str, label: str, a: str, b: str) -> DataFrame:
    """Per contest the mean difference of log-loss and Brier score of b against a."""
    p = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = lambda c: -F.when(F.col(label) == 1, F.ln(p(c))).otherwise(F.ln(1 - p(c)))
    return df.groupBy(contest).agg(F.min(monday_week(date)).alias("week"), F.avg(loss(b) - loss(a)).alias("delta_logloss"), F.avg(F.pow(F.col(b) - F.col(label), 2) - F.pow(F.col(a) - F.col(label), 2)).alias("delta_brier"))


def contribution_review(long: DataFrame, feature: str, value: str, year: str | None = None) -> DataFrame:
    """Mean absolute contribution of each feature, its rank and share; by year if asked."""
    keys = [feature, *([year] if year else [])]
    out = long.groupBy(*keys).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    w = Window.partitionBy(*([year] if year else []))
    return out.withColumns({"contribution_rank": F.rank().over(w.orderBy(F.desc("mean_abs"))), "contribution_share": F.col("mean_abs") / F.sum("mean_abs").over(w)})


def redundancy(df: DataFrame, feature: str, others: Sequence[str], least: float = 0.9) -> DataFrame:
    """Correlation of a feature with others in one pass, and which are redundant."""
    row = df.agg(*[F.corr(feature, o).alias(o) for o in others])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(o).alias("other"), F.col(o).alias("correlation")) for o in others])).alias("x")).select("x.*")
    return long.withColumn("redundant", F.coalesce(F.abs("correlation") >= least, F.lit(False)))


def case_lists(df: DataFrame, prob: str, label: str, order: Sequence[Column], n: int, threshold: float = 0.5) -> DataFrame:
    """The n clearest true and false positives and negatives."""
    yes = F.col(prob) >= threshold
    case = F.when(yes & (F.col(label) == 1), "TP").when(yes, "FP").when(F.col(label) == 1, "FN").otherwise("TN")
    w = Window.partitionBy("case").orderBy(F.desc(F.abs(F.col(prob) - threshold)), *order)
    return df.withColumn("case", case).withColumn("case_no", F.row_number().over(w)).where(F.col("case_no") <= n)


def judge_metrics(auc: Column, logloss: Column) -> Column:
    return F.when((auc > 0) & (logloss < 0), "improved").when((auc > 0) | (logloss < 0), "mixed").otherwise("not_improved")


def decide_scenarios(metrics: DataFrame, baseline: str, review: str | None = None) -> DataFrame:
    """Deltas against the baseline scenario, their judgement and the recommendation; a review that is not `fine` turns
    adoption into a hold. There must be one baseline row."""
    found = metrics.where(F.col("scenario") == baseline).limit(2).count()
    if found != 1:
        raise ValueError(f"{found} baseline rows, but there must be one")
    base = metrics.where(F.col("scenario") == baseline).select(*[F.col(c).alias(f"__{c}") for c in ("auc", "logloss", "brier")])
    out = metrics.join(F.broadcast(base)).withColumns({f"delta_{c}": F.col(c) - F.col(f"__{c}") for c in ("auc", "logloss", "brier")})
    j = judge_metrics(F.col("delta_auc"), F.col("delta_logloss"))
    fine = F.coalesce(F.col(review) == "fine", F.lit(True)) if review else F.lit(True)
    verdict = F.when(j == "improved", F.when(fine, "adopt").otherwise("hold")).when(j == "mixed", "hold").otherwise("reject")
    is_base = F.col("scenario") == baseline
    return out.withColumns({"judgement": F.when(is_base, "baseline").otherwise(j), "decision": F.when(is_base, "baseline").otherwise(verdict)}).drop("__auc", "__logloss", "__brier")


def choose_winners(metrics: DataFrame, group: str, candidate: str, simplicity: str, auc_threshold: float, logloss_threshold: float) -> DataFrame:
    """Per group the best candidate (largest AUC gain, then lowest log-loss) among those that improve, or among all where
    none does; of near ties with it the simplest wins."""
    w = Window.partitionBy(group)
    good = (F.col("delta_auc") > auc_threshold) & (F.col("delta_logloss") < logloss_threshold)
    c = metrics.withColumn("__good", good).withColumn("__any", F.max("__good").over(w)).where(F.col("__good") | ~F.col("__any"))
    best = F.max(F.struct("delta_auc", (-F.col("delta_logloss")).alias("l"))).over(w)
    c = c.withColumns({"__a": best["delta_auc"], "__l": -best["l"]}).where((F.abs(F.col("__a") - F.col("delta_auc")) <= F.lit(abs(auc_threshold))) & (F.abs(F.col("__l") - F.col("delta_logloss")) <= F.lit(abs(logloss_threshold))))
    c = c.withColumns({"__ties": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(simplicity, candidate))}).where("__r = 1")
    reason = F.when(F.col("__ties") > 1, F.when(F.col("__any"), "tie_prefer_simpler").otherwise("relative_tie_prefer_simpler")).otherwise(F.when(F.col("__any"), "improved_best").otherwise("relative_best"))
    return c.select(group, F.col(candidate).alias("winner"), reason.alias("reason"), "delta_auc", "delta_logloss")


def outcome_by_band(df: DataFrame, delta: str, label: str, edges: Sequence[float], names: Sequence[str]) -> DataFrame:
    return df.withColumn("band", cut_bands(F.abs(F.col(delta)), edges, names, True)).groupBy("band").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def sample_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most n rows of each group, in the order of a seeded hash."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def resolve_feature_set(registry: DataFrame, name: str, mode: str) -> list[str]:
    """Features of a set in order: those that are on, for validation also the experimental ones."""
    wanted = ["on"] if mode == "production" else ["on", "experimental"]
    rows = registry.where((F.col("set") == name) & F.col("status").isin(*wanted)).orderBy("order").collect()
    return [r["feature"] for r in rows]


def select_output(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit((defaults or {}).get(c)).alias(c) for c in columns])
