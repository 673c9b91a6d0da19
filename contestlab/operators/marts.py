"""Feature tables put together from the other operators: encodings, settled markets, enriched entries, live and stored contexts,
and the rows that training and prediction share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import blend_price, logit_diff, smooth_rate
from contestlab.operators.joins import best_in_window, decayed_beside, decayed_history, slot_value
from contestlab.operators.windows import by_period, pick_first, prefer_source, rank_in_group
from contestlab.sources.tables import SMALL


def level_sums(df: DataFrame, entity: str, conditions: Mapping[str, Column | None], date: str, label: str, unit: str, parts: int | None = None, starts: str | None = None) -> DataFrame:
    """entity, condition, level, period, n, k: rows (or the starts they stand for) and labels by level of each condition (None: overall);
    rows of a null level do not count under it. Rows are counted by all levels together and dealt out by entity (to so many parts, if given) before each
    becomes one row a condition: sums, and windows by entity and condition, need no further exchange."""
    own = {f"__l{i}": F.lit("all") if c is None else c.cast("string") for i, c in enumerate(conditions.values())}
    narrow = df.select(F.col(entity), F.trunc(F.col(date), unit).alias("period"), F.col(label).cast("long").alias("k"), (F.col(starts).cast("long") if starts else F.lit(1).cast("long")).alias("n"), *[c.alias(n) for n, c in own.items()])
    fine = narrow.groupBy(entity, "period", *own).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    dealt = fine.repartition(parts, entity) if parts else fine.repartition(entity)
    one = [F.struct(F.lit(name).alias("condition"), F.col(n).alias("level")) for name, n in zip(conditions, own, strict=True)]
    long = dealt.select(entity, "period", "n", "k", F.explode(F.array(*one)).alias("c")).where("c.level is not null")
    return long.select(entity, "c.*", "period", "n", "k").groupBy(entity, "condition", "level", "period").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def encodings(df: DataFrame, entity: str, conditions: Mapping[str, Column | None], date: str, label: str, n_periods: int, unit: str, prior: float, strength: float, parts: int | None = None, starts: str | None = None) -> DataFrame:
    """Smoothed past rates of an entity, overall (condition None) and by level of each condition: entity, condition, level,
    period, past_n, past_k, rate. All conditions come from one scan (level_sums)."""
    sums = level_sums(df, entity, conditions, date, label, unit, parts, starts)
    w = Window.partitionBy(entity, "condition", "level").orderBy("period").rowsBetween(-n_periods, -1)
    past = sums.withColumns({f"past_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("n", "k")})
    return past.select(entity, "condition", "level", "period", "past_n", "past_k", smooth_rate("past_k", "past_n", prior, strength).alias("rate"))


def event_days(events: DataFrame, entity: str, day: str, place: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """One row for an entity and day: its first event in order; for each value its z-score among the peers of the place and day, and
    its distance from the entity's mean and best of all days before."""
    one = pick_first(events, [entity, day], order)
    peers = one.groupBy(place, day).agg(F.count("*").alias("peers"), *[f for v in values for f in (F.avg(v).alias(f"__m_{v}"), F.stddev_samp(v).alias(f"__s_{v}"))])
    past = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    out = one.withColumns({f"{v}_{n}": F.col(v) - f(v).over(past) for v in values for n, f in (("to_mean", F.avg), ("to_best", F.min))})
    out = out.join(peers, [place, day])
    return out.withColumns({f"{v}_peer_z": (F.col(v) - F.col(f"__m_{v}")) / F.nullif(F.col(f"__s_{v}"), F.lit(0.0)) for v in values}).drop(*[f"__{x}_{v}" for v in values for x in "ms"])


def _past_sums(sums: DataFrame, keys: Sequence[str], columns: Sequence[str], years: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-years, -1)
    return sums.select(*keys, "period", *[F.sum(c).over(w).alias(c) for c in columns])


def gate_profile(df: DataFrame, course: Sequence[str], gate: str, date: str, label: str, years: int) -> DataFrame:
    """For each course, gate and year: rows and hits of the years before, their rate, that of all gates, and the difference."""
    sums = by_period(df, [*course, gate], date, "year", [label]).withColumnRenamed(label, "k")
    own = _past_sums(sums, [*course, gate], ["n", "k"], years)
    whole = _past_sums(sums.groupBy(*course, "period").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), course, ["n", "k"], years)
    both = own.join(whole.withColumnsRenamed({"n": "__n", "k": "__k"}), [*course, "period"])
    rate, all_rate = F.col("k") / F.col("n"), F.col("__k") / F.col("__n")
    return both.select(*course, gate, "period", F.coalesce("n", F.lit(0)).alias("past_n"), F.coalesce("k", F.lit(0)).alias("past_k"), rate.alias("rate"), all_rate.alias("course_rate"), (rate - all_rate).alias("lift"))


def style_profile(df: DataFrame, course: Sequence[str], position: str, finish: str, front: str, date: str, years: int, top: int = 3) -> DataFrame:
    """For each course and year: of the first `top` of each contest in the years before, the mean and population deviation of their
    position and the share of those in front."""
    first = df.where(F.col(finish) <= top).withColumn("__q", F.col(position) * F.col(position))
    p = _past_sums(by_period(first, course, date, "year", [position, "__q", front]), course, ["n", position, "__q", front], years)
    n, mean = F.col("n"), F.col(position) / F.col("n")
    return p.select(*course, "period", F.coalesce("n", F.lit(0)).alias("past_n"), mean.alias("position_mean"), F.sqrt(F.greatest(F.col("__q") / n - mean * mean, F.lit(0.0))).alias("position_sd"), (F.col(front) / n).alias("front_share"))


@dataclass(frozen=True)
class Encoding:
    """Rolling encodings of one entity: conditions (None: overall), period unit, periods back and prior strength."""

    entity: str
    conditions: Mapping[str, Column | None]
    unit: str
    periods: int
    strength: float


def _looked_up(df: DataFrame, table: DataFrame, on: Sequence[Column | str], columns: Mapping[str, Column]) -> DataFrame:
    return df.join(table, on, "left").withColumns(dict(columns))


def with_rates(history: Mapping[str, DataFrame], context: DataFrame, specs: Sequence[Encoding], date: str, label: str, prior: float, parts: int, starts: str | None = None) -> DataFrame:
    """context with a column "entity_condition" for each encoding of several entities: the smoothed rate as known at the start of the
    row's period, null where the period's key has none. history: the rows that count (or stand for so many starts), by entity. They are counted by all levels and
    dealt out by entity to so many parts before each becomes one row a condition (encodings); an entity's rates of a period are one
    row with a map, and context meets it where it lies. Entities with few periods in all are broadcast instead."""
    def level(c: Column | None) -> Column:
        return F.lit("all") if c is None else c.cast("string")

    out = context
    for s in specs:
        h = history[s.entity].where(F.col(s.entity).isNotNull())
        rates = encodings(h, s.entity, s.conditions, date, label, s.periods, s.unit, prior, s.strength, parts, starts)
        maps = rates.groupBy(F.col(s.entity).alias("__entity"), F.col("period").alias("__period")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "condition", "level"), "rate"))).alias("__rates"))
        few = h.agg(F.approx_count_distinct(F.struct(s.entity, F.trunc(F.col(date), s.unit)))).first()[0] <= SMALL // 10
        on = (F.col(s.entity) == F.col("__entity")) & (F.trunc(F.col(date), s.unit) == F.col("__period"))
        found = {f"{s.entity}_{name}": F.try_element_at("__rates", F.concat_ws("|", F.lit(name), level(c))) for name, c in s.conditions.items()}
        out = _looked_up(out if few else out.repartition(parts, s.entity), F.broadcast(maps) if few else maps, on, found).drop("__entity", "__period", "__rates")
    return out


def rates_of_rows(rows: DataFrame, row: Sequence[str], spec: Encoding, date: str, n: str | None, label: str, prior: float, parts: int, asked: Column | None = None) -> DataFrame:
    """row and a column "entity_condition" for each encoding: the smoothed rate as known at the start of the row's period, null for a
    null entity or level. Rows stand for n starts (None: one) with label successes; all of them count, those of asked come back. They
    move once, narrow, by entity; windows over the periods that an entity's level has seen look back where they lie."""
    marks = {f"__l{i}": c.cast("string") for i, c in enumerate(spec.conditions.values()) if c is not None}
    narrow = rows.select(*row, F.col(spec.entity).alias("__e"), F.trunc(F.col(date), spec.unit).alias("__p"), *[c.alias(m) for m, c in marks.items()], *([F.col(n).cast("long").alias("__n")] if n else []), F.col(label).cast("long").alias("__k"), *([asked.alias("__asked")] if asked is not None else []))
    out, starts = narrow.repartition(parts, "__e"), F.col("__n") if n else F.lit(1).cast("long")
    for i, (name, c) in enumerate(spec.conditions.items()):
        by, known = Window.partitionBy("__e", *([f"__l{i}"] if c is not None else [])), F.col("__e").isNotNull() & (F.lit(True) if c is None else F.col(f"__l{i}").isNotNull())
        out = out.withColumn("__r", F.dense_rank().over(by.orderBy("__p")))
        past = by.orderBy("__r").rangeBetween(-spec.periods, -1)
        out = out.withColumn(f"{spec.entity}_{name}", F.when(known, smooth_rate(F.sum("__k").over(past), F.sum(starts).over(past), prior, spec.strength)))
    return (out.where("__asked") if asked is not None else out).select(*row, *[f"{spec.entity}_{name}" for name in spec.conditions])


def past_of_rows(rows: DataFrame, row: Sequence[str], key: str, date: str, levels: Mapping[str, Column | None], values: Sequence[str], half_life: float, years: int, last: Mapping[str, tuple[DataFrame | None, str, Column, Sequence[str]]], parts: int, asked: Column | None = None) -> DataFrame:
    """row, key and, for each row, the decayed histories of its key overall (None) and by level (decayed_beside), and a struct {name} with
    the day and values of the last row of a strictly earlier date of each of several histories, the one of the highest tie (null:
    none). last: history (None: the rows themselves, whose tie is made of row), day, tie and values by name. All rows count, those of asked come back. Rows and
    histories move once, narrow, by key; all windows run where they lie, and the result lies by key."""
    marks = [c.alias(f"__l{i}") for i, c in enumerate(levels.values()) if c is not None]
    own = [F.col(v).alias(f"__{n}_{v}") for n, (h, _, _, vs) in last.items() if h is None for v in vs]
    both = rows.select(*row, key, date, *values, *marks, *own, *([asked.alias("__asked")] if asked is not None else []))
    for n, (h, day, tie, vs) in last.items():
        if h is not None:
            seen = h.where(F.col(key).isNotNull() & F.col(day).isNotNull())
            both = both.unionByName(seen.select(key, F.col(day).alias(date), tie.cast("long").alias(f"__{n}_tie"), *[F.col(v).alias(f"__{n}_{v}") for v in vs]), allowMissingColumns=True)
    mine = F.col(row[0]).isNotNull()
    before = Window.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    out = both.repartition(parts, key).withColumns({f"__{n}_tie": F.when(mine, tie.cast("long")) for n, (h, _, tie, _) in last.items() if h is None})
    newest = {n: F.max(F.when(F.col(f"__{n}_tie").isNotNull(), F.struct(F.col(date).alias("day"), F.col(f"__{n}_tie").alias("tie"), *[F.col(f"__{n}_{v}").alias(v) for v in vs]))) for n, (_, _, _, vs) in last.items()}
    out = out.withColumns({n: F.when(F.col(key).isNotNull(), x.over(before)).dropFields("tie") for n, x in newest.items()})
    out = out.where(mine).drop(*[f"__{n}_{v}" for n, (_, _, _, vs) in last.items() for v in ("tie", *vs)])
    out = decayed_beside(out, key, {name: None if c is None else f"__l{i}" for i, (name, c) in enumerate(levels.items())}, date, values, half_life, years)
    return (out.where("__asked") if asked is not None else out).select(*row, key, *[f"{name}_{v}" for name in levels for v in ("n", *values)], *last)


def last_of_each(runs: DataFrame, events: Mapping[str, tuple[DataFrame, str, str, Sequence[str]]], key: str, date: str, parts: int) -> DataFrame:
    """For each key and date of runs, the last row of a strictly earlier date of each of several histories: key, date and, for a
    history `name`, a struct {name} with its day and values (null: none). events: history, day, tie and values by name. All rows are
    dealt out by key once, narrow, and shrink to one a key and date, which one window looks back over."""
    asked = runs.select(key, date, *[F.lit(None).alias(f"__{n}") for n in events], F.lit(True).alias("__asked"))
    kinds = {n: F.struct(F.col(day).alias("day"), *values) for n, (_, day, _, values) in events.items()}
    both = None
    for n, (h, day, tie, _) in events.items():
        row = h.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(key), F.col(day).alias(date), F.struct(F.col(tie).cast("long").alias("tie"), kinds[n].alias("v")).alias(f"__{n}"))
        both = row if both is None else both.unionByName(row, allowMissingColumns=True)
    both = both.unionByName(asked.drop(*[f"__{n}" for n in events]), allowMissingColumns=True).repartition(parts, key)
    days = both.groupBy(key, date).agg(*[F.max_by(f"__{n}", f"__{n}.tie").alias(f"__{n}") for n in events], F.max("__asked").alias("__asked"))
    before = Window.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    seen = days.select(key, date, "__asked", *[F.last(f"__{n}", ignorenulls=True).over(before)["v"].alias(n) for n in events])
    return seen.where("__asked").drop("__asked")


def encoding_columns(df: DataFrame, row: Sequence[str], entity: str, conditions: Mapping[str, Column | None], date: str, unit: str, rates: DataFrame, prefix: str) -> DataFrame:
    """row, {prefix}_rate and, for each condition but the overall one, the difference of the log-odds of its rate from the
    overall one ({prefix}_{condition}). One join for all conditions, on narrow rows."""
    one = [F.struct(F.lit(name).alias("condition"), (F.lit("all") if c is None else c.cast("string")).alias("level")) for name, c in conditions.items()]
    long = df.select(*row, F.col(entity), F.trunc(F.col(date), unit).alias("period"), F.explode(F.array(*one)).alias("c")).select(*row, entity, "period", "c.*")
    got = long.join(rates.select(entity, "condition", "level", "period", "rate"), [entity, "condition", "level", "period"])
    wide = got.groupBy(*row).agg(*[F.max(F.when(F.col("condition") == name, F.col("rate"))).alias(f"__{name}") for name in conditions])
    overall = next(name for name, c in conditions.items() if c is None)
    others = [logit_diff(f"__{name}", f"__{overall}").alias(f"{prefix}_{name}") for name in conditions if name != overall]
    return wide.select(*row, F.col(f"__{overall}").alias(f"{prefix}_rate"), *others)


def settled_entries(sources: Sequence[DataFrame], payouts: DataFrame, contest: str, entry: str, win_slots: int, place_slots: int) -> DataFrame:
    """Result odds of each entry from the first source that has them, their blends, and what was paid on it: 0 where it is in
    none of the slots (win_no1.., win_pay1.., place_no1.., place_pay1..), null where the contest has no payouts yet."""
    odds = prefer_source(sources, [contest, entry]).drop("source_priority").join(payouts.withColumn("__paid", F.lit(True)), contest, "left")
    paid = lambda kind, n: F.when(F.col("__paid"), F.coalesce(slot_value(F.col(entry), [f"{kind}_no{i}" for i in range(1, n + 1)], [f"{kind}_pay{i}" for i in range(1, n + 1)]), F.lit(0.0)))
    return odds.select(
        contest, entry, "win_odds", "place_low", "place_high", blend_price("place_low", "place_high").alias("place_avg"),
        blend_price("place_low", "place_high", "weighted").alias("place_weighted"), paid("win", win_slots).alias("pay_win"), paid("place", place_slots).alias("pay_place"),
    )


def pair_ev(pairs: DataFrame, contest: str, prob: str, odds: str, pay: str, least_return: float) -> DataFrame:
    """Pairs of settled contests (some pair paid) with expected and realised return per unit and whether they are bet on."""
    settled = F.max(pay).over(Window.partitionBy(contest)) > 0
    out = pairs.withColumn("__settled", settled).where("__settled").drop("__settled")
    out = out.withColumns({"expected_return": F.col(prob) * F.col(odds), "is_hit": F.col(pay) > 0, "realized_return": F.coalesce(F.col(pay), F.lit(0.0)) / 100})
    return out.withColumns({"expected_profit": F.col("expected_return") - 1, "realized_profit": F.col("realized_return") - 1, "is_bet": F.coalesce(F.col("expected_return") >= least_return, F.lit(False))})


def exact_sum(c: Column) -> Column:
    """Sum of amounts as decimals of ten places, so that it doesn't depend on the order of addition."""
    return F.sum(c.cast("decimal(28,10)")).cast("double")


def pair_coverage(evaluated: DataFrame, contest: str) -> DataFrame:
    """One row: pairs and contests in all and bet on, and what the bets brought."""
    bet = F.col("is_bet")
    when = lambda c: F.when(bet, F.col(c))
    n = F.count_if(bet)
    return evaluated.agg(
        F.count("*").alias("pairs"), F.count_distinct(contest).alias("contests"), n.alias("bets"), F.count_distinct(when(contest)).alias("bet_contests"), (n / F.count("*")).alias("bet_rate"),
        F.avg(when("is_hit").cast("double")).alias("hit_rate"), F.avg(when("expected_return")).alias("avg_expected_return"), exact_sum(when("realized_return")).alias("total_return"),
        F.avg(when("realized_return")).alias("roi"),
    )


def top_n_sweep(evaluated: DataFrame, contest: str, order: Sequence[str], most: int) -> DataFrame:
    """For each n up to most what betting on each contest's n pairs of highest expected return brings; ties by order."""
    rank = F.row_number().over(Window.partitionBy(contest).orderBy(F.col("expected_return").desc_nulls_last(), *order))
    picked = evaluated.withColumn("__r", rank).where(F.col("__r") <= most)
    # a pair of rank r is in the picks of every n from r on
    long = picked.withColumn("top_n", F.explode(F.sequence(F.col("__r"), F.lit(most))))
    out = long.groupBy("top_n").agg(F.count("*").alias("bets"), F.count_distinct(contest).alias("contests"), F.avg(F.col("is_hit").cast("double")).alias("hit_rate"), F.avg("expected_return").alias("avg_expected_return"), exact_sum(F.col("realized_return")).alias("total_return"))
    return out.withColumns({"total_profit": F.col("total_return") - F.col("bets"), "roi": F.col("total_return") / F.col("bets")})


def enriched(entries: DataFrame, events: DataFrame, windows: Mapping[str, tuple[int, int]], key: str, day: str, event_day: str, order: Sequence[Column], values: Sequence[str], row: Sequence[str], contest: str, ranked: str) -> DataFrame:
    """Entries with the best side event of each window of days before them (columns {window}_{value}), and the rank of
    `ranked` in the contest for each window, those without an event last."""
    out = entries
    for name, (low, high) in windows.items():
        best = best_in_window(entries.select(*row, key, day), events, key, day, event_day, low, high, order, values, row)
        out = out.join(best.select(*row, F.col(event_day).alias(f"{name}_{event_day}"), *[F.col(v).alias(f"{name}_{v}") for v in values]), list(row))
    for name in windows:
        out = rank_in_group(out, [contest], f"{name}_{ranked}", f"{name}_rank")
    return out


def excess_z(df: DataFrame, keys: Sequence[str], date: str, value: str, n_periods: int, unit: str, floor: float = 0.1, least: int = 2) -> DataFrame:
    """df with excess_z: by how many deviations value lies under the mean of its key over the periods before (deviation at
    least floor); null with fewer than `least` values before."""
    p = df.where(F.col(value).isNotNull()).groupBy(*keys, F.trunc(F.col(date), unit).alias("__p")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    w = Window.partitionBy(*keys).orderBy("__p").rowsBetween(-n_periods, -1)
    past = p.select(*keys, "__p", *[F.sum(c).over(w).alias(f"__{c}") for c in "nsq"])
    n, s, q = F.col("__n"), F.col("__s"), F.col("__q")
    sd = F.greatest(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))), F.lit(floor))
    out = df.withColumn("__p", F.trunc(F.col(date), unit)).join(past, [*keys, "__p"], "left")
    return out.withColumn("excess_z", F.when(n >= least, (s / n - F.col(value)) / sd)).drop("__p", "__n", "__s", "__q")


def condition_history(df: DataFrame, entity: str, condition: str, levels: Sequence, date: str, label: str, half_life: float, years: int, parts: int | None = None) -> DataFrame:
    """entity, date and, for each level, the decayed starts and labels of earlier dates under it: every date of an entity
    meets every level (0 where it did not start). Rows are dealt out by entity once (to so many parts, if given), while they are
    narrow; the levels are columns from the sums by date on, so that one decayed pass serves them all where an entity lies."""
    rows = df.select(entity, date, condition, label)
    dealt = rows.repartition(parts, entity) if parts else rows.repartition(entity)
    under = {x: F.col(condition) == F.lit(x) for x in levels}
    names = [f"{v}_{x}" for x in levels for v in ("starts", "hits")]
    days = dealt.groupBy(entity, date).agg(*[f for x, c in under.items() for f in (F.count_if(c).alias(f"starts_{x}"), F.coalesce(F.sum(F.when(c, F.col(label))), F.lit(0)).alias(f"hits_{x}"))])
    return decayed_history(days, [entity], date, names, half_life, years).withColumnsRenamed({f"{n}_decayed": n for n in names})


def live_context(declared: DataFrame, updates: DataFrame, date: str, target, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Declared entries of the target date with the newest update's values where there are any."""
    newest = updates.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = declared.where(F.col(date) == F.lit(target)).join(newest, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def all_contexts(stored: DataFrame, live: DataFrame, date: str, target) -> DataFrame:
    """Live rows of the target date and stored rows of all others, so that no entry stands in both."""
    return live.where(F.col(date) == F.lit(target)).unionByName(stored.where(F.col(date) != F.lit(target)), allowMissingColumns=True)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows by an order whose last column breaks all ties."""
    return df.orderBy(*order).limit(k)


def ability_transform(df: DataFrame, column: str, how: str) -> tuple[DataFrame, str]:
    """df with the column that `how` makes of another, and its name: raw (itself, as a number), log (of positive values, at
    least 1e-6), z (population deviation over all rows, 1 where it is 0 or unknown) or log_z."""
    if how not in ("raw", "log", "z", "log_z"):
        raise ValueError(f"unknown transform {how!r}")
    name = column
    out = df.withColumn(name, F.col(name).try_cast("double"))
    if how.startswith("log"):
        name = f"{column}_log"
        out = out.withColumn(name, F.when(F.col(column) > 0, F.ln(F.greatest(F.col(column), F.lit(1e-6)))))
    if how.endswith("z"):
        m, s = out.agg(F.avg(name), F.stddev_pop(name)).first()
        out, name = out.withColumn(f"{name}_z", (F.col(name) - F.lit(m)) / F.lit(s or 1.0)), f"{name}_z"
    return out, name


def default_range(now: dt.datetime, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """The dates asked for; one alone stands for both; with none, the next Saturday and Sunday, or the Sunday that today is."""
    if start or end:
        return start or end, end or start
    today = now.date()
    first = today if today.weekday() == 6 else today + dt.timedelta(days=(5 - today.weekday()) % 7)
    return first.isoformat(), (first if first.weekday() == 6 else first + dt.timedelta(days=1)).isoformat()


def rebuild_dataset(meta: Mapping, df: DataFrame, year: str, label: str, keys: Sequence[str], ready: Column | None = None) -> DataFrame:
    """The rows that a stored model was trained and tested on, from its metadata (feature_names, train_year_start,
    train_year_end, test_year): keys, features, label and part. Unknown labels and rows that are not ready are left out."""
    missing = [c for c in (*meta["feature_names"], label) if c not in df.columns]
    if missing or not meta["feature_names"]:
        raise ValueError(f"columns that the metadata names are missing: {missing}")
    part = F.when(F.col(year).between(meta["train_year_start"], meta["train_year_end"]), "train").when(F.col(year) == meta["test_year"], "test")
    out = df.where(F.col(label).isNotNull() & (F.lit(True) if ready is None else ready)).withColumn("part", part).where("part is not null")
    return out.select(*keys, *meta["feature_names"], label, "part")


def five_lags(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], date: str, k: int = 5) -> DataFrame:
    """df with the columns and dates of the entity's k runs before, and the days between each run and the one before it."""
    w = Window.partitionBy(entity).orderBy(*order)
    lags = df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(w) for c in (*columns, date) for i in range(1, k + 1)})
    days = {f"days_lag{i}": F.datediff(date if i == 1 else f"{date}_lag{i - 1}", f"{date}_lag{i}") for i in range(1, k + 1)}
    return lags.withColumns(days).drop(*[f"{date}_lag{i}" for i in range(1, k + 1)])
