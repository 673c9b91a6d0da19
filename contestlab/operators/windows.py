"""Windows, rankings, rolling rates and group statistics. Frames end at the row before, so nothing sees its own outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import smooth_rate


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_in_group") <= n)


def prefer_source(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Union of sources with one row per key: the first source that has it."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_priority", F.lit(i))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    return pick_first(both, keys, [F.col("source_priority"), *order])


def rank_in_group(df: DataFrame, keys: Sequence[str], column: str, name: str, descending: bool = False) -> DataFrame:
    """rank() with nulls last, and its share of the group (0 for the first, 1 for the last)."""
    c = F.col(column)
    w = Window.partitionBy(*keys)
    r = F.rank().over(w.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))
    n = F.count("*").over(w)
    return df.withColumns({name: r, f"{name}_pct": (r - 1) / F.nullif(n - 1, F.lit(0))})


def ntile_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)))


def lag_vector(df: DataFrame, entity: str, order: Sequence[str], cols: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(w) for c in cols for i in range(1, k + 1)})


def expanding_stats(df: DataFrame, entity: str, order: Sequence[str], column: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{column}_past_mean": F.avg(column).over(w), f"{column}_past_min": F.min(column).over(w)})


def rolling_sd(df: DataFrame, entity: str, order: Sequence[str], column: str, n: int) -> DataFrame:
    return df.withColumn(f"{column}_sd{n}", F.stddev_samp(column).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(-n, -1)))


def by_period(df: DataFrame, keys: Sequence[str], date: str, unit: str, values: Sequence[str]) -> DataFrame:
    """Counts and sums of values by key and month or year: what rolling windows run over."""
    return df.groupBy(*keys, F.trunc(F.col(date), unit).alias("period")).agg(F.count("*").cast("long").alias("n"), *[F.sum(F.col(v).cast("long")).alias(v) for v in values])


def rolling_rate(df: DataFrame, keys: Sequence[str], date: str, label: str, n_periods: int, unit: str, prior: float, strength: float) -> DataFrame:
    """Smoothed rate of label over the n observed periods before each period (which itself doesn't count)."""
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-n_periods, -1)
    p = by_period(df, keys, date, unit, [label]).withColumns({"past_n": F.coalesce(F.sum("n").over(w), F.lit(0)), "past_k": F.coalesce(F.sum(label).over(w), F.lit(0))})
    return p.select(*keys, "period", "past_n", "past_k", smooth_rate("past_k", "past_n", prior, strength).alias("rate"))


def rolling_moments(df: DataFrame, keys: Sequence[str], date: str, column: str, n_periods: int, unit: str) -> DataFrame:
    """Mean and population deviation over earlier periods from sums; the divisor is the number of rows."""
    p = df.groupBy(*keys, F.trunc(F.col(date), unit).alias("period")).agg(F.count("*").alias("n"), F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("q"))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-n_periods, -1)
    n, s, q = F.sum("n").over(w), F.sum("s").over(w), F.sum("q").over(w)
    return p.select(*keys, "period", n.alias("past_n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"))


def rolling_relative(df: DataFrame, keys: Sequence[str], within: Sequence[str], date: str, label: str, years: int) -> DataFrame:
    """Each key's yearly rate over that of `within`: its mean and deviation over earlier years."""
    own = by_period(df, keys, date, "year", [label])
    whole = own.groupBy(*within, "period").agg((F.sum(label) / F.sum("n")).alias("whole"))
    ratio = own.join(whole, [*within, "period"]).withColumn("ratio", (F.col(label) / F.col("n")) / F.nullif(F.col("whole"), F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-years, -1)
    return ratio.select(*keys, "period", F.avg("ratio").over(w).alias("ratio_mean"), F.stddev_samp("ratio").over(w).alias("ratio_sd"))


def career_age(df: DataFrame, entity: str, period: str, early: int = 12) -> DataFrame:
    first = F.min(period).over(Window.partitionBy(entity))
    months = (F.year(period) - F.year(first)) * 12 + F.month(period) - F.month(first)
    return df.withColumns({"career_months": months, "early_phase": months < early})


def relative_rate(df: DataFrame, entity: str, category: str, date: str, label: str, years: int, prior: float, strength: float) -> DataFrame:
    """An entity's past rate in a category over the rate of all entities there."""
    own = rolling_rate(df, [entity, category], date, label, years, "year", prior, strength)
    whole = rolling_rate(df, [category], date, label, years, "year", prior, strength).select(category, "period", F.col("rate").alias("whole"))
    return own.join(whole, [category, "period"]).withColumn("relative", F.col("rate") / F.nullif(F.col("whole"), F.lit(0.0)))


def group_z(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sample: bool = False) -> DataFrame:
    """z-scores inside groups; null where the deviation is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp if sample else F.stddev_pop
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.nullif(sd(c).over(w), F.lit(0.0)) for c in cols})


def group_robust_z(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distance from the group's median over its interquartile range."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    return df.join(q, list(keys)).withColumn(f"{column}_rz", (F.col(column) - F.col("__q")[1]) / F.nullif(F.col("__q")[2] - F.col("__q")[0], F.lit(0.0))).drop("__q")


def diff_to_best(df: DataFrame, keys: Sequence[str], column: str, lowest: bool = True) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn(f"{column}_to_best", F.col(column) - (F.min if lowest else F.max)(column).over(w))


def peer_z(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Sample z-score among the peers of a place and day."""
    s = df.groupBy(*keys).agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.join(s, list(keys)).withColumn(f"{column}_peer_z", (F.col(column) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def number_runs(df: DataFrame, entity: str, order: Sequence[str], name: str = "run_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def synergy_scores(df: DataFrame, keys: Sequence[str], position: str, closing: str) -> DataFrame:
    """0.6 * z(position) + z(closing), and the product of both rescaled to mean 50 and deviation 10."""
    z = group_z(df, keys, [position, closing])
    return z.withColumns({"form_score": 0.6 * F.col(f"{position}_z") + F.col(f"{closing}_z"), "form_product": (F.col(f"{position}_z") * 10 + 50) * (F.col(f"{closing}_z") * 10 + 50)})
