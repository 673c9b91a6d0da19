"""Group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.operators.ranks import exact_quantiles


def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[f for c in cols for f in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sq"))])


def quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: Sequence[float]) -> DataFrame:
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(*[F.lit(x) for x in qs])).alias("__q"))
    return q.select(*keys, *[F.col("__q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(qs)])


def condition_long(df: DataFrame, keys: Sequence[str], groups: dict[str, tuple], values: Sequence[str]) -> DataFrame:
    """One row per row and condition group (name: key columns, at most two), in one pass over df."""
    part = [F.struct(F.lit(g).alias("condition_group"), F.col(c[0]).cast("string").alias("key1"), (F.col(c[1]).cast("string") if len(c) > 1 else F.lit(None).cast("string")).alias("key2")) for g, c in groups.items()]
    return df.select(*keys, *values, F.explode(F.array(*part)).alias("__c")).select(*keys, "__c.*", *values)


def pivot_max(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence, column: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(pivot) == v, F.col(column))).alias(f"{column}_{v}".lower().replace(" ", "_").replace("-", "_")) for v in values])


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def mode_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label, the lowest of equals."""
    return df.groupBy(key, label).agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("mode_label"))


def profile_share(df: DataFrame, key: str, category: str, categories: Sequence) -> DataFrame:
    n = F.count_if(F.col(category).isin(*categories))
    return df.groupBy(key).agg(*[(F.count_if(F.col(category) == c) / F.nullif(n, F.lit(0))).alias(f"share_{c}".lower()) for c in categories])


def distribution_summary(df: DataFrame, group: Sequence[str], metric: str, label: str | None = None) -> DataFrame:
    """n, observed share, mean, deviation, median and percentiles of a metric, and the label's rate."""
    extra = [F.avg(label).alias("label_rate")] if label else []
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.count(metric).alias("n_present"), (F.count(metric) / F.count("*")).alias("present_rate"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), *extra)
    at = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    out = out.join(exact_quantiles(df, group, metric, [*at.values()]), list(group), "left")
    return out.withColumns({c: F.col("quantiles")[i] for i, c in enumerate(at)}).drop("quantiles")


def entity_summary(df: DataFrame, key: str, metric: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.avg(F.col(metric).isNull().cast("double")).alias("missing_rate"))


def availability_summary(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("__x")).select(label, "__x.*")
    rate = F.avg(F.when(F.col("value").isNotNull(), F.col(label)))
    out = long.groupBy("column_name").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("present_rate"), F.avg("value").alias("mean"), rate.alias("label_rate_present"))
    q = exact_quantiles(long, ["column_name"], "value", [0.5, 0.1, 0.9])
    return out.join(q, "column_name", "left").select("column_name", "present_rate", "mean", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("median", "p10", "p90"))], "label_rate_present")


def draws_ranking(draws: DataFrame, key: str, value: str, rope: float) -> DataFrame:
    """Mean, central 95 %, and the share of draws beyond +-rope, which flags effects of 0.95 or more."""
    beyond = F.avg((F.abs(F.col(value)) > rope).cast("double"))
    return draws.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), beyond.alias("p_beyond")).withColumn("flagged", F.col("p_beyond") >= 0.95)
