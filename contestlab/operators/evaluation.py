"""Splits, preprocessing, metrics, reliability and summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import wilson
from contestlab.operators.boosting import grow
from contestlab.operators.ranks import distinct_counts, exact_quantiles, rank_bucket, running_totals
from contestlab.operators.regression import fitted, logistic_fits, standardised
from contestlab.sources.tables import settled


def year_split(df: DataFrame, year: str, start: int, end: int) -> dict[str, DataFrame]:
    """Train [start, end), validation end, test end + 1; raises if one is empty."""
    parts = {"train": df.where((F.col(year) >= start) & (F.col(year) < end)), "validation": df.where(F.col(year) == end), "test": df.where(F.col(year) == end + 1)}
    for name, p in parts.items():
        if p.isEmpty():
            raise ValueError(f"no rows for {name}")
    return parts


def partition_contests(df: DataFrame, contest: str, date: str, label: str, train_end, val_end) -> DataFrame:
    """split: train, validation or test by the contest's date; contests with an unknown label are left out whole."""
    w = Window.partitionBy(contest)
    known = F.max(F.col(label).isNull().cast("int")).over(w) == 0
    return df.withColumns({"__known": known, "split": F.when(F.col(date) < F.lit(train_end), "train").when(F.col(date) < F.lit(val_end), "validation").otherwise("test")}).where("__known").drop("__known")


def coerce_features(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("__NA__")) for c in categories} | {c: F.col(c).try_cast("double") for c in numbers})


def fit_preprocess(train: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> tuple[dict, DataFrame]:
    """Means and population deviations of the training rows (0 and 1 where there is none), and the vocabulary as a table
    (column_name, value, code): 0 pads, 1 is unknown, 2 is missing, codes from 3 go by value."""
    row = train.agg(*[f for c in numbers for f in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).first()
    stats = {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in numbers}
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in categories])).alias("x")).select("x.*").where("value is not null").distinct()
    return stats, long.withColumn("code", F.row_number().over(Window.partitionBy("column_name").orderBy("value")) + 2)


def apply_preprocess(df: DataFrame, stats: dict, vocabulary: DataFrame, categories: Sequence[str]) -> DataFrame:
    out = df.withColumns({f"{c}_std": F.coalesce((F.col(c) - m) / s, F.lit(0.0)) for c, (m, s) in stats.items()} | {f"{c}_missing": F.col(c).isNull() for c in stats})
    for c in categories:
        v = vocabulary.where(F.col("column_name") == c).select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"__{c}_code"))
        out = out.join(v, F.col(c).cast("string") == F.col(f"__{c}"), "left").withColumn(f"{c}_code", F.when(F.col(c).isNull(), 2).otherwise(F.coalesce(f"__{c}_code", F.lit(1)))).drop(f"__{c}", f"__{c}_code")
    return out


#: Numbers of a key that lie together when entries look for their history.
RUNS = 100_000


def history_arrays(entries: DataFrame, history: DataFrame, row: Sequence[str], key: str, number: str, end: str, values: Sequence[str], k: int) -> DataFrame:
    """Entries (row, key and end number) with the last k history rows up to their end number, oldest first, padded on the right with
    zeros, and the mask of real places. A null key or number is not looked at, a null key or end looks at nothing.

    Entries and history lie side by side, ordered by number, and a window of k numbers looks back from each entry: nothing is paired,
    and rows move once. A long key is cut into blocks of numbers, and a row at the end of one also stands in the next. Where history
    is entries itself, both are read from one scan, and rows that lie by key stay where they are."""
    kept = list(dict.fromkeys([*row, key, end]))
    block = lambda c: F.floor(c / RUNS)
    no = F.col(number).cast("long")
    one, run = F.struct(*[c for c in kept if c != key]), F.struct(no.alias("__no"), *values)
    types = entries.select(one.alias("__e")).schema["__e"].dataType, history.select(run.alias("__r")).schema["__r"].dataType
    ask = F.array(F.struct(block(F.col(end)).alias("__block"), F.col(end).cast("long").alias("__at"), one.alias("__e"), F.lit(None).cast(types[1]).alias("__r")))
    runs = F.transform(F.array_distinct(F.array(block(no), block(no + k - 1))), lambda b: F.struct(b.alias("__block"), no.alias("__at"), F.lit(None).cast(types[0]).alias("__e"), run.alias("__r")))
    usable = F.col(key).isNotNull() & no.isNotNull()
    laid = lambda df, rows: df.select(key, F.explode(rows).alias("__x")).select(key, "__x.*")
    both = laid(entries, F.when(usable, F.concat(ask, runs)).otherwise(ask)) if history is entries else laid(entries, ask).unionByName(laid(history.where(usable), runs))
    back = Window.partitionBy(key, "__block").orderBy("__at").rangeBetween(1 - k, 0)
    out = both.withColumn("__h", F.array_sort(F.collect_list("__r").over(back))).where("__e is not null").select(key, "__e.*", "__h")
    n = F.size("__h")
    pad = lambda c: F.concat(F.transform("__h", lambda x: x[c].cast("double")), F.array_repeat(F.lit(0.0), k - n))
    return out.select(*kept, *[pad(v).alias(f"{v}_history") for v in values], F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), k - n)).alias("history_mask"))


def _field(name: str):
    return lambda x: x[name].cast("double")


def contest_batches(df: DataFrame, contest: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row per contest: values in entry order, padded to the size of the largest contest, and the mask."""
    g = settled(df.groupBy(contest).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("__b")))
    width, n = g.agg(F.max(F.size("__b"))).first()[0] or 0, F.size("__b")
    return g.select(contest, *[F.concat(F.transform("__b", _field(v)), F.array_repeat(F.lit(0.0), width - n)).alias(v) for v in values], F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), width - n)).alias("mask"))


def expanding_folds(df: DataFrame, date: str, start, months: int, folds: int) -> DataFrame:
    """Rows by fold and part: train before the fold's month, validation in the months that follow (half-open)."""
    f = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    lo, hi = F.add_months(F.lit(start).cast("date"), F.col("fold") * months), F.add_months(F.lit(start).cast("date"), (F.col("fold") + 1) * months)
    return f.withColumn("part", F.when(F.col(date) < lo, "train").when(F.col(date) < hi, "validation")).where("part is not null")


def year_folds(df: DataFrame, year: str, contest: str) -> tuple[DataFrame, DataFrame]:
    """Rows by fold: each year but the first validates on all years before; and contests on both sides (leaks)."""
    years = sorted(r[0] for r in df.select(year).distinct().collect())
    f = df.withColumn("fold", F.explode(F.array(*[F.lit(y) for y in years[1:]]))).where(F.col(year) <= F.col("fold")).withColumn("part", F.when(F.col(year) == F.col("fold"), "validation").otherwise("train"))
    return f, f.groupBy("fold", contest).agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def binary_metrics(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC by average ranks, Brier score and log-loss. Rows are counted by probability first, and distinct values are ranked in
    ranges; AUC is null where there is one class."""
    v = distinct_counts(df.where(F.col(label).isNotNull()).withColumn("__p", F.col(prob)), by, "__p", {"k": F.sum(F.col(label).cast("long"))})
    v = running_totals(v, by, ["__p"], {"below": F.col("n")})
    p = F.least(F.greatest(F.col("__p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    a = v.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("k").alias("n_pos"), F.sum(F.col("k") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("__r"),
        (F.sum(F.col("k") * F.pow(F.col("__p") - 1, 2) + (F.col("n") - F.col("k")) * F.pow(F.col("__p"), 2)) / F.sum("n")).alias("brier"), (-F.sum(F.col("k") * F.ln(p) + (F.col("n") - F.col("k")) * F.ln(1 - p)) / F.sum("n")).alias("logloss"),
    )
    k, n = F.col("n_pos").cast("double"), F.col("n").cast("double")
    return a.withColumn("auc", (F.col("__r") - k * (k + 1) / 2) / F.nullif(k * (n - k), F.lit(0.0))).drop("__r")


def oof_predictions(df: DataFrame, year: str, contest: str, features: Sequence[str], label: str, iterations: int = 10, depth: int = 4) -> DataFrame:
    """Each row of every year but the first with p, as the model of all earlier years says; the models of all years grow side by
    side. Raises where a contest stands on both sides of a fold."""
    years = sorted(r[0] for r in df.select(year).distinct().collect())
    if not df.groupBy(contest).agg(F.count_distinct(year).alias("n")).where("n > 1").isEmpty():
        raise ValueError("contests on both sides of a fold")
    later = F.filter(F.array(*[F.lit(str(y)) for y in years[1:]]), lambda y: y > F.col(year).cast("string")) if len(years) > 1 else F.array().cast("array<string>")
    trees = grow(df, features, label, later, iterations, depth)
    out = trees.probabilities(df.where(F.col(year) > F.lit(years[0])) if years else df, F.array(F.col(year).cast("string")), "__p")
    return out.withColumn("p", F.col("__p")[0]).drop("__p")


def platt_fit(oof: DataFrame, logit: str, ln_odds: str, label: str) -> tuple[float, float, float]:
    """Logistic regression of the label on the model's logit and the log price, with L2 strength 1."""
    fit = logistic_fits(oof, label, {"platt": [logit, ln_odds]})["platt"]
    if fit.coef is None:
        raise ValueError("labels of one class only")
    return fit.coef[logit], fit.coef[ln_odds], fit.intercept


def compare_slices(df: DataFrame, condition: str, label: str, base: str, local: str, least: int = 100, sizes: DataFrame | None = None) -> DataFrame:
    """Per condition: the metrics of two predictions for its rows side by side, what local gains over base, and whether the
    log-loss is better. sizes (condition, train_rows, train_positives) says which local models may be compared: those with rows
    enough and both classes; others are skipped with the reason."""
    sides = F.array(F.struct(F.lit("base").alias("side"), F.col(base).alias("p")), F.struct(F.lit("local").alias("side"), F.col(local).alias("p")))
    long = df.select(condition, F.col(label).alias("y"), F.explode(sides).alias("x")).select(condition, "y", "x.*")
    m = binary_metrics(long, "y", "p", [condition, "side"])
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = m.groupBy(condition).agg(F.coalesce(pick("base", "n"), F.lit(0)).alias("test_rows"), *[pick(s, c).alias(f"{c}_{s}") for s in ("base", "local") for c in ("auc", "brier", "logloss")])
    if sizes is None:
        sizes = wide.select(condition, F.lit(least).alias("train_rows"), F.lit(1).alias("train_positives"))
    wide = sizes.join(wide, condition, "left")
    few, single = F.col("train_rows") < least, F.col("train_positives").isin(0) | (F.col("train_positives") == F.col("train_rows"))
    reason = F.when(few, "too_few_rows").when(single, "single_class").when(F.coalesce("test_rows", F.lit(0)) == 0, "no_test_rows")
    out = wide.withColumn("skip_reason", reason)
    out = out.withColumns({f"{c}_local": F.when(F.col("skip_reason").isNull(), F.col(f"{c}_local")) for c in ("auc", "brier", "logloss")})
    out = out.withColumns({f"delta_{c}": F.col(f"{c}_local") - F.col(f"{c}_base") for c in ("auc", "brier", "logloss")})
    return out.withColumns({"test_rows": F.coalesce("test_rows", F.lit(0)), "improved": F.col("delta_logloss") < 0})


def summarise_slices(slices: DataFrame) -> DataFrame:
    """One row for all slices of compare_slices(): counts, and means of metrics and deltas over the compared ones, weighted by test
    rows (a null metric has no weight)."""
    compared = F.col("logloss_local").isNotNull()
    n = F.when(compared, F.col("test_rows"))

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * n) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), n)), F.lit(0))

    names = [f"{c}_{s}" for s in ("base", "local") for c in ("auc", "brier", "logloss")] + [f"delta_{c}" for c in ("auc", "brier", "logloss")]
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("test_rows"))), F.lit(0))
    return slices.agg(
        F.count("*").alias("slices"), F.count_if(compared).alias("compared_slices"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_slices"), F.count_if("improved").alias("improved_slices"),
        rows(F.lit(True)).alias("test_rows"), rows(compared).alias("compared_test_rows"), rows(F.coalesce("improved", F.lit(False))).alias("improved_test_rows"), *[mean(c).alias(f"weighted_{c}") for c in names],
    )


def condition_split(df: DataFrame, condition: str, features: Sequence[str], label: str, train: Column, least: int = 100, iterations: int = 10, depth: int = 4) -> DataFrame:
    """compare_slices() of a model of all training rows and a model of the condition's training rows alone, both tried on the
    condition's test rows. All models grow side by side; rows without a condition count for the first one only."""
    base, own = F.lit("all"), F.concat(F.lit("of:"), F.col(condition).cast("string"))
    held = settled(df.select(condition, *features, label, F.coalesce(train, F.lit(False)).alias("__train")))
    both = F.when(own.isNotNull(), F.array(base, own)).otherwise(F.array(base))
    learning = held.where("__train")
    trees = grow(learning, features, label, both, iterations, depth)
    test = trees.probabilities(held.where(~F.col("__train") & own.isNotNull()), F.array(base, own), "__p")
    sizes = learning.where(own.isNotNull() & F.col(label).isNotNull()).groupBy(condition).agg(F.count("*").alias("train_rows"), F.sum(F.col(label).cast("long")).alias("train_positives"))
    return compare_slices(test.select(condition, label, F.col("__p")[0].alias("p_base"), F.col("__p")[1].alias("p_local")), condition, label, "p_base", "p_local", least, sizes)


def reliability_table(df: DataFrame, prob: str, label: str, n: int) -> DataFrame:
    """Rows by quantile bins of the probability (equal edges are one): size, mean probability, rate and their gap."""
    found = exact_quantiles(df, [], prob, [i / n for i in range(n + 1)]).first()
    edges = sorted(set(found[0])) if found else []
    b = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        b = F.when(F.col(prob) > e, i).otherwise(b)
    out = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p_mean"), F.avg(label).alias("rate"))
    return out.withColumn("gap", F.col("rate") - F.col("p_mean"))


def reliability_by_band(df: DataFrame, band: str, prob: str, label: str, least: int = 1) -> DataFrame:
    out = df.groupBy(band).agg(F.count("*").alias("n"), F.avg(prob).alias("p_mean"), F.avg(label).alias("rate")).where(F.col("n") >= least)
    return out.withColumn("gap", F.col("rate") - F.col("p_mean"))


def reliability_curves(df: DataFrame, band: str, prob: str, label: str, tie: Sequence[str], bins: int, least: int = 1) -> DataFrame:
    """A reliability table for each band: rows by rank-quantile bins of the probability within the band; bins with few rows are left
    out."""
    b = rank_buckets(df.where(F.col(band).isNotNull()), prob, tie, bins, "bin", [band])
    out = b.groupBy(band, "bin").agg(F.count("*").alias("n"), F.avg(prob).alias("p_mean"), F.avg(label).alias("rate")).where(F.col("n") >= least)
    return out.withColumn("gap", F.col("rate") - F.col("p_mean"))


def nested_buckets(df: DataFrame, outer: str, inner: str, tie: Sequence[str], n_outer: int, n_inner: int, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-quantile buckets of one column within those of another: bucket_summary() of each pair."""
    b = rank_buckets(df, outer, tie, n_outer, "outer_bucket", by)
    b = rank_buckets(b, inner, tie, n_inner, "bucket", [*by, "outer_bucket"])
    return bucket_summary(b, [*by, "outer_bucket", "bucket"], inner, label)


def sum_check(df: DataFrame, group: str, probs: Sequence[str], k: Column) -> DataFrame:
    s = df.groupBy(group).agg(*[F.sum(p).alias(p) for p in probs], F.max(k).alias("__k"))
    return s.agg(*[F.avg(F.abs(F.col(p) - F.col("__k"))).alias(f"{p}_mean_abs") for p in probs])


def error_metrics(df: DataFrame, actual: str, predictors: Sequence[str]) -> DataFrame:
    long = df.select(actual, F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("value")) for p in predictors])).alias("x")).select(actual, "x.*").where(F.col("value").isNotNull() & F.col(actual).isNotNull())
    d = F.col("value") - F.col(actual)
    return long.groupBy("predictor").agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))


def gap_summary(df: DataFrame, split: str, delta: str, match: Column, label: str) -> DataFrame:
    d = df.withColumn("__abs", F.abs(delta))
    out = d.groupBy(split).agg(F.count("*").alias("n"), F.avg("__abs").alias("mean_abs"), F.avg(match.cast("double")).alias("match_rate"), F.avg(label).alias("label_rate"))
    return out.join(exact_quantiles(d, [split], "__abs", [0.5]), split, "left").withColumn("median_abs", F.col("quantiles")[0]).drop("quantiles")


def rank_buckets(df: DataFrame, column: str, tie: Sequence[str], n: int, name: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """Bucket of the row's rank (ties by `tie`, which tells rows apart) between linear quantiles of the ranks. Only the ranges of
    column and tie together in which a bucket starts are sorted, so that a value that many rows share is no large task either."""
    return rank_bucket(df.where(F.col(column).isNotNull()), by, [column, *tie], n, name)


def bucket_summary(df: DataFrame, keys: Sequence[str], column: str, label: str) -> DataFrame:
    """Size, mean of the column, rate and its Wilson interval."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.sum(F.col(label).cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": F.col("k") / F.col("n"), "low": low, "high": high})


def segment_contrast(df: DataFrame, keys: Sequence[str], bucket: str, label: str) -> DataFrame:
    """Rates of the first and the last bucket of each segment side by side."""
    cells = df.where(F.col(bucket).isNotNull()).groupBy(*keys, bucket).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    side = lambda f: f(F.struct("n", "rate"), F.col(bucket))
    out = cells.groupBy(*keys).agg(side(F.min_by).alias("__lo"), side(F.max_by).alias("__hi"))
    out = out.select(*keys, F.col("__lo.n").alias("n_first"), F.col("__hi.n").alias("n_last"), F.col("__lo.rate").alias("rate_first"), F.col("__hi.rate").alias("rate_last"))
    return out.withColumn("difference", F.col("rate_first") - F.col("rate_last"))


def rank_correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks. Rows are counted by pair of values first; what meets the tables of ranks is a row a pair, and
    it is merged with them: the size of a written table says too little about its rows for them to be broadcast."""
    pairs = settled(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__m")))

    def ranks(c: str, name: str) -> DataFrame:
        """Distance of each value's average rank from the mean rank, so that sums of products keep their digits."""
        v = running_totals(pairs.groupBy(*by, c).agg(F.sum("__m").alias("n")), by, [c], {"below": F.col("n")})
        return v.select(*by, c, (F.col("below") + (F.col("n") - F.col("below_all")) / 2.0).alias(name))

    both = pairs.hint("merge").join(ranks(x, "__a"), [*by, x]).hint("merge").join(ranks(y, "__b"), [*by, y])
    total = lambda c: F.sum(F.col("__m") * c)
    a, b = F.col("__a"), F.col("__b")
    return both.groupBy(*by).agg((total(a * b) / F.nullif(F.sqrt(total(a * a)) * F.sqrt(total(b * b)), F.lit(0.0))).alias("rank_correlation"), F.coalesce(F.sum("__m"), F.lit(0).cast("long")).alias("n"))


def _model_metrics(df: DataFrame, label: str, fits: dict) -> dict[str, dict]:
    rows = binary_metrics(fitted(df, label, fits), "y", "p", ["design"]).collect()
    return {r["design"]: {c: r[c] for c in ("n", "auc", "brier", "logloss")} for r in rows}


def effect_summary(df: DataFrame, cols: Sequence[str], label: str, controls: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Per column: size, label rate, means by label and their difference, the rank correlation with `order` (the label if none is
    given), the standardised logistic coefficient (L2 strength 1) alone and beside the controls, and both models' metrics. All
    columns and both designs are fitted by the same passes. A column counts where it and the label have a value; one that is
    constant, or whose rows have one class, has a null effect."""
    spark, known = df.sparkSession, F.col(label).isNotNull()
    held = settled(standardised(df.select(label, *dict.fromkeys([*cols, *controls, *([order] if order else [])])), cols, dict.fromkeys(cols, known)))
    designs = {f"{c}/alone": [f"{c}_z"] for c in cols} | ({f"{c}/controlled": [f"{c}_z", *controls] for c in cols} if controls else {})
    fits = logistic_fits(held, label, designs)
    metrics = _model_metrics(held, label, fits)
    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]
    long = held.select(F.col(label).cast("double").alias("y"), F.col(order or label).cast("double").alias("__order"), F.explode(F.array(*each)).alias("x")).select("x.*", "y", "__order").where("value is not null and y is not null")
    one, zero = F.avg(F.when(F.col("y") >= 0.5, F.col("value"))), F.avg(F.when(F.col("y") < 0.5, F.col("value")))
    means = long.groupBy("column_name").agg(F.count("*").alias("n"), F.avg("y").alias("label_rate"), one.alias("mean_positive"), zero.alias("mean_negative"), (one - zero).alias("mean_difference"), F.stddev_pop("value").alias("__sd"))
    rank = rank_correlation(long, "value", "__order", ["column_name"]).select("column_name", "rank_correlation")

    def row(c: str) -> tuple:
        out: list = [c]
        for d in (f"{c}/alone", f"{c}/controlled"):
            f, m = fits.get(d), metrics.get(d, {})
            out += [f.coef[f"{c}_z"] if f and f.coef else None, m.get("auc"), m.get("brier"), m.get("logloss"), f.rows if f else None]
        return tuple(out)

    schema = "column_name string, " + ", ".join(f"effect{s} double, auc{s} double, brier{s} double, logloss{s} double, n_model{s} long" for s in ("", "_controlled"))
    models = F.broadcast(spark.createDataFrame([row(c) for c in cols], schema))  # a row for each column of df that is looked at
    out = means.join(models, "column_name").join(rank, "column_name", "left").withColumns({e: F.when(F.col("__sd") > 0, F.col(e)) for e in ("effect", "effect_controlled")})
    return out.drop("__sd", "n_model")


def interaction_effects(df: DataFrame, pairs: Mapping[str, tuple[str, str]], label: str, derived: Callable[[str, str], Column], controls: Sequence[str] = ()) -> DataFrame:
    """Per pair of columns (first, second), over the rows that have both and the label: the coefficient of the product of their
    standardised values in a model that has both, and that of a standardised column derived from them beside the controls. Signs
    of the single columns are turned, as smaller is better; all pairs are fitted by the same passes."""
    spark, known = df.sparkSession, F.col(label).isNotNull()
    have = {k: known & F.col(a).isNotNull() & F.col(b).isNotNull() for k, (a, b) in pairs.items()}
    wide = df.withColumns({f"{k}__{i}": F.when(have[k], c) for k, (a, b) in pairs.items() for i, c in enumerate((F.col(a).cast("double"), F.col(b).cast("double"), derived(a, b)))})
    names = [f"{k}__{i}" for k in pairs for i in range(3)]
    held = standardised(wide.select(label, *controls, *names), names).withColumns({f"{k}__{i}_z": -F.col(f"{k}__{i}_z") for k in pairs for i in (0, 1)})
    held = settled(held.withColumns({f"{k}__x": F.col(f"{k}__0_z") * F.col(f"{k}__1_z") for k in pairs}))
    designs = {f"{k}/product": [f"{k}__0_z", f"{k}__1_z", f"{k}__x"] for k in pairs} | {f"{k}/derived": [f"{k}__2_z", *controls] for k in pairs}
    fits = logistic_fits(held, label, designs)
    metrics = _model_metrics(held, label, fits)
    means = held.agg(*[f for k in pairs for f in (*[F.avg(f"{k}__{i}").alias(f"{k}__{i}") for i in range(3)], F.count(f"{k}__x").alias(f"{k}_n"))]).first()

    def row(k: str) -> tuple:
        p, d = fits[f"{k}/product"], fits[f"{k}/derived"]
        a, b = metrics.get(f"{k}/product", {}), metrics.get(f"{k}/derived", {})
        return (k, means[f"{k}_n"], *[means[f"{k}__{i}"] for i in range(3)], p.coef[f"{k}__x"] if p.coef else None, a.get("auc"), a.get("brier"), d.coef[f"{k}__2_z"] if d.coef else None, b.get("auc"), b.get("brier"))

    return spark.createDataFrame([row(k) for k in pairs], "pair string, n long, mean_first double, mean_second double, mean_derived double, product_effect double, product_auc double, product_brier double, derived_effect double, derived_auc double, derived_brier double")


def pairwise_tests(df: DataFrame, group: str, metric: str) -> DataFrame:
    """For each two groups (few by nature): mean and median difference, Cohen's d, the Kolmogorov-Smirnov distance and the
    Mann-Whitney U with its normal p-value. Values are counted first; cumulative counts run over distinct values."""
    d = df.where(F.col(metric).isNotNull())
    s = d.groupBy(group).agg(F.count("*").alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v"))
    s = s.join(exact_quantiles(d, [group], metric, [0.5]), group).withColumn("med", F.col("quantiles")[0])
    side = lambda x: s.select(*[F.col(c).alias(f"{c}_{x}") for c in (group, "n", "m", "v", "med")])
    pairs = side("a").join(side("b"), F.col(f"{group}_a") < F.col(f"{group}_b"))
    counts = d.groupBy(group, metric).agg(F.count("*").alias("c"))
    a = pairs.join(counts, F.col(group) == F.col(f"{group}_a")).select(f"{group}_a", f"{group}_b", "n_a", "n_b", metric, F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb"))
    b = pairs.join(counts, F.col(group) == F.col(f"{group}_b")).select(f"{group}_a", f"{group}_b", "n_a", "n_b", metric, F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb"))
    u = a.unionByName(b).groupBy(f"{group}_a", f"{group}_b", "n_a", "n_b", metric).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    u = running_totals(u, [f"{group}_a", f"{group}_b"], [metric], {"fa": F.col("ca"), "fb": F.col("cb")})
    u = u.withColumns({"fa": F.col("fa") + F.col("ca"), "fb": F.col("fb") + F.col("cb")})
    t = u.groupBy(f"{group}_a", f"{group}_b").agg(F.max(F.abs(F.col("fa") / F.col("n_a") - F.col("fb") / F.col("n_b"))).alias("ks"), F.sum(F.col("ca") * (F.col("fb") - F.col("cb") / 2.0)).alias("u"))
    out = pairs.join(t, [f"{group}_a", f"{group}_b"])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
    z = (F.col("u") - F.col("n_a") * F.col("n_b") / 2.0) / F.sqrt(F.col("n_a") * F.col("n_b") * (F.col("n_a") + F.col("n_b") + 1) / 12.0)
    # normal tail by the Abramowitz-Stegun polynomial, good to 1e-7
    k = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))
    return out.select(f"{group}_a", f"{group}_b", (F.col("m_a") - F.col("m_b")).alias("mean_diff"), (F.col("med_a") - F.col("med_b")).alias("median_diff"), ((F.col("m_a") - F.col("m_b")) / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"), "ks", "u", (2 * tail).alias("p_value"))
