"""Ranks, running totals and exact quantiles of whole tables, without a task that sees all values: rows are dealt into ranges
of values, and what lies before a range is added to what is counted within it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.sources.tables import SMALL, settled

#: Ranges at most, and rows of the sample that sets their edges, for each of them.
MOST_RANGES, SAMPLED = 256, 40


def _literal(value: object) -> Column:
    return F.lit(value) if not isinstance(value, dt.datetime) else F.to_timestamp(F.lit(value.isoformat(sep=" ")))


def _place(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def range_edges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> Column:
    """The lower ends of about equal ranges of df's rows, as an array: from a sample by hash, so that it is the same whenever
    it is taken, of a size that doesn't grow with df. Equal rows are one row of the sample with their count."""
    ranges = ranges or min(MOST_RANGES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = max(1, df.count() // (ranges * SAMPLED))
    part = df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).groupBy(*order).agg(F.count(F.lit(1)).alias("__n")).orderBy(*order).limit(4 * ranges * SAMPLED).collect()
    total, seen, edges = sum(r["__n"] for r in part), 0, []
    for r in part:
        if seen * ranges >= (len(edges) + 1) * total:
            edges.append(r)
        seen += r["__n"]
    cell = lambda r: [_literal(r[c]).cast(df.schema[c].dataType).alias(c) for c in order]
    kind = df.select(_place(order).alias("x")).schema["x"].dataType
    return F.array(*[F.struct(*cell(r)) if len(order) > 1 else cell(r)[0] for r in edges[: ranges - 1]]).cast(f"array<{kind.simpleString()}>")


#: What a search by halves may add to the number of a range, from the widest stride on.
STRIDES = [1 << k for k in range(15, -1, -1)]


def range_of(order: Sequence[str], edges: Column, most: int = MOST_RANGES) -> Column:
    """The number of the range that a row lies in, of at most `most`: a search by halves among the edges."""
    strides = F.array(*[F.lit(x) for x in STRIDES if x <= most])
    search = lambda place: F.aggregate(strides, F.lit(0), lambda low, x: F.when(F.get(edges, low + x - 1) <= place, low + x).otherwise(low))
    return F.transform(F.array(_place(order)), search)[0]  # so the row's place is built once


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """df with, for each name, the total over the rows of the same group that come before in order, and {name}_all, the group's.

    A window sorts the rows of one range of a group; one small table of totals by range says what to add. Rows of equal order
    don't count for each other in any defined way: order should be unique in a group, or df have one row a value. Rows with a null
    among the keys of a group are left out; nulls in order come first. df is written, as it is read several times."""
    order, names, df = list(order), list(sums), settled(df)
    held = df.withColumn("__range", range_of(order, range_edges(df, order, ranges), ranges or MOST_RANGES))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # at most MOST_RANGES rows a group meet here
    lists = totals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__range", *names))).alias("__t"))

    def total(n: str, xs: Column) -> Column:
        zero = F.lit(0).cast(totals.schema[n].dataType)
        return F.aggregate(xs, zero, lambda a, x: (a + F.coalesce(x[n], zero)).cast(totals.schema[n].dataType))

    before = F.transform("__t", lambda x, i: F.struct(x["__range"].alias("__range"), *[total(n, F.slice("__t", 1, i)).alias(f"__before_{n}") for n in names]))
    starts = lists.select(*by, *[total(n, F.col("__t")).alias(f"{n}_all") for n in names], F.explode(before).alias("__b")).select(*by, *[f"{n}_all" for n in names], "__b.*")
    own = held.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = own.join(starts, [*by, "__range"])
    return out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in names}).drop("__range", *[f"__before_{n}" for n in names])


def _small(df: DataFrame) -> DataFrame:
    """df written, and broadcast if it is small."""
    held = settled(df)
    return F.broadcast(held) if held.count() <= SMALL else held


def rank_bucket(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, name: str, ranges: int | None = None) -> DataFrame:
    """df with the number, from 1, of the bucket of the row's rank in its group, by n linear quantiles of the ranks (fewer where the
    group has fewer rows). order must tell rows apart; rows with a null among the keys of a group are left out.

    df is written with each row's range. Counts by range say in which ranges a bucket starts: only these are sorted, to find its
    first row, and only their rows are compared with it. All others have the bucket of their range."""
    keys, long = [*by, "__range"], lambda x: F.lit(x).cast("long")
    held = settled(df.withColumn("__range", range_of(order, range_edges(df, order, ranges), ranges or MOST_RANGES)))
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # at most MOST_RANGES rows a group meet here
    lists = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__range", "__n"))).alias("__t"), F.sum("__n").alias("__all"))
    q = F.least(long(n), F.col("__all"))
    ends = F.transform(F.when(q > 1, F.sequence(long(1), q - 1)).otherwise(F.array().cast("array<long>")), lambda b: F.floor((b * (F.col("__all") - 1)) / q) + 1)
    start = F.transform("__t", lambda x, i: F.struct(x["__range"].alias("__range"), F.aggregate(F.slice("__t", 1, i), long(0), lambda a, y: a + y["__n"]).alias("__start"), x["__n"].alias("__size")))
    cells = lists.select(*by, ends.alias("__ends"), F.explode(start).alias("__c")).select(*by, "__ends", "__c.*")
    inside = lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size"))
    cells = settled(cells.select(*keys, "__start", F.size(F.filter("__ends", lambda r: r < F.col("__start"))).alias("__base"), F.filter("__ends", inside).alias("__in")))
    w = Window.partitionBy(*keys).orderBy(*order)
    near = held.select(*keys, *order).join(_small(cells.where(F.size("__in") > 0)), keys).withColumn("__r", F.col("__start") + F.row_number().over(w) - 1)
    place = F.struct(*order)
    found = near.where(F.array_contains("__in", F.col("__r"))).groupBy(*keys).agg(F.collect_list(place).alias("__firsts"))
    lookup = cells.select(*keys, "__base").join(found, keys, "left")
    lookup = F.broadcast(lookup) if cells.count() <= SMALL else lookup
    bucket = F.col("__base") + 1 + F.coalesce(F.size(F.filter("__firsts", lambda e: e <= place)), F.lit(0))
    return held.join(lookup, keys).withColumn(name, F.when(F.col("__firsts").isNull(), F.col("__base") + 1).otherwise(bucket).cast("int")).drop("__range", "__base", "__firsts")


def distinct_counts(df: DataFrame, by: Sequence[str], column: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each value (not null) of a group: n, and further sums."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (sums or {}).items()])


def exact_quantiles(df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float], name: str = "quantiles", ranges: int | None = None) -> DataFrame:
    """One row for each group with the array of exact quantiles (linear between ranks) of a column; nulls don't count.

    First rows are counted by range, which moves no values; the counts say which ranges hold the wanted ranks. Only the values
    of those ranges are counted, sorted and looked up. A group without values has no row."""
    d = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__v"))
    d = d.withColumn("__range", range_of(["__v"], range_edges(d, ["__v"], ranges), ranges or MOST_RANGES))
    counts = d.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    lists = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__range", "__n"))).alias("__t"), F.sum("__n").alias("__all"))
    spot = [F.lit(float(p)) * (F.col("__all") - 1) for p in probs]
    low = lists.withColumns({f"__h{i}": s for i, s in enumerate(spot)})
    ends = F.array(*[f(F.col(f"__h{i}")) for i in range(len(probs)) for f in (F.floor, F.ceil)])
    starts = F.transform("__t", lambda x, i: F.struct(x["__range"].alias("__range"), F.aggregate(F.slice("__t", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["__n"]).alias("__start"), x["__n"].alias("__size")))
    cells = low.withColumn("__ends", ends).withColumn("__c", F.explode(starts)).select(*by, "__ends", "__all", "__c.*")
    cells = cells.where(F.exists("__ends", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size"))))
    keys = [*by, "__range"]
    if by:
        near = d.join(_small(cells.select(*keys)), keys, "left_semi")
    else:  # at most two ranges for each quantile
        near = d.where(F.col("__range").isin([r[0] for r in cells.select("__range").collect()] or [-1]))
    v = near.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")).join(cells, keys)
    w = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("__first", F.col("__start") + F.coalesce(F.sum("__n").over(w), F.lit(0)))
    at = lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__n"))
    found = v.where(F.exists("__ends", at)).groupBy(*by).agg(
        F.max("__all").alias("__all"), *[F.max(F.when(at(F.col("__ends")[2 * i]), F.col("__v"))).alias(f"__a{i}") for i in range(len(probs))], *[F.max(F.when(at(F.col("__ends")[2 * i + 1]), F.col("__v"))).alias(f"__b{i}") for i in range(len(probs))]
    )
    share = [s - F.floor(s) for s in spot]
    return found.where(F.col("__all").isNotNull()).select(*by, F.array(*[F.col(f"__a{i}") * (1 - share[i]) + F.col(f"__b{i}") * share[i] for i in range(len(probs))]).alias(name))
