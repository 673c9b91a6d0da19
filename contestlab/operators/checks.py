"""Data-quality checks: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.joins import last_before


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Buckets whose checksums are compared first; the unequal ones, at most so many small rows, are broadcast.
BUCKETS = 1 << 16


def _row_hash(cols: Sequence[str]) -> Column:
    """64 bits of a row; where the nulls are counts too."""
    return F.xxhash64(*cols, *[F.isnull(c) for c in cols])


def _unequal(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in the buckets (of the keys) whose checksums differ: number of rows, and sums of both halves of
    their hashes. Each task adds up its own rows, so only checksums are shuffled; equal buckets' rows stay where they are."""
    def split(df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(_row_hash(keys), F.lit(buckets)).cast("int"))

    def sums(df: DataFrame) -> DataFrame:
        h = _row_hash(cols)
        return df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"))

    x, y = split(a), split(b)
    both = sums(x).withColumn("__side", F.lit(1)).unionByName(sums(y).withColumn("__side", F.lit(2)))
    bad = both.groupBy("__bucket", "n", "high", "low").agg(F.count(F.lit(1)).alias("sides")).where("sides = 1").select("__bucket").distinct()
    return tuple(z.join(F.broadcast(bad), "__bucket", "left_semi").drop("__bucket") for z in (x, y))


def symmetric_difference(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one side alone, repeats counted. Checksums of buckets are compared first, and rows only where they differ (rows of a
    bucket that differ and have the same count and the same sums of 64-bit hashes would go unseen)."""
    x, y = _unequal(a, b.select(*a.columns), a.columns, a.columns, buckets)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def column_boundary(df: DataFrame, allowed: Sequence[str] | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """Columns that are not allowed, missing, or forbidden, with the number of rows in which they hold a value: what would leak
    through the boundary. One aggregate counts all of them."""
    bad = {c: "forbidden" if c in forbidden else "not_allowed" for c in df.columns if c in forbidden or allowed is not None and c not in allowed}
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("violation"), F.count(c).alias("n_values")) for c, v in bad.items()]
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("violation"), F.lit(0).cast("long").alias("n_values")) for c in allowed or () if c not in df.columns]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, violation string, n_values long")
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def not_null(*cols: str) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNotNull() for c in cols}


def accepted(c: str, values: Sequence) -> dict[str, Column]:
    return {f"{c}_accepted": F.col(c).isin(*values)}


def late_quotes(quotes: DataFrame, keys: Sequence[str], published: str, cutoff: str) -> DataFrame:
    return quotes.groupBy(*keys).agg(F.bool_or(F.col(published) > F.col(cutoff)).alias("late")).where("late")


def incomplete_fields(entries: DataFrame, contests: DataFrame, contest: str, declared: str) -> DataFrame:
    """Contests whose entries are missing or not as many as declared."""
    n = entries.groupBy(contest).agg(F.count("*").alias("n_entries"))
    both = contests.select(contest, declared).join(n, contest, "full")
    return both.where(~F.col(declared).eqNullSafe(F.col("n_entries")))


def broken_sequence(df: DataFrame, key: str, number: str, date: str) -> DataFrame:
    """Runs that do not follow the one before by number and time."""
    w = Window.partitionBy(key).orderBy(number)
    last, then = F.lag(number).over(w), F.lag(date).over(w)
    return df.withColumns({"__l": last, "__t": then}).where((F.col(number) != F.coalesce(F.col("__l"), F.lit(0)) + 1) | (F.col("__t") > F.col(date))).drop("__l", "__t")


def broken_pointer(entries: DataFrame, history: DataFrame, key: str, date: str, end: str, number: str, then: str) -> DataFrame:
    """Entries whose end number is not the number of history rows strictly before their date."""
    past = last_before(entries, history, key, date, then, number, [number])
    return past.where(F.col(end) != F.coalesce(f"last_{number}", F.lit(0))).withColumnRenamed(f"last_{number}", "last_no")


def rows_differ(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Keys whose rows differ in any column, nulls being equal to each other. Only the rows of buckets whose checksums differ are
    joined."""
    x, y = _unequal(a.select(*keys, *cols), b.select(*keys, *cols), keys, [*keys, *cols], buckets)
    x, y = x.select(*keys, F.struct(*cols).alias("left_row")), y.select(*keys, F.struct(*cols).alias("right_row"))
    return x.join(y, list(keys), "full").where(~F.col("left_row").eqNullSafe(F.col("right_row")))


def uncovered(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    return facts.select(*keys).distinct().join(dimension.select(*keys), list(keys), "left_anti")


def frame_checks(df: DataFrame, keys: Sequence[str], number: str, identifier: str) -> DataFrame:
    """Null keys, repeated keys, entry numbers that are no positive integers, and identifiers kept as floating point."""
    if dict(df.dtypes)[identifier] in ("float", "double"):
        raise TypeError(f"{identifier} must not be floating point")
    n = F.count("*").over(Window.partitionBy(*keys))
    rules = not_null(*keys) | {"key_unique": n == 1, "number_positive": (F.col(number) >= 1) & (F.col(number) % 1 == 0)}
    return violations(df.withColumns({f"__rule_{k}": v for k, v in rules.items()}), {k: F.col(f"__rule_{k}") for k in rules}).drop(*[f"__rule_{k}" for k in rules])


def bundle_checks(entries: DataFrame, contest: str, date: str, declared: str, label: str) -> DataFrame:
    """Contests with several dates, not as many entries as declared, or labels other than 0 and 1."""
    g = entries.groupBy(contest).agg(F.count_distinct(date).alias("dates"), F.count("*").alias("n"), F.max(declared).alias("declared"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_labels"))
    return violations(g, {"one_date": F.col("dates") == 1, "full_field": F.col("n") == F.col("declared"), "labels": F.col("bad_labels") == 0})
