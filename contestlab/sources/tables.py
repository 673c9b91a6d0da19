"""Reading, writing and merging tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def own_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share; only a local session without
    that setting gets one of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="contestlab-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/contestlab-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what follows does not work it out anew, whichever executors are lost,
    and reads only the columns that it needs."""
    spark, path = df.sparkSession, f"{own_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """settled, in so many buckets of a key: what joins or sums by that key alone, as dealt out to as many parts, leaves the rows where
    they lie. df should lie in these parts already, or each task writes a file for many buckets."""
    spark, name = df.sparkSession, f"settled_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", f"{own_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


#: Rows up to which a written table is broadcast.
SMALL = 100_000


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has written in between. Results that were not written or collected are lost."""
    place = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def where_expr(conditions: Mapping[str, object] | None) -> Column:
    """Conjunction of column__operator: eq (also without operator), neq, gt, gte, lt, lte, in, like, isnull. An empty
    list for in is false."""
    out = F.lit(True)
    for key, v in (conditions or {}).items():
        name, _, op = key.partition("__")
        c = F.col(name)
        ops = {"": lambda c=c, v=v: c == v, "eq": lambda c=c, v=v: c == v, "neq": lambda c=c, v=v: c != v, "gt": lambda c=c, v=v: c > v, "gte": lambda c=c, v=v: c >= v, "lt": lambda c=c, v=v: c < v, "lte": lambda c=c, v=v: c <= v,
               "in": lambda c=c, v=v: c.isin(*v) if v else F.lit(False), "like": lambda c=c, v=v: c.like(v), "isnull": lambda c=c, v=v: c.isNull() if v else c.isNotNull()}
        if op not in ops:
            raise ValueError(f"unknown operator {op!r} in {key!r}")
        out = out & ops[op]()
    return out


def order_exprs(items: Sequence[str]) -> list[Column]:
    """`-column` or `column DESC` for descending; nulls last either way."""
    out = []
    for item in items:
        name, _, way = item.lstrip("-").partition(" ")
        down = item.startswith("-") or way.strip().lower() == "desc"
        out.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return out


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Mapping | None = None, order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(where_expr(where))
    if order_by:
        df = df.orderBy(*order_exprs(order_by))
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, n: int, **properties: str) -> DataFrame:
    """A database table read by n tasks over ranges of partition_column."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=n, properties=properties)


def even_predicates(column: str, edges: Sequence[float]) -> list[str]:
    """SQL conditions that cut a column at its edges: every row fits one, rows with a null the last."""
    cuts = [repr(e) if isinstance(e, float) and not e.is_integer() else str(int(e)) for e in edges]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} > {a} and {column} <= {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} <= {cuts[0]}", *inner, f"{column} > {cuts[-1]} or {column} is null"]


def read_jdbc_even(spark: SparkSession, url: str, table: str, partition_column: str, n: int, quote: str = '"', **properties: str) -> DataFrame:
    """A database table read by at most n tasks of about as many rows each, however the numeric partition_column is spread: the column
    alone is read first, by ranges of equal width, and its exact quantiles are where the table is cut. A value that many rows
    share is not cut. `quote` is what the database puts around names."""
    from contestlab.operators.ranks import exact_quantiles

    name = f"{quote}{partition_column}{quote}"
    found = spark.read.jdbc(url, f"(select min({name}) as low, max({name}) as high from {table}) x", properties=properties).first()
    low, high = found[0], found[1]
    if low is None or low == high or n < 2:
        return spark.read.jdbc(url, table, properties=properties)
    values = spark.read.jdbc(url, f"(select {name} from {table}) x", column=partition_column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=n, properties=properties)
    edges = exact_quantiles(values.toDF("v"), [], "v", [i / n for i in range(1, n)]).first()[0]
    return spark.read.jdbc(url, table, predicates=even_predicates(name, sorted(set(edges))), properties=properties)


def select_one(df: DataFrame, where: Mapping | None = None, order_by: Sequence[str] = ()):
    """The first row, or None."""
    df = df.where(where_expr(where))
    return next(iter((df.orderBy(*order_exprs(order_by)) if order_by else df).limit(1).collect()), None)


def read_dim(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV dimension with typed columns."""
    return spark.read.csv(path, schema=schema, header=True)


def export_parquet(df: DataFrame, path: str, where: Mapping | None = None, compression: str = "snappy") -> int:
    """Write the rows that fit and return their number, counted while they are written."""
    seen = Observation()
    df.where(where_expr(where)).observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", compression).parquet(path)
    return seen.get["rows"]


def cache_table(df: DataFrame, path: str) -> DataFrame:
    """Write once; later calls read what is there."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(path)
    except Exception as e:  # Spark reports a missing path only as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.parquet(path)
    return spark.read.parquet(path)


def limit_groups(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """All rows of the first n groups: groups are ranked, not rows, and the ranking moves one row per group."""
    first = df.groupBy(group).agg(*[F.min(c.lstrip("-")).alias(c.lstrip("-")) for c in order if c.lstrip("-") != group])
    return df.join(first.orderBy(*order_exprs([*order, group])).limit(n).select(group), group, "left_semi")


def with_multiplicity(df: DataFrame, keys: Sequence[str], name: str = "multiplicity") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def bind_columns(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Logical names for physical columns; a binding to None is a null column."""
    return df.select(*[(F.col(p) if p else F.lit(None)).alias(name) for name, p in mapping.items()])


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of target whose keys are not updated, and the updates; columns are synchronised."""
    return target.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def recalc_bounds(target: DataFrame, column: str, recalc: int, history: int, unit: str = "months") -> tuple:
    """First period to recalculate and first period of history that this needs."""
    back = (lambda n: F.add_months(F.max(column), -n)) if unit == "months" else (lambda n: F.date_sub(F.max(column), n))
    return tuple(target.agg(back(recalc).alias("a"), back(recalc + history).alias("b")).first())


def load_after(df: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows above the target's highest value; all rows while the target is empty."""
    high = target.agg(F.max(column)).first()[0]
    return df if high is None else df.where(F.col(column) > F.lit(high))


def load_overlap(df: DataFrame, target: DataFrame, column: str, days: int = 7) -> DataFrame:
    high = target.agg(F.date_sub(F.max(F.col(column).cast("date")), days)).first()[0]
    return df if high is None else df.where(F.col(column).cast("date") >= F.lit(high))


def scope_dates(df: DataFrame, column: str, today, target=None, start=None, end=None, default_days: int = 7) -> DataFrame:
    """One date, a range, or else the last days up to a given day."""
    d = F.col(column)
    if target is not None:
        return df.where(d == F.lit(target))
    if start is not None or end is not None:
        return df.where((d >= F.lit(start) if start is not None else F.lit(True)) & (d <= F.lit(end) if end is not None else F.lit(True)))
    return df.where(d.between(F.date_sub(F.lit(today), default_days), F.lit(today)))


def sync_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
