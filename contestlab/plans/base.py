"""The driver's tables in the roles of contest data, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import place_label
from contestlab.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that says the same. `with entry` is put before it where it
    reads from entry."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql.replace("/*ENTRY*/", ENTRY)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", columns or None)


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df


#: Entries that one task sorts.
TASK_ROWS = 250_000


def parts(spark: SparkSession, sf_dir: str, rows: int = TASK_ROWS) -> int | None:
    """The number of tasks over which a shuffle of all entries is spread, so that what one of them sorts doesn't grow with the
    tables; None where they are too few to matter. It is given even where the session has more partitions, since Spark
    merges those by their bytes and a task's rows then grow with the tables. The count reads the file's footer."""
    n = -(-table(spark, sf_dir, "lineitem").count() // rows)
    return n if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def spread(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return df.repartition(n, *keys) if n else df


def entries(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """Contests are orders, entries their line items, numbered by the columns that make a line unique. One shuffle by
    contest (to n parts, if given) serves the join and the windows."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    li = spread(li, n or parts(spark, sf_dir), "l_orderkey")
    w = Window.partitionBy("contest_id")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("contest_id"), F.col("o_orderdate").cast("date").alias("held_date"), F.col("l_partkey").alias("runner"), F.col("l_suppkey").alias("rider"), F.col("o_custkey").alias("trainer"),
        F.col("l_returnflag").alias("surface"), F.col("l_linestatus").alias("turn"), F.col("o_orderpriority").alias("klass"), "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    e = e.withColumns({"entry_no": F.row_number().over(w.orderBy("runner", "rider", "l_linenumber", "price")).cast("long"), "field_size": F.count("*").over(w), "finish": F.rank().over(w.orderBy(F.desc("price"))).cast("long")})
    return e.withColumns({"is_win": (F.col("finish") == 1).cast("int"), "is_place": place_label("finish", "field_size")}).drop("l_linenumber")


ENTRY = """entry as (select *, case when finish = 1 then 1 else 0 end is_win, case when finish <= case when field_size < 8 then 2 else 3 end then 1 else 0 end is_place from (
select l_orderkey contest_id, cast(o_orderdate as date) held_date, l_partkey runner, l_suppkey rider, o_custkey trainer, l_returnflag surface, l_linestatus turn, o_orderpriority klass, l_quantity quantity, l_extendedprice price, l_discount discount, l_tax tax,
row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) entry_no, count(*) over (partition by l_orderkey) field_size, rank() over (partition by l_orderkey order by l_extendedprice desc) finish
from lineitem join orders on l_orderkey = o_orderkey))"""
