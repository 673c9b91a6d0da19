"""Rolling rates that are kept as tables: sums by period, and rates by period; late and corrected rows rebuild the partitions
that they touch and no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions.columns import smooth_rate
from contestlab.operators.windows import by_period
from contestlab.sources.tables import settled


class KeptRates:
    """The smoothed rate of label over the n observed periods before each period, for each key, as two Parquet tables in a folder:
    `sums` and `rates`, with a partition for each period.

    rebuild() writes both from all rows. refresh() takes the rows as they are now and the dates whose rows are new, late,
    corrected or gone: it sums the rows of these periods anew, finds for the keys that changed which of their later
    periods look back at them, and writes these partitions, and no others, in place. Both come to the same tables."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], date: str, label: str, periods: int, unit: str, prior: float, strength: float):
        self.spark, self.sums, self.rates = spark, f"{folder.rstrip('/')}/sums", f"{folder.rstrip('/')}/rates"
        self.keys, self.date, self.label, self.periods, self.unit, self.prior, self.strength = list(keys), date, label, periods, unit, prior, strength

    def _frame(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("period").rowsBetween(-self.periods, -1)

    def _rated(self, sums: DataFrame) -> DataFrame:
        past = lambda c: F.coalesce(F.sum(c).over(self._frame()), F.lit(0))
        out = sums.withColumns({"past_n": past("n"), "past_k": past(self.label)})
        return out.select(*self.keys, "period", "past_n", "past_k", smooth_rate("past_k", "past_n", self.prior, self.strength).alias("rate"))

    def _sums(self, rows: DataFrame) -> DataFrame:
        return by_period(rows.where(F.col(self.date).isNotNull()), self.keys, self.date, self.unit, [self.label])

    def _put(self, df: DataFrame, path: str, periods: Sequence | None = None) -> None:
        """Write partitions. Those of `periods` that have no row any more are deleted."""
        df = df.repartition("period") if periods is not None else df.repartitionByRange("period")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if periods is not None else "static").partitionBy("period").parquet(path)
        if periods is None:
            return
        there = {r[0] for r in df.select("period").distinct().collect()}
        for p in set(periods) - there:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/period={p}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def read(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path).select(*schema.names)
        except AnalysisException as e:  # nothing is left or was ever written
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rebuild(self, rows: DataFrame) -> None:
        sums = settled(self._sums(rows))
        self._put(sums, self.sums)
        self._put(self._rated(sums), self.rates)

    def refresh(self, rows: DataFrame, changed: DataFrame) -> list:
        """changed: a column with the dates of changed rows. Returns the periods whose rates were written, in order."""
        touched = changed.select(F.trunc(F.col(changed.columns[0]), self.unit).alias("period")).where("period is not null").distinct()
        periods = sorted(r[0] for r in touched.collect())  # calendar periods: few, however many rows changed
        if not periods:
            return []
        dates = self._dates(periods)
        new = settled(self._sums(rows.where(dates)))
        before = self.read(self.sums, new.schema)
        old = settled(before.where(F.col("period").isin(periods)))
        both = [*self.keys, "period"]
        moved = old.exceptAll(new).unionByName(new.exceptAll(old)).select(*both).distinct().withColumn("__moved", F.lit(1))
        moved = settled(moved)
        self._put(new, self.sums, periods)
        sums = self.read(self.sums, new.schema)
        # for the changed keys: their periods, those that are gone as well, and which of them look back at a changed one
        alike = moved.select(*self.keys).distinct()
        same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in self.keys]
        trail = sums.select(*both).unionByName(moved.select(*both)).distinct()
        trail = trail.alias("t").join(alike.alias("a"), same("t", "a"), "left_semi")
        marked = trail.alias("t").join(moved.alias("m"), [*same("t", "m"), F.col("t.period") == F.col("m.period")], "left")
        trail = marked.select("t.*", F.coalesce("m.__moved", F.lit(0)).alias("__moved"))
        here = Window.partitionBy(*self.keys).orderBy("period").rowsBetween(-self.periods - len(periods), 0)
        stale = trail.withColumn("__stale", F.max("__moved").over(here)).where("__stale = 1")
        write = sorted({r[0] for r in stale.select("period").distinct().collect()})
        if write:
            asked = sums.where(F.col("period").isin(write)).select(*self.keys).distinct()
            rates = self._rated(sums.alias("s").join(asked.alias("a"), same("s", "a"), "left_semi")).where(F.col("period").isin(write))
            self._put(settled(rates), self.rates, write)
        return write

    def _dates(self, periods: Sequence) -> Column:
        """Rows of some periods, as ranges of the date that a scan can push down."""
        out, step = F.lit(False), {"month": 1, "quarter": 3, "year": 12}[self.unit]
        for p in periods:
            first = F.lit(p)
            out = out | ((F.col(self.date) >= first) & (F.col(self.date) < F.add_months(first, step)))
        return out
