"""Tables that are kept or compared: incremental rates, database reads, parity by checksums, band histories, entries in streams."""

import datetime as dt
import os
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contestlab.operators import checks as K
from contestlab.operators import joins as J
from contestlab.operators import windows as W
from contestlab.operators.incremental import KeptRates
from contestlab.sources import tables as S


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.mark.parametrize("periods", [2, 35])
def test_incremental_rates_equal_a_full_rebuild(spark, tmp_path, periods):
    rng = random.Random(periods)
    day = lambda m, d: dt.date(2010 + m // 12, 1 + m % 12, d)
    rows = [(i, rng.choice(["a", "b", "c", None]), day(rng.randrange(60), rng.randrange(1, 28)), rng.randrange(2)) for i in range(900)] + [(2000, "lone", day(30, 2), 1), (2001, "d", day(3, 3), 1), (2002, "d", day(50, 3), 0)]
    df = lambda x: spark.createDataFrame(x, "i int, k string, day date, y int")
    late = [r for r in rows if r[0] % 3 == 1 and r[2] < day(12, 1) and r[2] >= day(10, 1)]
    wrong = [r for r in rows if r[0] % 5 == 1 and r[2].month == 9 and r[2].year == 2011 or r[0] == 2001]
    gone = [(3000, "gone", day(41, 5), 1), (3001, "a", day(70, 5), 1)]  # rows that are deleted later; month 70 has no others
    first = [(i, k, d, 1 - y if (i, k, d, y) in wrong else y) for i, k, d, y in rows if (i, k, d, y) not in late] + gone
    kept = KeptRates(spark, str(tmp_path / "kept"), ["k"], "day", "y", periods, "month", 0.3, 20)
    kept.rebuild(df(first))
    before = files(kept.rates)
    written = kept.refresh(df(rows), df(late + wrong + gone).select("day"))
    want = W.rolling_rate(df(rows), ["k"], "day", "y", periods, "month", 0.3, 20)
    got = spark.read.parquet(kept.rates).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    after = files(kept.rates)
    untouched = [f for f in before if not any(f"period={p}/" in f for p in written)]
    assert all(after.get(f) == before[f] for f in untouched)
    if periods == 2:
        assert untouched
    assert not any("period=2015-11" in f for f in after)
    assert kept.refresh(df(rows), df(late).select("day")) == [] and files(kept.rates) == after  # nothing has changed
    assert kept.refresh(df(rows), df(rows).where("false").select("day")) == []


def test_database_read_in_even_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, int(rng.expovariate(1.0) ** 4 * 100) if i % 50 else None, f"t{i}") for i in range(6000)]
    url = f"jdbc:derby:memory:t{os.getpid()};create=true"
    spark.createDataFrame(rows, "id int, amount int, note string").write.jdbc(url, "wide_table")
    df = S.read_jdbc_even(spark, url, "wide_table", "amount", 6)
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert Counter(map(tuple, df.collect())) == Counter(rows)
    assert len(parts) == 6 and max(parts) < 2 * sum(parts) / 6
    even = S.read_jdbc(spark, url, "wide_table", "amount", 0, max(r[1] or 0 for r in rows), 6)
    wide = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert max(wide) > 5000  # ranges of equal width put nearly all rows into one part
    spark.createDataFrame([(1, 7), (2, 7)], "id int, amount int").write.jdbc(url, "one_value")
    assert S.read_jdbc_even(spark, url, "one_value", "amount", 4).count() == 2


def test_parity_by_checksums(spark):
    rng = random.Random(5)
    a = [(i % 500, rng.choice(["x", None, ""]), rng.choice([1.5, None])) for i in range(2000)]
    b = [r for k, r in enumerate(a) if k % 400] + [(7, "new", None), (9, None, 1.5), (9, None, 1.5)]
    x, y = (spark.createDataFrame(t, "k int, s string, v double") for t in (a, b))
    for buckets in (1, 64, 1 << 16):
        got = Counter(map(tuple, K.symmetric_difference(x, y, buckets).collect()))
        assert got == Counter({(*r, "left"): n for r, n in (Counter(a) - Counter(b)).items()}) + Counter({(*r, "right"): n for r, n in (Counter(b) - Counter(a)).items()})
    assert K.symmetric_difference(x, x.repartition(3)).isEmpty() and K.symmetric_difference(x.limit(0), x.limit(0)).isEmpty()
    one = spark.createDataFrame([(i, i * 2 if i % 9 else None, "p") for i in range(300)], "k int, v int, w string")
    two = one.where("k <> 4").withColumn("v", F.when(F.col("k") % 50 == 1, F.lit(-1)).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(999, None, None)], one.schema))
    got = {(r.k, r.left_row and r.left_row.v, r.right_row and r.right_row.v) for r in K.rows_differ(one, two, ["k"], ["v", "w"]).collect()}
    assert got == {(4, 8, None), (999, None, None)} | {(k, k * 2 if k % 9 else None, -1) for k in range(300) if k % 50 == 1}


def test_equal_buckets_are_not_shuffled(spark, tmp_path):
    spark.range(50_000).select("id", (F.col("id") * 3).alias("v")).write.parquet(str(tmp_path / "a"))
    x = spark.read.parquet(str(tmp_path / "a"))
    y = x.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    left, right = K._unequal(x, y, ["id"], ["id", "v"], 1 << 16)
    assert left.count() == right.count() < 20
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "exchange hashpartitioning(id" not in plan.lower()


def test_band_history_is_the_sum_of_all_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), dt.date(2000 + rng.randrange(8), rng.randrange(1, 13), 1), float(rng.choice([rng.randrange(0, 3000, 50), 1000, 1000])), rng.randrange(2)) for _ in range(1500)] + [("lone", dt.date(2001, 1, 1), 5.0, 1), ("a", None, 1000.0, 1), ("a", dt.date(2003, 5, 1), None, 1)]
    df = spark.createDataFrame(rows, "k string, p date, b double, y int")
    got = {(r.k, r.p, r.b): (r.past_n, r.past_y) for r in J.band_history(df, ["k"], "p", "b", 200, 3, ["y"]).collect()}
    assert got.keys() == {r[:3] for r in rows}
    for (k, p, b), v in got.items():
        if None in (k, p, b):
            assert v == (None, None)
            continue
        back = dt.date(p.year - 3, p.month, 1)
        past = [r[3] for r in rows if r[0] == k and r[1] and r[2] is not None and back <= r[1] < p and abs(r[2] - b) <= 200]
        assert v == ((len(past), sum(past)) if past else (None, None))


def test_band_history_of_a_hot_key(spark):
    """A hot key whose rows nearly all lie within each other's bands."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.add_months(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 40).cast("int")).alias("p"), (F.col("id") * 1.0).alias("b"), F.lit(1).alias("y"))
    out = J.band_history(df, ["k"], "p", "b", 2000, 3, ["y"])
    assert out.agg(F.max("past_n")).first()[0] > 1000
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4000


def test_band_history_of_small_wide_and_long_keys(spark, monkeypatch):
    """Keys that lie whole in a task, keys of many neighbours and keys of many rows come out alike; small ones move once."""
    monkeypatch.setattr(J, "WHOLE_KEY", 150)
    monkeypatch.setattr(J, "BAND_ROWS", 100)
    rng, month = random.Random(9), lambda: dt.date(2000 + rng.randrange(6), rng.randrange(1, 13), 1)
    rows = [(k, month(), rng.randrange(0, top, step) * 1.0, rng.randrange(2)) for k, top, step, n in (("small", 900, 50, 120), ("other", 900, 50, 90), ("wide", 400, 1, 140), ("long", 3000, 50, 700)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, p date, b double, y int")
    got = {(r.k, r.p, r.b): (r.past_n, r.past_y) for r in J.band_history(df, ["k"], "p", "b", 200, 3, ["y"]).collect()}
    assert got.keys() == {r[:3] for r in rows}
    for (k, p, b), v in got.items():
        past = [r[3] for r in rows if r[0] == k and dt.date(p.year - 3, p.month, 1) <= r[1] < p and abs(r[2] - b) <= 200]
        assert v == ((len(past), sum(past)) if past else (None, None))
    out = J.band_history(df.where("k in ('small', 'other')"), ["k"], "p", "b", 200, 3, ["y"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_entries_without_quotes_stay_in_the_stream(spark, tmp_path):
    from contestlab.streaming import quotes as Z

    t0, rng = dt.datetime(2024, 1, 1), random.Random(4)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    quotes = [(rng.randrange(8), at(5 * i + rng.randrange(3)), i, float(i) if i % 6 else None) for i in range(400)]
    entries = [(k, at(-60 if k % 2 else 100), at(300 + 150 * k)) for k in range(8)] + [(20, at(10), at(500)), (21, at(20), None), (22, at(0), at(90_000)), (3, at(30), at(400))]
    q, e = spark.createDataFrame(quotes, "k int, at timestamp, id int, v double"), spark.createDataFrame(entries, "k int, declared timestamp, cutoff timestamp")
    for df, name, by in ((q, "q", "at"), (e, "e", "declared")):
        df.repartitionByRange(4, by).sortWithinPartitions(by).write.parquet(str(tmp_path / name))
        for i, f in enumerate(sorted((tmp_path / name).glob("part-*"))):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    feed = lambda df, name, n: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / name))
    out = Z.prestart_entries_stream(feed(q, "q", 1), feed(e, "e", 10), ["k"], "at", "declared", "cutoff", "id", ["v"], "1 hour")
    target = str(tmp_path / "out")
    Z.put_by_key(spark.createDataFrame([(20, at(500), at(499), 1, 9.9)], out.schema), ["k"], target, 4)  # of an earlier run
    Z.entries_to_table(out, ["k"], target, str(tmp_path / "cp"), 4).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(target).select(*out.columns).collect()}
    want = Z.prestart_entries(q, e, ["k"], "at", "cutoff", "id", ["v"]).select(*out.columns)
    closed = F.col("cutoff").isNull() | (F.col("cutoff") < F.lit(max(r[1] for r in quotes) - dt.timedelta(hours=1)))
    assert got == {tuple(r) for r in want.where(closed).collect()}
    assert (20, at(500), None, None, None) in got and (21, None, None, None, None) in got and all(r[0] != 22 for r in got)  # 20 had an older quote
