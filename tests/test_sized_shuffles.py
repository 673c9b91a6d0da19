"""Shuffles whose tasks do not grow with the tables, and sums that do not depend on the order of addition."""

import datetime as dt

from pyspark.sql import functions as F

from contestlab.operators import evaluation as E
from contestlab.operators import joins as J
from contestlab.operators import marts as M
from contestlab.operators import windows as W
from contestlab.plans import base as P
from contestlab.plans import features as FM

SF = "/root/testdata/sf0.001"


def test_entries_are_spread_by_their_number(spark, monkeypatch):
    assert P.parts(spark, SF) is None
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(P, "TASK_ROWS", 1000)
    assert P.parts(spark, SF, 1000) == -(-n // 1000)
    assert P.spread(spark.range(10), 9, "id").rdd.getNumPartitions() == 9


def test_conditions_are_summed_where_their_entity_is(spark):
    rows = [(i % 3, dt.date(2020, 1 + i % 4, 1 + i % 20), "ab"[i % 2] if i % 5 else None, i % 7 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "e int, d date, s string, y boolean")
    out = M.level_sums(df, "e", {"overall": None, "s": F.col("s")}, "d", "y", "month", 5)
    want: dict = {}
    for e, d, s, y in rows:
        for c, level in (("overall", "all"), ("s", s)):
            if level is not None:
                n, k = want.get((e, c, level, d.replace(day=1)), (0, 0))
                want[e, c, level, d.replace(day=1)] = (n + 1, k + y)
    assert {(r.e, r.condition, r.level, r.period): (r.n, r.k) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Generate")].count("Exchange") == 0  # nothing moves once a row is one for each condition


def test_totals_of_returns_are_exact(spark):
    rows = [(i, 1e9 if i == 0 else 0.1, 1.2) for i in range(20_001)]
    df = spark.createDataFrame(rows, "contest long, realized_return double, expected_return double").withColumns({"is_bet": F.lit(True), "is_hit": F.lit(True)}).repartition(7)
    assert M.pair_coverage(df, "contest").first().total_return == 1_000_002_000.0


def test_last_of_each_history_before_a_date(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    runs = [(i % 5, day((i * 7) % 40), i, i % 9) for i in range(120)]
    events = [(i % 6, day((i * 11) % 50), i, None if i % 4 == 0 else i % 13) for i in range(90)]
    r, e = spark.createDataFrame(runs, "k int, d date, t int, v int"), spark.createDataFrame(events, "k int, at date, t int, w int")
    out = M.last_of_each(r, {"run": (r, "d", "t", ["v"]), "event": (e, "at", "t", ["w"])}, "k", "d", 3)
    last = lambda rows, k, d: max(((x[1], x[2], x[3]) for x in rows if x[0] == k and x[1] < d), key=lambda x: x[:2], default=None)
    got = {(x.k, x.d): ((x.run.day, x.run.v) if x.run else None, (x.event.day, x.event.w) if x.event else None) for x in out.collect()}
    assert got == {(k, d): tuple(m and (m[0], m[2]) for m in (last(runs, k, d), last(events, k, d))) for k, d in {x[:2] for x in runs}}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1  # rows move once, while they are narrow


def test_tasks_keep_their_rows_below_the_sessions_partitions(spark, monkeypatch):
    """With more shuffle partitions than the tables need Spark would merge them by bytes: the entries have their own number."""
    n, before = spark.read.parquet(f"{SF}/lineitem.parquet").count(), spark.conf.get("spark.sql.shuffle.partitions")
    want = -(-n // 500)
    assert 4 < want < 200
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    monkeypatch.setattr(P.parts, "__defaults__", (500,))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert P.parts(spark, SF) == want
        assert P.entries(spark, SF).rdd.getNumPartitions() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_history_arrays_move_once(spark, monkeypatch):
    """Keys longer than a block, null keys and ends, and history that is the entries themselves: as taken from lists, in one move."""
    rows = [(i, ("a", "b", "c", None)[(i * 7) % 4 if i > 30 else 0], float(i * 3 % 11)) for i in range(90)]
    runs = W.number_runs(spark.createDataFrame(rows, "id int, who string, x double"), "who", ["id"]).withColumn("end", F.when(F.col("id") % 13 != 5, F.col("run_no") - 1))
    monkeypatch.setattr(E, "RUNS", 6)
    want, seen = {}, {}
    for i, who, x in rows:
        past = seen.setdefault(who, [])
        h = past[-4:] if who and i % 13 != 5 else []
        want[i] = (who, h + [0.0] * (4 - len(h)), [True] * len(h) + [False] * (4 - len(h)))
        past.append(x)
    one, two = (E.history_arrays(e, runs, ["id"], "who", "run_no", "end", ["x"], 4) for e in (runs, runs.select("id", "who", "end")))
    for out in (one, two):
        assert out.columns == ["id", "who", "end", "x_history", "history_mask"]
        assert {r.id: (r.who, r.x_history, r.history_mask) for r in out.collect()} == want and out.count() == 90
    assert one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_decayed_rows_equal_decayed_days(spark):
    """Over many spans too, of which each takes on what the one before left."""
    rows = [(i % 3, dt.date(2000, 1, 1) + dt.timedelta(days=(i * 37) % 5000), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, d date, y int")
    for half in (1.0, 3.5, 180.0):
        days = {(r.k, r.d): r.y_decayed for r in J.decayed_window(J.daily(df, ["k"], "d", ["y"]), ["k"], "d", ["y"], half).collect()}
        got = J.decayed_rows(df, ["k"], "d", ["y"], half).collect()
        assert len(got) == 600
        for r in got:
            want = days[r.k, r.d]
            assert (r.y_decayed is None) == (want is None) and abs((want or 0.0) - (r.y_decayed or 0.0)) < 1e-9


def test_feature_matrix_moves_rows_by_contest_rider_and_runner_alone(spark):
    e = P.entries(spark, SF)
    out = FM.feature_matrix_of(e, 5)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 4  # lines and contests by contest, then by rider and by runner
    assert out.count() == e.count()
