"""Marts: odds of pairs, histories that stay where they lie."""

import datetime as dt
import math

from pyspark.sql import functions as F

from contestlab.operators import joins as J
from contestlab.operators import marts as M
from contestlab.plans import marts as PM
from contestlab.sources import tables as S


def test_pair_odds_are_rounded_as_sql_rounds(spark):
    """10 times a price may lie on the half where its digits lie just below it."""
    rows = [(23501, i, float(q), t, f, 5) for i, (q, t, f) in enumerate([(13, 0.07, 1), (26, 0.07, 2), (2, 0.08, 4), (10, 0.02, 3), (34, 0.06, 5)], 1)]
    e = spark.createDataFrame(rows, "contest_id long, entry_no long, quantity double, tax double, finish long, field_size long")
    got = {(r.i, r.j): r.odds for r in PM.priced_pairs(e).collect()}
    total, by_no = sum(r[2] for r in rows), {r[1]: r for r in rows}
    price = {(i, j): (1 + by_no[i][3] * 2 + by_no[j][3]) * 0.8 / (by_no[i][2] / total * (by_no[j][2] / total) * 2) for i in by_no for j in by_no if i < j}
    assert got == {k: math.floor(x * 10 + 0.5) / 10 for k, x in price.items()}
    assert 51.849999999999994 in price.values() and 51.9 in got.values()


def test_condition_histories_move_rows_once(spark):
    """Dates without a start under a level, levels that are not asked for, and null levels and labels: as summed pair by pair."""
    day = lambda i: dt.date(2015, 1, 1) + dt.timedelta(days=i)
    rows = [(i % 7, day((i * 37) % 2400), ("A", "N", "X", None)[i % 4], None if i % 11 == 0 else i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "who int, d date, s string, y int")
    out = M.condition_history(df, "who", "s", ["A", "N", "R"], "d", "y", 180, 3, 5)
    assert out.columns == ["who", "d", "starts_A", "hits_A", "starts_N", "hits_N", "starts_R", "hits_R"]
    got = {(r.who, r.d): r for r in out.collect()}
    assert got.keys() == {r[:2] for r in rows}
    for (who, d), r in got.items():
        back = [x for x in rows if x[0] == who and x[1] < d and x[1] >= d.replace(year=d.year - 3, day=min(d.day, 28) if d.month == 2 else d.day)]
        for level in "ANR":
            w = [(0.5 ** ((d - x[1]).days / 180), x[3] or 0) for x in back if x[2] == level]
            want = (sum(a for a, _ in w), sum(a * y for a, y in w)) if back else (None, None)
            assert all((a is None) == (b is None) and abs((a or 0) - (b or 0)) < 1e-9 for a, b in zip((r[f"starts_{level}"], r[f"hits_{level}"]), want, strict=True))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def made_rows(spark):
    day = lambda i: dt.date(2014, 1, 1) + dt.timedelta(days=i)
    rows = [(i // 3, i % 3, day((i * 91) % 2900), None if i % 17 == 0 else i % 5, ("A", "N", None)[i % 3 if i % 4 else 0], i % 4, i % 2, float(i * 7 % 23)) for i in range(360)]
    return rows, spark.createDataFrame(rows, "c long, no long, d date, who int, s string, other int, y int, v double")


def test_rates_of_rows_move_rows_once(spark):
    """Null entities and levels, periods that were not seen, starts counted already: as looked up row by row."""
    rows, df = made_rows(spark)
    for n, asked in ((None, None), ("other", F.col("d") >= F.lit("2018-01-01").cast("date"))):
        out = M.rates_of_rows(df, ["c", "no"], M.Encoding("who", {"overall": None, "s": F.col("s")}, "month", 3, 10), "d", n, "y", 0.3, 5, asked)
        want = {}
        for c, no, d, who, s, *_ in rows:
            if asked is not None and d < dt.date(2018, 1, 1):
                continue
            rates = []
            for known, same in ((who is not None, lambda x: x[3] == who), (None not in (who, s), lambda x: (x[3], x[4]) == (who, s))):
                periods = sorted({x[2].replace(day=1) for x in rows if same(x) and x[2].replace(day=1) < d.replace(day=1)})[-3:]
                past = [x for x in rows if same(x) and x[2].replace(day=1) in periods]
                rates.append((sum(x[6] for x in past) + 3) / (sum(x[5] if n else 1 for x in past) + 10) if known else None)
            want[c, no] = tuple(rates)
        got = {(r.c, r.no): (r.who_overall, r.who_s) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(a is b is None or abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_past_of_rows_moves_rows_once(spark):
    """Decayed histories and last rows of two histories, for short and long half-lives, null keys and levels and dates of several rows."""
    rows, df = made_rows(spark)
    seen = [(None if i % 13 == 0 else i % 6, dt.date(2014, 1, 1) + dt.timedelta(days=(i * 53) % 3000), i, float(i)) for i in range(200)]
    side = spark.createDataFrame(seen, "who int, at date, tie int, score double")
    back = lambda d: d.replace(year=d.year - 3, day=min(d.day, 28) if d.month == 2 else d.day)
    for half in (2.0, 180.0):
        last = {"run": (None, "d", F.col("c") * 100 + F.col("no"), ["v"]), "event": (side, "at", F.col("tie"), ["score"])}
        out = M.past_of_rows(df, ["c", "no"], "who", "d", {"all": None, "s": F.col("s")}, ["y"], half, 3, last, 5)
        got = {(r.c, r.no): r for r in out.collect()}
        assert len(got) == len(rows) == out.count()
        for c, no, d, who, s, *_ in rows:
            r = got[c, no]
            if who is None:
                assert (r.who, r.all_n, r.all_y, r.s_n, r.run, r.event) == (None,) * 6
                continue
            for name, same in (("all", lambda x: x[3] == who), ("s", lambda x: (x[3], x[4]) == (who, s))):
                w = [(0.5 ** ((d - x[2]).days / half), x[6]) for x in rows if same(x) and back(d) <= x[2] < d]
                assert abs(r[f"{name}_n"] - sum(a for a, _ in w)) < 1e-9 and abs(r[f"{name}_y"] - sum(a * y for a, y in w)) < 1e-9
            run = max(((x[2], x[0] * 100 + x[1], x[7]) for x in rows if x[3] == who and x[2] < d), default=None)
            event = max(((x[1], x[2], x[3]) for x in seen if x[0] == who and x[1] < d), default=None)
            assert (r.run and (r.run.day, r.run.v)) == (run and (run[0], run[2])) and (r.event and (r.event.day, r.event.score)) == (event and (event[0], event[2]))
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_kept_rows_stay_where_they_lie(spark):
    rows, df = made_rows(spark)
    kept = S.settled_by(df.repartition(5, "c"), "c", 5)
    found = df.where("no <> 1").select("c", "no", (F.col("v") * 2).alias("twice"))
    out = J.beside(J.beside(kept, found, "c", "no", ["twice"], "x", 5), kept.where("no = 2").select("c", "no", "y"), "c", "no", ["y"], "z")
    assert {(r.c, r.no): (r.x and r.x.twice, r.z and r.z.y) for r in out.collect()} == {(x[0], x[1]): (None if x[1] == 1 else x[7] * 2, x[6] if x[1] == 2 else None) for x in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # that of what was found


def test_the_shared_row_moves_narrow_rows_alone(spark):
    """Without broadcasts of large tables: what histories need of the entries moves out and what they found moves back; no row does."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e, n = PM.kept_entries(spark, "/root/testdata/sf0.001")
        out = PM.pre_race_rows(spark, "/root/testdata/sf0.001", e, n, PM.contexts_in_place(e, PM.last_date(e), n))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by = lambda key: sum(f"hashpartitioning({key}#" in m for m in moves)
    assert by("contest_id") == 3  # riders', runners' and trainers' answers
    assert by("runner") == 2 and by("__e") == 2 and len(moves) <= 16
    assert out.count() == e.count()


def test_kept_entries_are_a_file_a_part(spark, monkeypatch):
    """Also where the session has more partitions, to which Spark would deal the lines out anew."""
    monkeypatch.setattr(PM, "TASK_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in ("50", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", session)
            e, n = PM.kept_entries(spark, "/root/testdata/sf0.001")
            assert n >= 12 and len(e.inputFiles()) <= n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
