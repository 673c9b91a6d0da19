"""Small fixtures with worked-out results, leakage and brute force for what has no SQL twin."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.functions import columns as C
from contestlab.operators import checks as K
from contestlab.operators import effects as X
from contestlab.operators import evaluation as E
from contestlab.operators import joins as J
from contestlab.operators import quotes as Q
from contestlab.operators import windows as W
from contestlab.sources import tables as S

T = dt.datetime(2026, 6, 13, 12, 0)


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(c).first()[0]


def test_cleaning(spark):
    assert one(spark, C.clean_num("x", ["", "----", "****"], 10), x=" 0040 ") == 4.0
    assert one(spark, C.clean_num("x", ["", "----"], 10), x="----") is None and one(spark, C.clean_num("x"), x="abc") is None
    assert one(spark, C.composite_id(["a", "b"], [4, 2]), a="2026", b=" 7") == 202607
    assert one(spark, C.clock_to_seconds("x"), x="1345") == 94.5 and one(spark, C.clock_to_seconds("x"), x="0000") is None
    assert one(spark, C.pair_key("x"), x="12-07") == "07-12" and one(spark, C.pair_key("x"), x="1207") == "07-12"
    assert one(spark, C.extract_number("x"), x=" 456(+4)") == 456.0 and one(spark, C.extract_number("x"), x="n/a") is None
    assert [one(spark, C.signed_value("s", "m"), s=s, m="4") for s in "+- "] == [4, -4, None]


@pytest.mark.parametrize(("year", "text", "ref", "want"), [(2026, "12312359", "2026-01-01", dt.datetime(2025, 12, 31, 14, 59)), (2026, "06121831", "2026-06-13", dt.datetime(2026, 6, 12, 9, 31)), (2026, "00000000", "2026-06-13", None), (2026, "99999999", "2026-06-13", None), (2025, "01010005", "2025-12-31", dt.datetime(2025, 12, 31, 15, 5))])
def test_year_rollover(spark, year, text, ref, want):
    c = C.roll_year_timestamp(F.col("y"), "t", F.col("r").cast("date"), "Asia/Tokyo")
    assert one(spark, c, y=year, t=text, r=ref) == want


def test_lag_statistics(spark):
    rows = [(1.0, 3.0, None), (2.0, 2.0, 2.0), (None, None, None), (5.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(C.lag_avg(["a", "b", "c"]), C.lag_stddev(["a", "b", "c"]), C.lag_wavg(["a", "b", "c"], [0.5, 0.3, 0.2]), C.lag_min(["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [(2.0, pytest.approx(math.sqrt(2)), pytest.approx(1.4 / 0.8), 1.0), (2.0, 0.0, pytest.approx(2.0), 2.0), (None,) * 4, (5.0, None, 5.0, 5.0)]


def quotes_fixture(spark, rows):
    entries = spark.createDataFrame([("R1", 1, T + dt.timedelta(minutes=10)), ("R1", 2, T + dt.timedelta(minutes=10)), ("R2", 1, None)], "race string, no int, scheduled_start_at timestamp")
    quotes = spark.createDataFrame(rows, "race string, no int, published_at timestamp, available_at timestamp, win_odds double, place_low double, place_high double")
    out, bad = Q.select_quotes(entries, quotes, ["race", "no"], ["win_odds", "place_low", "place_high"], Q.QuotePolicy(10))
    out = out.withColumns({"win": Q.market_status(["win_odds"], 300), "place": Q.market_status(["place_low", "place_high"], 300)})
    return {(r.race, r.no): r for r in out.collect()}, [r.violation for r in bad.collect()]


@pytest.mark.parametrize(("seconds", "status"), [(0, "available"), (-1, "available"), (1, "missing"), (-300, "available"), (-301, "stale")])
def test_cutoff_and_age(spark, seconds, status):
    got, bad = quotes_fixture(spark, [("R1", 1, T + dt.timedelta(seconds=seconds), None, 4.0, 1.8, 2.0)])
    assert got["R1", 1].win == status and got["R1", 2].win == "missing" and got["R2", 1].win == "unknown_cutoff" and got["R2", 1].quote_id is None and not bad


def test_newest_quote_wins_even_unusable(spark):
    got, _ = quotes_fixture(spark, [("R1", 1, T - dt.timedelta(seconds=9), None, 4.0, 1.8, 2.0), ("R1", 1, T, None, None, 1.8, 2.0), ("R1", 2, T, T + dt.timedelta(seconds=1), 5.0, 2.0, 2.2)])
    assert (got["R1", 1].win, got["R1", 1].place, got["R1", 2].win) == ("unavailable", "available", "missing")


def test_quote_violations(spark):
    _, bad = quotes_fixture(spark, [("R1", 1, T, None, 4.0, 1.8, 2.0), ("R1", 1, T, None, 4.5, 1.8, 2.0), ("R1", 2, None, None, 4.0, None, None), ("R1", 2, T, T - dt.timedelta(seconds=1), 4.0, None, None)])
    assert sorted(bad) == ["available_before_published", "conflicting_revisions", "conflicting_revisions", "price_without_time"]
    got, bad = quotes_fixture(spark, [("R1", 1, T, None, 4.0, 1.8, 2.0)] * 2)
    assert not bad and got["R1", 1].win_odds == 4.0


def test_decision_formulas(spark):
    df = spark.createDataFrame([(0.6, 3.0)], "p double, o double")
    r = Q.kelly_ev(df, "p", "o", 2000, 1.0, 0.05).first()
    assert r.kelly_fraction == 0.05 and r.stake == 100.0 and Q.edge_frame(df, "p", "o", 0.8).first().edge == pytest.approx(0.6 - 0.8 / 3)


def test_logit_shift_sums(spark):
    rows = [("R2", 1, 0.2), ("R1", 1, 0.8), ("R2", 2, 0.4), ("R1", 2, 0.7), ("R2", 3, 0.1)]
    df = spark.createDataFrame(rows, "race string, no int, p double")
    out = Q.logit_shift(df, "race", "no", "p")
    sums = {r.race: r.s for r in out.groupBy("race").agg(F.sum("p_shifted").alias("s")).collect()}
    assert sums["R2"] == pytest.approx(2.0) and sums["R1"] == pytest.approx(2.0, abs=1e-6)
    order = [r.no for r in out.where("race = 'R2'").orderBy("p_shifted").collect()]
    assert order == [3, 1, 2]


def test_pair_marginals(spark):
    rng = random.Random(1)
    rows = [(c, i, 0.3 + 0.3 * rng.random()) for c in range(5) for i in range(rng.randrange(4, 9))]
    out = Q.pair_probabilities(spark.createDataFrame(rows, "c int, i int, p double"), "c", "i", "p").collect()
    for c in range(5):
        p = {i: x for k, i, x in rows if k == c}
        goal = {i: min(2 * x / sum(p.values()), 1) for i, x in p.items()}
        for i in p:
            assert sum(r.p_pair for r in out if r.c == c and i in (r.i, r.j)) == pytest.approx(goal[i], abs=1e-6)


def history(spark, n=300, seed=1):
    rng = random.Random(seed)
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(i, rng.randrange(12), day + dt.timedelta(days=rng.randrange(900)), rng.choice("AB"), float(rng.randrange(1, 60)), rng.randrange(2)) for i in range(n)], "id int, who int, day date, cond string, x double, y int")


@pytest.mark.parametrize(("half", "years"), [(90, 1), (90, 3), (0.7, 3), (0.5, 1)])
def test_decayed_history_against_all_pairs(spark, half, years):
    """Also with half-lives so short that a key's history is thousands of them long."""
    d = J.daily(history(spark), ["who"], "day", ["y", "x"])
    rows = d.collect()
    back = {r.day: r.day.replace(year=r.day.year - years) if (r.day.month, r.day.day) != (2, 29) else dt.date(r.day.year - years, 2, 28) for r in rows}
    want = lambda r, v, low: sum(p[v] * 0.5 ** ((r.day - p.day).days / half) for p in rows if p.who == r.who and low <= p.day < r.day)
    for out, low in ((J.decayed_history(d, ["who"], "day", ["y", "x"], half, years), back), (J.decayed_window(d, ["who"], "day", ["y", "x"], half), {})):
        got = {(r.who, r.day): r for r in out.collect()}
        assert len(got) == len(rows)
        for r in rows:
            for v in ("y", "x"):
                w, g = want(r, v, low.get(r.day, dt.date.min)), got[r.who, r.day][f"{v}_decayed"]
                assert (g or 0.0) == pytest.approx(w, rel=1e-9, abs=1e-100) and not math.isnan(g or 0.0)


def test_look_back_joins_against_all_pairs(spark):
    rows = history(spark, 200).collect()
    h = history(spark, 200)
    best = J.best_in_window(h.select("id", "who", "day"), h.select("who", F.col("day").alias("then"), "x", F.col("id").alias("other")), "who", "day", "then", 3, 40, [F.desc("x"), F.asc("other")], ["x", "other"], ["id"])
    got = {r.id: r.other for r in best.collect()}
    last = {r.id: r.last_id for r in J.last_before(h.select("id", "who", "day"), h, "who", "day", "day", "id", ["id"]).collect()}
    assert len(got) == len(last) == 200
    for r in rows:
        near = [p for p in rows if p.who == r.who and 3 <= (r.day - p.day).days <= 40]
        assert got[r.id] == (min(near, key=lambda p: (-p.x, p.id)).id if near else None)
        before = [p for p in rows if p.who == r.who and p.day < r.day]
        assert last[r.id] == (max(before, key=lambda p: (p.day, p.id)).id if before else None)
    runs = W.number_runs(h, "who", ["day", "id"]).withColumn("end", F.col("run_no") - 1)
    own = {(r.who, r.run_no): r.x for r in runs.collect()}
    for r in E.history_arrays(runs.select("id", "who", "end"), runs, ["id"], "who", "run_no", "end", ["x"], 4).collect():
        past = [own[r.who, k] for k in range(max(1, r.end - 3), r.end + 1)]
        assert r.x_history == past + [0.0] * (4 - len(past)) and r.history_mask == [True] * len(past) + [False] * (4 - len(past))


def test_batches_hold_every_entrant(spark):
    rows = [(c, e, float(10 * c + e)) for c, n in ((1, 25), (2, 3)) for e in range(n)]
    got = {r.c: r for r in E.contest_batches(spark.createDataFrame(rows, "c int, e int, x double"), "c", "e", ["x"]).collect()}
    assert got[1].x == [10.0 + e for e in range(25)] and got[1].mask == [True] * 25
    assert got[2].x == [20.0, 21.0, 22.0] + [0.0] * 22 and got[2].mask == [True] * 3 + [False] * 22


def test_sparse_filter_is_stable(spark):
    small = spark.createDataFrame([("a", "x", 1)] * 5 + [("a", "y", 1)] + [("b", "x", 1)] * 5 + [("b", "y", 1)] * 4, "g string, c string, x int")
    kept = J.sparse_filter(small, "g", "c", 6, 2, 2)
    assert sorted({(r.g, r.c) for r in kept.collect()}) == [("b", "x"), ("b", "y")]
    assert J.sparse_filter(kept, "g", "c", 6, 2, 2).count() == kept.count() == 9


def test_null_keys_have_history(spark):
    df = spark.createDataFrame([(None, dt.date(2020, 1, 1), 1), (None, dt.date(2020, 1, 31), 1)], "k string, day date, y int")
    got = J.decayed_history(J.daily(df, ["k"], "day", ["y"]), ["k"], "day", ["y"], 30).orderBy("day").collect()
    assert [r.y_decayed for r in got] == [None, 0.5]


def test_no_leakage(spark):
    """What happens on or after a date changes nothing that was known before it."""
    h, cut = history(spark), dt.date(2021, 3, 1)
    changed = h.withColumns({"y": F.when(F.col("day") >= cut, 1 - F.col("y")).otherwise(F.col("y")), "x": F.when(F.col("day") >= cut, F.col("x") * 7).otherwise(F.col("x"))})

    def features(df):
        r = W.rolling_rate(df, ["who"], "day", "y", 35, "month", 0.3, 20).where(F.col("period") <= F.trunc(F.lit(cut), "month"))
        d = J.decayed_history(J.daily(df, ["who"], "day", ["y"]), ["who"], "day", ["y"], 90).where(F.col("day") <= cut)
        e = W.expanding_stats(df, "who", ["day", "id"], "x").where(F.col("day") < cut).select("id", "x_past_mean")
        b = J.last_before(df.select("id", "who", "day"), df, "who", "day", "day", "id", ["x"]).where(F.col("day") <= cut)
        return [sorted(str([round(v, 9) if isinstance(v, float) else v for v in x]) for x in q.collect()) for q in (r, d, e, b)]

    assert features(h) == features(changed)


def test_run_numbers_and_pointer(spark):
    rows = [(1, 10, dt.date(2026, 5, 1)), (1, 20, dt.date(2026, 6, 12)), (1, 30, dt.date(2026, 6, 13)), (1, 40, dt.date(2026, 6, 20))]
    runs = W.number_runs(spark.createDataFrame(rows, "who int, race int, day date"), "who", ["day", "race"])
    entries = spark.createDataFrame([(1, 99, dt.date(2026, 6, 13)), (2, 99, dt.date(2026, 6, 13))], "who int, e int, held date")
    got = {r.who: (r.last_run_no, r.last_race) for r in J.last_before(entries, runs, "who", "held", "day", "run_no", ["run_no", "race"]).collect()}
    assert got == {1: (2, 20), 2: (None, None)}
    assert K.broken_sequence(runs, "who", "run_no", "day").count() == 0 and K.broken_sequence(runs.where("run_no <> 2"), "who", "run_no", "day").count() == 1
    pointed = entries.withColumn("end_no", F.when(F.col("who") == 1, 2).otherwise(0))
    assert K.broken_pointer(pointed, runs, "who", "held", "end_no", "run_no", "day").count() == 0
    h = E.history_arrays(pointed, runs, ["who", "e"], "who", "run_no", "end_no", ["race"], 3).orderBy("who").collect()
    assert h[0].race_history == [10.0, 20.0, 0.0] and h[0].history_mask == [True, True, False] and h[1].history_mask == [False] * 3


def test_metrics_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.choice([0.1, 0.2, 0.2, 0.7, 0.9])) for _ in range(80)]
    r = E.binary_metrics(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert r.auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert r.brier == pytest.approx(np.mean([(p - y) ** 2 for y, p in rows]))
    assert E.binary_metrics(spark.createDataFrame([(1, 0.3)], "y int, p double"), "y", "p").first().auc is None


def test_cell_effects_against_newton(spark):
    rng = random.Random(4)
    rows = [(i % 5, i % 2, 0.2, int(rng.random() < (0.5 if i % 10 == 3 else 0.2))) for i in range(2000)]
    out = X.cell_effects(spark.createDataFrame(rows, "e int, c int, p double, y int"), "e", "c", "p", "y", [0.4])
    for r in out.collect():
        ys = [y for e, c, _, y in rows if (e, c) == (r.e, r.c)]
        b, z = 0.0, math.log(0.25)
        for _ in range(30):
            q = 1 / (1 + math.exp(-(z + b)))
            b += (sum(ys) - len(ys) * q - b / 0.16) / (len(ys) * q * (1 - q) + 1 / 0.16)
        assert r.effect == pytest.approx(b, abs=1e-6)


def test_cells_split_over_rows_fit_alike(spark):
    """Cells with many offsets, a null key among them, fitted in parts and as one row each; and no cells at all."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(2), rng.gauss(0, 1), rng.randrange(1, 4)) for _ in range(900)]
    rows = [(e, c, z, n, float(rng.randrange(n + 1))) for e, c, z, n in rows] + [(9, 9, 0.5, 3, 1.0)]
    df = spark.createDataFrame(rows, "e int, c int, z double, n int, k double")
    both = [sorted(X.fit_cells(df, ["e", "c"], [0.2, 0.8], hot=hot).collect(), key=lambda r: (r.e is None, r.e, r.c, r.tau)) for hot in (10_000, 40)]
    assert len(both[0]) == len(both[1]) == 18
    for a, b in zip(*both, strict=True):
        assert (a.e, a.c, a.n, a.k, a.tau) == (b.e, b.c, b.n, b.k, b.tau)
        for c in ("expected", "effect", "se", "marginal"):
            assert abs(a[c] - b[c]) < 1e-9, (c, a, b)
    assert X.fit_cells(df.limit(0), ["e", "c"], [0.2]).count() == 0


def test_cell_effects_of_exact_offsets(spark, monkeypatch):
    from contestlab.plans import decisions as D

    rng = random.Random(4)
    rows = [(i % 5, i % 2, rng.choice([0.2, 0.31, 0.0001]), int(rng.random() < 0.3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "runner int, surface int, prob double, is_place int")
    monkeypatch.setattr(D, "bets", lambda *_: df)
    out = D.cell_effects(spark, "").collect()
    assert len(out) == 10
    for r in out:
        cell = [(math.log(p / (1 - p)), y) for e, c, p, y in rows if (e, c) == (r.runner, r.surface)]
        b, prec = 0.0, 1 / r.tau**2
        for _ in range(50):
            q = [1 / (1 + math.exp(-(z + b))) for z, _ in cell]
            b += (sum(y for _, y in cell) - sum(q) - b * prec) / (sum(x * (1 - x) for x in q) + prec)
        assert r.effect == pytest.approx(b, abs=2e-6)
        assert r.expected == pytest.approx(sum(p for e, c, p, _ in rows if (e, c) == (r.runner, r.surface)), abs=2e-6)


def test_boosted_queries_cover_all_years(spark, monkeypatch):
    from contestlab.plans import decisions as D

    rng = random.Random(8)
    rows = []
    for i in range(1400):
        quantity = float(rng.randrange(1, 50))
        rows.append((i // 2, dt.date(1995 + i // 200, 5, 1), "RAN"[i % 3] if i % 50 else "X", quantity, rng.randrange(10) / 100, 0.01, 2, int(quantity + rng.randrange(20) > 35)))
    df = spark.createDataFrame(rows, "contest_id int, held_date date, surface string, quantity double, discount double, tax double, field_size int, is_place int")
    monkeypatch.setattr(D, "entries", lambda *_: df)
    got = {r.year: (r.n, r.auc) for r in D.boosted_metrics(spark, "").collect()}
    assert got.keys() == set(range(1996, 2002)) and all(n == 200 and auc > 0.7 for n, auc in got.values())
    assert [r.feature for r in D.feature_importance(spark, "").collect()][0] == "quantity"
    split = {r.surface: r for r in D.condition_split(spark, "").collect()}
    assert split["X"].skip_reason == "too_few_rows" and split["X"].auc_local is None
    assert all(split[c].skip_reason is None and split[c].auc_base > 0.7 and split[c].auc_local > 0.7 for c in "RAN")


def test_bootstrap_is_seeded_and_covers(spark):
    df = spark.createDataFrame([(f"w{i % 30}", -0.2 + 0.1 * math.sin(i)) for i in range(600)], "w string, v double")
    a, b = (X.block_bootstrap(df.repartition(k), "v", "w", 300, 5).first() for k in (1, 4))
    assert a.low == pytest.approx(b.low) and a.low < a.mean < a.high < 0


def test_decisions(spark):
    m = spark.createDataFrame([("base", 0.60, 0.40, 0.20, None), ("new", 0.62, 0.38, 0.18, "concern"), ("best", 0.62, 0.38, 0.18, "fine"), ("half", 0.61, 0.41, 0.2, "fine"), ("bad", 0.5, 0.5, 0.3, "fine")], "scenario string, auc double, logloss double, brier double, review string")
    got = {r.scenario: (r.judgement, r.decision) for r in X.decide_scenarios(m, "base", "review").collect()}
    assert got == {"base": ("baseline", "baseline"), "new": ("improved", "hold"), "best": ("improved", "adopt"), "half": ("mixed", "hold"), "bad": ("not_improved", "reject")}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, dt.date(2024, 1, 1 + i)) for i in range(20)], "k int, g int, day date")
    assert S.export_parquet(df, str(tmp_path / "x"), {"g__in": [0, 1]}) == 14
    assert S.read_table(spark, str(tmp_path / "x"), ["k"], {"k__in": []}).count() == 0
    assert S.select_one(df, {"g": 1}, ["-k"]).k == 19 and S.select_one(df, {"g": 9}) is None
    assert S.cache_table(df, str(tmp_path / "c")).count() == S.cache_table(df.limit(0), str(tmp_path / "c")).count() == 20
    assert sorted(r.k for r in S.limit_groups(df, "g", ["k"], 1).collect()) == [0, 3, 6, 9, 12, 15, 18]
    assert S.load_after(df, df.where("k < 5"), "k").count() == 15 and S.load_after(df, df.limit(0), "k").count() == 20
    assert S.load_overlap(df, df.where("k < 10"), "day", 2).count() == 13
    assert S.upsert(df, df.where("k = 3").withColumn("new", F.lit(1)), ["k"]).count() == 20
    (tmp_path / "d.csv").write_text("code,name\n1,a\n2,b\n")
    assert S.read_dim(spark, str(tmp_path / "d.csv"), "code int, name string").count() == 2
    with pytest.raises(ValueError):
        S.where_expr({"k__between": 1})


def test_streams_equal_batches(spark, tmp_path):
    from contestlab.streaming import quotes as Z

    rng = random.Random(6)
    rows = [(rng.randrange(5), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at timestamp, id int, v double")
    df.repartitionByRange(4, "at").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    Z.latest_quotes_stream(feed, ["k"], "at", "id", ["v"], str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out")).select("k", "at", "id", "v")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, Z.latest_quotes(df, ["k"], "at", "id", ["v"]).collect()))


def test_prestart_stream_equals_its_twin(spark, tmp_path):
    """Quotes over several days, ties, a contest without quotes in time, and one whose cutoff the watermark never passes."""
    from contestlab.streaming import quotes as Z

    rng = random.Random(6)
    rows = [(rng.randrange(6), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * (i // 2), microseconds=i // 2), i, float(i) if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, at timestamp, id int, v double")
    df.repartitionByRange(5, "at").write.parquet(str(tmp_path / "in"))
    for i, f in enumerate(sorted((tmp_path / "in").glob("part-*"))):  # the source takes files by age
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    contests = spark.createDataFrame([(0, day(1, 2)), (1, day(3, 5)), (1, day(2, 5)), (2, day(4)), (3, dt.datetime(2023, 12, 31)), (4, day(9)), (5, day(4, 1))], "k int, cutoff timestamp")
    got = []
    s = Z.prestart_stream(feed, contests, ["k"], "at", "cutoff", "id", ["v"], "1 hour")
    Z.run_to_table(s, lambda b, n: got.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    want = Z.prestart_quotes(df, contests, ["k"], "at", "cutoff", "id", ["v"]).where(F.col("cutoff") < F.lit(max(r[1] for r in rows) - dt.timedelta(hours=1)))
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) == 5 and s.columns == want.columns


def test_registered_queries_have_twins():
    from contestlab.plans import queries as P

    assert len(P.oracle_sql()) >= 85 and set(P.oracle_sql()) <= set(P.queries())
