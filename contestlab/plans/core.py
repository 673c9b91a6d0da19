"""Queries of windows, joins, aggregates, sources and column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contestlab.functions import columns as C
from contestlab.operators import aggregates as A
from contestlab.operators import joins as J
from contestlab.operators import windows as W
from contestlab.plans.base import entries, parts, query, r6, spread, table
from contestlab.operators.incremental import KeptRates
from contestlab.sources import tables as S

RATE = """with /*ENTRY*/, p as (select {keys}, date_trunc('{unit}', held_date)::date period, count(*) n, sum({label}) k from entry group by all),
w as (select {keys}, period, coalesce(sum(n) over w, 0)::bigint past_n, coalesce(sum(k) over w, 0)::bigint past_k from p window w as (partition by {keys} order by period rows between {m} preceding and 1 preceding))
select {keys}, period, past_n, past_k, round((past_k + {prior}::double * {strength}) / (past_n + {strength}::double), 6) rate from w"""


@query(RATE.format(keys="rider", unit="month", label="is_place", m=35, prior=0.3, strength=20))
def rolling_rate_35m(spark, sf):
    """A rider's smoothed place rate over the 35 months before."""
    return r6(W.rolling_rate(entries(spark, sf), ["rider"], "held_date", "is_place", 35, "month", 0.3, 20))


@query(RATE.format(keys="trainer", unit="year", label="is_win", m=5, prior=0.25, strength=10))
def rolling_rate_5y(spark, sf):
    return r6(W.rolling_rate(entries(spark, sf), ["trainer"], "held_date", "is_win", 5, "year", 0.25, 10))


@query(RATE.format(keys="rider, surface, turn", unit="month", label="is_place", m=35, prior=0.3, strength=20))
def rolling_rate_by_condition(spark, sf):
    """The same by entity and condition."""
    # one shuffle by key serves the sums by month and the windows over them
    e = spread(entries(spark, sf).select("rider", "surface", "turn", "held_date", "is_place"), parts(spark, sf), "rider", "surface", "turn")
    return r6(W.rolling_rate(e, ["rider", "surface", "turn"], "held_date", "is_place", 35, "month", 0.3, 20))


@query("""with /*ENTRY*/, p as (select surface, klass, date_trunc('year', held_date)::date period, count(*) n, sum(price) s, sum(price * price) q from entry group by all),
w as (select surface, klass, period, sum(n) over w n, sum(s) over w s, sum(q) over w q from p window w as (partition by surface, klass order by period rows between 5 preceding and 1 preceding))
select surface, klass, period, n::bigint past_n, round(s / n, 4) mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 3) sd from w""")
def rolling_moments_baseline(spark, sf):
    """W11, D20."""
    m = W.rolling_moments(entries(spark, sf), ["surface", "klass"], "held_date", "price", 5, "year")
    return m.select("surface", "klass", "period", "past_n", F.round("mean", 4).alias("mean"), F.round("sd", 3).alias("sd"))


@query("""with /*ENTRY*/, p as (select distinct rider, date_trunc('month', held_date)::date period from entry), f as (select *, min(period) over (partition by rider) first from p)
select rider, period, ((year(period) - year(first)) * 12 + month(period) - month(first))::int career_months, (year(period) - year(first)) * 12 + month(period) - month(first) < 12 early_phase from f""")
def career_age_flag(spark, sf):
    p = entries(spark, sf).select("rider", F.trunc("held_date", "month").alias("period")).distinct()
    return W.career_age(p, "rider", "period")


@query("""with /*ENTRY*/, p as (select rider, surface, date_trunc('year', held_date)::date period, count(*) n, sum(is_place) k from entry group by all), q as (select surface, period, sum(n) n, sum(k) k from p group by all),
a as (select rider, surface, period, coalesce(sum(n) over w, 0)::bigint past_n, coalesce(sum(k) over w, 0)::bigint past_k from p window w as (partition by rider, surface order by period rows between 3 preceding and 1 preceding)),
b as (select surface, period, (coalesce(sum(k) over w, 0) + 6.0) / (coalesce(sum(n) over w, 0) + 20.0) whole from q window w as (partition by surface order by period rows between 3 preceding and 1 preceding))
select surface, period, rider, past_n, past_k, round((past_k + 6.0::double) / (past_n + 20.0), 6) rate, round(whole::double, 6) whole, round((past_k + 6.0::double) / (past_n + 20.0) / whole::double, 6) relative from a join b using (surface, period)""")
def relative_rate_bins(spark, sf):
    """AG8."""
    return r6(W.relative_rate(entries(spark, sf), "rider", "surface", "held_date", "is_place", 3, 0.3, 20))


@query("""with /*ENTRY*/, p as (select klass, entry_no, date_trunc('year', held_date)::date period, count(*) n, sum(is_place) k from entry group by all), q as (select klass, period, sum(k)::double / sum(n) whole from p group by all),
r as (select klass, entry_no, period, k::double / n / nullif(whole, 0) ratio from p join q using (klass, period))
select klass, entry_no, period, round(avg(ratio) over w, 6) ratio_mean, round(stddev_samp(ratio) over w, 6) ratio_sd from r window w as (partition by klass, entry_no order by period rows between 5 preceding and 1 preceding)""")
def gate_gap_rolling(spark, sf):
    """W12, W13."""
    return r6(W.rolling_relative(entries(spark, sf), ["klass", "entry_no"], ["klass"], "held_date", "is_place", 5))


DECAY = """with /*ENTRY*/, d as (select {keys}, held_date, count(*) n, sum(is_place) is_place, sum(price) price from entry group by all)
select {a}, a.held_date, round(sum(b.is_place * pow(0.5, date_diff('day', b.held_date, a.held_date) / {half}::double)), 6) is_place_decayed, round(sum(b.price * pow(0.5, date_diff('day', b.held_date, a.held_date) / {half}::double)), 3) price_decayed
from d a left join d b on {on} and b.held_date < a.held_date {years} group by all"""


@query(DECAY.format(keys="runner", a="a.runner", half=180, on="a.runner = b.runner", years="and b.held_date >= a.held_date - interval 3 year"))
def decayed_history_3y(spark, sf):
    """JN7, D15: summed by day before the self-join."""
    d = J.daily(entries(spark, sf), ["runner"], "held_date", ["is_place", "price"])
    return J.decayed_history(d, ["runner"], "held_date", ["is_place", "price"], 180).withColumns({"is_place_decayed": F.round("is_place_decayed", 6), "price_decayed": F.round("price_decayed", 3)})


@query(DECAY.format(keys="rider", a="a.rider", half=180, on="a.rider = b.rider", years=""))
def decayed_history_unbounded(spark, sf):
    """JN7 without bound, as one window pass instead of a self-join."""
    d = J.daily(entries(spark, sf), ["rider"], "held_date", ["is_place", "price"])
    out = J.decayed_window(d, ["rider"], "held_date", ["is_place", "price"], 180)
    return out.select("rider", "held_date", F.round("is_place_decayed", 6).alias("is_place_decayed"), F.round("price_decayed", 3).alias("price_decayed"))


@query(DECAY.format(keys="rider, surface", a="a.rider, a.surface", half=365, on="a.rider = b.rider and a.surface = b.surface", years="and b.held_date >= a.held_date - interval 3 year"))
def pair_history(spark, sf):
    """History of a pair of keys."""
    d = J.daily(entries(spark, sf), ["rider", "surface"], "held_date", ["is_place", "price"])
    return J.decayed_history(d, ["rider", "surface"], "held_date", ["is_place", "price"], 365).withColumns({"is_place_decayed": F.round("is_place_decayed", 6), "price_decayed": F.round("price_decayed", 3)})


@query("""with /*ENTRY*/, s as (select rider, date_trunc('month', held_date)::date period, quantity * 40 dist, count(*) n, sum(is_place) is_place from entry group by all)
select a.rider, a.period, a.dist, sum(b.n)::bigint past_n, sum(b.is_place)::bigint past_is_place from s a left join s b on a.rider = b.rider and b.period < a.period and b.period >= a.period - interval 3 year and abs(a.dist - b.dist) <= 200 group by all""")
def band_history_pm200(spark, sf):
    """JN8: true calendar bounds, distance within 200."""
    e = entries(spark, sf).select("rider", F.trunc("held_date", "month").alias("period"), (F.col("quantity") * 40).alias("dist"), "is_place")
    return J.band_history(e, ["rider"], "period", "dist", 200, 3, ["is_place"])


@query("""with /*ENTRY*/, v as (select contest_id, entry_no, runner, held_date from entry), e as (select l_partkey runner, cast(l_shipdate as date) event_day, l_extendedprice score, l_suppkey from lineitem),
j as (select v.*, e.event_day, e.score, row_number() over (partition by contest_id, entry_no order by score desc, event_day desc, l_suppkey) r from v join e on v.runner = e.runner and date_diff('day', event_day, held_date) between 3 and 60)
select v.contest_id, v.entry_no, v.runner, v.held_date, j.event_day, j.score from v left join j on v.contest_id = j.contest_id and v.entry_no = j.entry_no and r = 1""")
def interval_best_pick(spark, sf):
    """JN9: the best side event 3 to 60 days before; entries without one stay."""
    v = entries(spark, sf).select("contest_id", "entry_no", "runner", "held_date")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("runner"), F.col("l_shipdate").cast("date").alias("event_day"), F.col("l_extendedprice").alias("score"), "l_suppkey")
    return J.best_in_window(v, e, "runner", "held_date", "event_day", 3, 60, [F.desc("score"), F.desc("event_day"), F.asc("l_suppkey")], ["score", "l_suppkey"], ["contest_id", "entry_no"]).select("contest_id", "entry_no", v["runner"], v["held_date"], "event_day", "score")


@query("""with /*ENTRY*/, b as (select a.contest_id, a.entry_no, arg_max(b.contest_id, (b.held_date, b.contest_id * 100 + b.entry_no)) last_contest_id, arg_max(b.price, (b.held_date, b.contest_id * 100 + b.entry_no)) last_price from entry a join entry b on a.runner = b.runner and b.held_date < a.held_date group by all)
select contest_id, entry_no, runner, held_date, last_contest_id, last_price from entry left join b using (contest_id, entry_no)""")
def asof_last_before(spark, sf):
    """JN11."""
    e = entries(spark, sf).withColumn("tie", F.col("contest_id") * 100 + F.col("entry_no"))
    a = e.select("contest_id", "entry_no", "runner", "held_date")
    return J.last_before(a, e, "runner", "held_date", "held_date", "tie", ["contest_id", "price"])


LAGS = ", ".join(f"lag(price, {i}) over w price_lag{i}" for i in range(1, 6))


@query(f"with /*ENTRY*/ select contest_id, entry_no, runner, {LAGS} from entry window w as (partition by runner order by held_date, contest_id, entry_no)")
def lag_vector_5(spark, sf):
    """W6."""
    e = entries(spark, sf).select("contest_id", "entry_no", "runner", "held_date", "price")
    return W.lag_vector(e, "runner", ["held_date", "contest_id", "entry_no"], ["price"], 5).drop("price", "held_date")


L5 = [f"price_lag{i}" for i in range(1, 6)]
L_SUM, L_N = " + ".join(f"coalesce({c}, 0)" for c in L5), " + ".join(f"({c} is not null)::int" for c in L5)
WEIGHTS = (0.40, 0.25, 0.16, 0.11, 0.08)
L_WSUM, L_W = " + ".join(f"coalesce({c} * {w}::double, 0)" for c, w in zip(L5, WEIGHTS, strict=True)), " + ".join(f"case when {c} is not null then {w}::double else 0 end" for c, w in zip(L5, WEIGHTS, strict=True))
L_SQ = " + ".join(f"coalesce({c} * {c}, 0)" for c in L5)


@query(f"""with /*ENTRY*/, l as (select contest_id, entry_no, price, surface, {LAGS}, lag(surface, 1) over w s1, lag(surface, 2) over w s2 from entry window w as (partition by runner order by held_date, contest_id, entry_no)),
n as (select *, {L_N} n, {L_SUM} s, {L_SQ} q from l)
select contest_id, entry_no, round(s / nullif(n, 0), 4) avg5, round(({L_WSUM}) / nullif({L_W}, 0), 4) wavg5, case when n > 1 then round(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 2) end sd5, round(price_lag1 - price_lag5, 4) trend5, round((price_lag1 - price_lag3) / 2, 4) slope3,
least({', '.join(L5)}) min5, coalesce((abs(price - price_lag1) >= 400)::int, 0) + coalesce((abs(price - price_lag2) >= 400)::int, 0) price_changes, coalesce((surface <> s1)::int, 0) + coalesce((surface <> s2)::int, 0) surface_changes, case when price_lag1 is not null and price_lag2 is not null then (price_lag2 < price_lag1 and (price_lag3 is null or price_lag3 < price_lag2))::int end falling,
round((coalesce(price_lag1, 0) + coalesce(price_lag2, 0)) / nullif((price_lag1 is not null)::int + (price_lag2 is not null)::int, 0) - s / nullif(n, 0), 4) short_long from n""")
def lag_aggregates(spark, sf):
    """P13 to P19, D13."""
    e = entries(spark, sf).select("contest_id", "entry_no", "runner", "held_date", "price", "surface")
    v = W.lag_vector(e, "runner", ["held_date", "contest_id", "entry_no"], ["price", "surface"], 5)
    r = lambda c, n: F.round(c, n)
    return v.select("contest_id", "entry_no", r(C.lag_avg(L5), 4).alias("avg5"), r(C.lag_wavg(L5, WEIGHTS), 4).alias("wavg5"), r(C.lag_stddev(L5), 2).alias("sd5"), r(C.lag_trend(L5), 4).alias("trend5"), r(C.lag_slope3(L5), 4).alias("slope3"), C.lag_min(L5).alias("min5"), C.change_score("price", L5[:2], 400).alias("price_changes"), C.change_score("surface", ["surface_lag1", "surface_lag2"]).alias("surface_changes"), C.monotone_flag(L5[:3]).alias("falling"), r(C.short_long_gap(L5[:2], L5), 4).alias("short_long"))


@query("""with /*ENTRY*/ select contest_id, entry_no, (surface <> lag(surface) over w) surface_changed, (klass < lag(klass) over w) class_up, (rider <> lag(rider) over w) rider_changed, date_diff('day', lag(held_date) over w, held_date)::int days_between,
round(stddev_samp(price) over (w rows between 3 preceding and 1 preceding), 4) price_sd3 from entry window w as (partition by runner order by held_date, contest_id, entry_no)""")
def change_flags(spark, sf):
    """W7, W8."""
    order = ["held_date", "contest_id", "entry_no"]
    v = W.lag_vector(entries(spark, sf), "runner", order, ["surface", "klass", "rider", "held_date"], 1)
    v = W.rolling_sd(v, "runner", order, "price", 3)
    return v.select("contest_id", "entry_no", (F.col("surface") != F.col("surface_lag1")).alias("surface_changed"), (F.col("klass") < F.col("klass_lag1")).alias("class_up"), (F.col("rider") != F.col("rider_lag1")).alias("rider_changed"), F.datediff("held_date", "held_date_lag1").alias("days_between"), F.round("price_sd3", 4).alias("price_sd3"))


@query("""with /*ENTRY*/ select contest_id, entry_no, round(avg(price) over w, 7) price_past_mean, min(price) over w price_past_min from entry window w as (partition by runner order by held_date, contest_id, entry_no rows between unbounded preceding and 1 preceding)""")
def expanding_stats(spark, sf):
    """W9, D9."""
    e = W.expanding_stats(entries(spark, sf), "runner", ["held_date", "contest_id", "entry_no"], "price")
    return e.select("contest_id", "entry_no", F.round("price_past_mean", 7).alias("price_past_mean"), "price_past_min")


@query("""with /*ENTRY*/ select contest_id, entry_no, round((price - avg(price) over w) / nullif(stddev_samp(price) over w, 0), 5) price_peer_z from entry window w as (partition by klass, held_date)""")
def peer_z_day(spark, sf):
    """W16, D21."""
    return W.peer_z(entries(spark, sf), ["klass", "held_date"], "price").select("contest_id", "entry_no", F.round("price_peer_z", 5).alias("price_peer_z"))


@query("""with /*ENTRY*/, z as (select contest_id, entry_no, price, quantity, (price - avg(price) over w) / nullif(stddev_pop(price) over w, 0) zp, (quantity - avg(quantity) over w) / nullif(stddev_pop(quantity) over w, 0) zq, price - min(price) over w price_to_best from entry window w as (partition by contest_id))
select contest_id, entry_no, round(zp, 5) price_z, round(zq, 5) quantity_z, round(price_to_best, 4) price_to_best, round(0.6::double * zp + zq, 5) form_score, round((zp * 10 + 50) * (zq * 10 + 50), 3) form_product, coalesce((case when zp < -0.4307273 then 1 when zp <= 0.4307273 then 2 else 3 end - 1) * 3 + case when zq < -0.4307273 then 1 when zq <= 0.4307273 then 2 else 3 end, 0)::int joint_bin from z where zp is not null and zq is not null""")
def group_z(spark, sf):
    """W15, W19, P12, D14, D11."""
    e = W.diff_to_best(W.synergy_scores(entries(spark, sf), ["contest_id"], "price", "quantity"), ["contest_id"], "price").where("price_z is not null and quantity_z is not null")
    return e.select("contest_id", "entry_no", F.round("price_z", 5).alias("price_z"), F.round("quantity_z", 5).alias("quantity_z"), F.round("price_to_best", 4).alias("price_to_best"), F.round("form_score", 5).alias("form_score"), F.round("form_product", 3).alias("form_product"), C.joint_bin3("price_z", "quantity_z").alias("joint_bin"))


@query("""with /*ENTRY*/, q as (select contest_id, quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c from entry group by 1) select contest_id, entry_no, round((price - b) / nullif(c - a, 0), 6) price_rz from entry join q using (contest_id)""")
def group_robust_z(spark, sf):
    """AG4, W15."""
    return r6(W.group_robust_z(entries(spark, sf), ["contest_id"], "price").select("contest_id", "entry_no", "price_rz"))


@query("""with /*ENTRY*/, x as (select contest_id, entry_no, case when entry_no % 4 = 0 then null else discount end d from entry) select contest_id, entry_no, rank() over (partition by contest_id order by d nulls last)::int d_rank, round((rank() over (partition by contest_id order by d nulls last) - 1)::double / nullif(count(*) over (partition by contest_id) - 1, 0), 6) d_rank_pct from x""")
def rank_percentile(spark, sf):
    """W3, W18."""
    e = entries(spark, sf).withColumn("d", F.when(F.col("entry_no") % 4 != 0, F.col("discount")))
    return r6(W.rank_in_group(e, ["contest_id"], "d", "d_rank").select("contest_id", "entry_no", "d_rank", "d_rank_pct"))


@query("""select p_partkey, p_brand, ntile(3) over (partition by p_brand order by p_retailprice nulls last, p_partkey)::int price_third from part""")
def ntile_condition(spark, sf):
    """W5."""
    return W.ntile_in_group(table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice"), ["p_brand"], [F.asc_nulls_last("p_retailprice"), F.asc("p_partkey")], 3, "price_third").drop("p_retailprice")


@query("""with /*ENTRY*/, l as (select runner, held_date, 'surface' condition_group, surface key1, null::varchar key2, is_place from entry union all select runner, held_date, 'turn', turn, null, is_place from entry union all select runner, held_date, 'surface_klass', surface, klass, is_place from entry)
select runner, condition_group, key1, key2, count(*) n, sum(is_place)::bigint k from l group by all""")
def condition_long_explode(spark, sf):
    """U1, AG1: three groups in one scan."""
    # dealt out by runner before a row becomes three, which then meet where they are
    e = spread(entries(spark, sf).select("runner", "held_date", "surface", "turn", "klass", "is_place"), parts(spark, sf), "runner")
    x = A.condition_long(e, ["runner", "held_date"], {"surface": ("surface",), "turn": ("turn",), "surface_klass": ("surface", "klass")}, ["is_place"])
    return x.groupBy("runner", "condition_group", "key1", "key2").agg(F.count("*").alias("n"), F.sum("is_place").alias("k"))


@query("""with /*ENTRY*/ select runner, max(case when surface = 'A' then price end) price_a, max(case when surface = 'N' then price end) price_n, max(case when surface = 'R' then price end) price_r from entry group by 1""")
def pivot_conditions(spark, sf):
    """AG6."""
    return A.pivot_max(entries(spark, sf), ["runner"], "surface", ["A", "N", "R"], "price")


@query("""with /*ENTRY*/, g as (select distinct runner from entry), c as (select unnest(['A', 'N', 'R']) surface), h as (select runner, surface, count(*) n from entry group by all) select g.runner, c.surface, coalesce(n, 0) n from g, c left join h on h.runner = g.runner and h.surface = c.surface""")
def complete_grid(spark, sf):
    """JN4, AG7."""
    e = entries(spark, sf).select("runner", "surface")
    return J.complete_grid(e, ["runner"], "surface", ["A", "N", "R"]).join(e.groupBy("runner", "surface").agg(F.count("*").alias("n")), ["runner", "surface"], "left").fillna(0, ["n"])


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')""")
def semi_join_restrict(spark, sf):
    """FL2, FL3."""
    live = table(spark, sf, "orders").where(S.where_expr({"o_orderpriority": "1-URGENT"})).select(F.col("o_orderkey").alias("l_orderkey"))
    return J.restrict_to(table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), live, ["l_orderkey"])


@query("""with a as (select user_id, count(*) clicks from events where event_type = 'click' group by 1), b as (select user_id, sum(value) spent from events where event_type = 'purchase' group by 1) select coalesce(a.user_id, b.user_id) user_id, clicks, round(spent, 4) spent from a full join b on a.user_id = b.user_id""")
def full_merge(spark, sf):
    """JN3."""
    e = table(spark, sf, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"))
    b = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("spent"))
    return J.full_merge(a, b, ["user_id"])


@query("""with /*ENTRY*/, s as (select contest_id, max(case when entry_no = 1 then runner end) r1, max(case when entry_no = 1 then price end) p1, max(case when entry_no = 2 then runner end) r2, max(case when entry_no = 2 then price end) p2, max(case when entry_no = 3 then runner end) r3, max(case when entry_no = 3 then price end) p3 from entry group by 1)
select contest_id, slot, runner, payout from (select contest_id, 1 slot, r1 runner, p1 payout from s union all select contest_id, 2, r2, p2 from s union all select contest_id, 3, r3, p3 from s) where runner is not null""")
def unpivot_slots(spark, sf):
    """JN12."""
    e = entries(spark, sf)
    s = e.groupBy("contest_id").agg(*[f for i in (1, 2, 3) for f in (F.max(F.when(F.col("entry_no") == i, F.col("runner"))).alias(f"r{i}"), F.max(F.when(F.col("entry_no") == i, F.col("price"))).alias(f"p{i}"))])
    return J.unpivot_slots(s, ["contest_id"], [("r1", "p1"), ("r2", "p2"), ("r3", "p3")], ["runner", "payout"])


@query("""with s as (select o_orderkey, o_custkey % 7 k1, (o_custkey + 2) % 7 k2, o_orderkey % 7 wanted, o_totalprice from orders) select o_orderkey, case when wanted = k1 then o_totalprice when wanted = k2 then o_totalprice * 2 end payout from s""")
def slot_value(spark, sf):
    """JN13."""
    s = table(spark, sf, "orders").withColumns({"k1": F.col("o_custkey") % 7, "k2": (F.col("o_custkey") + 2) % 7, "v1": F.col("o_totalprice"), "v2": F.col("o_totalprice") * 2})
    return s.select("o_orderkey", J.slot_value(F.col("o_orderkey") % 7, ["k1", "k2"], ["v1", "v2"]).alias("payout"))


@query("""with /*ENTRY*/ select a.contest_id, a.entry_no i, b.entry_no j, a.price price_i, b.price price_j from entry a join entry b on a.contest_id = b.contest_id and a.entry_no < b.entry_no""")
def contest_pairs(spark, sf):
    """JN14."""
    return J.pairs(entries(spark, sf), "contest_id", "entry_no", ["price"])


@query("""with /*ENTRY*/, c as (select contest_id, min(held_date) d from entry group by 1 order by 2 desc, 1 limit 200) select contest_id, entry_no, held_date from entry where contest_id in (select contest_id from c)""")
def limit_contests(spark, sf):
    """The newest 200 contests, each whole."""
    return S.limit_groups(entries(spark, sf).select("contest_id", "entry_no", "held_date"), "contest_id", ["-held_date"], 200)


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) over (partition by l_orderkey, l_linenumber) multiplicity from lineitem""")
def key_multiplicity(spark, sf):
    """S10."""
    return S.with_multiplicity(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"])


@query("""select o_orderkey, o_totalprice, o_orderpriority from orders where o_totalprice >= 1000 and o_orderstatus in ('F', 'O') and o_orderpriority like '%-%' and o_custkey <> 7 and o_orderkey < 50000 and o_orderdate is not null order by o_totalprice desc, o_orderkey limit 500""")
def filtered_read(spark, sf):
    """S1, S4, S5, FL1, T1."""
    where = {"o_totalprice__gte": 1000, "o_orderstatus__in": ["F", "O"], "o_orderpriority__like": "%-%", "o_custkey__neq": 7, "o_orderkey__lt": 50000, "o_orderdate__isnull": False}
    return S.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderpriority"], where, ["-o_totalprice", "o_orderkey"], 500)


@query("""select o_orderkey contest, o_custkey owner, null::int missing from orders""")
def bound_columns(spark, sf):
    """S11."""
    return S.bind_columns(table(spark, sf, "orders"), {"contest": "o_orderkey", "owner": "o_custkey", "missing": None}).withColumn("missing", F.col("missing").cast("int"))


@query("""select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end o_totalprice from orders""")
def upsert_orders(spark, sf):
    """S12, S16."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return S.upsert(o, o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("""with m as (select max(o_orderdate)::date d from orders) select o_orderkey, o_orderdate::date o_orderdate from orders, m where o_orderdate::date between (d - interval 7 day)::date and d""")
def scoped_dates(spark, sf):
    """The last days up to the newest date."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return S.scope_dates(o, "o_orderdate", S.recalc_bounds(o, "o_orderdate", 0, 0, "days")[0])


@query("""with e as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) select user_id, event_type, event_id, ts, value from e where r = 1""")
def latest_per_key(spark, sf):
    """W1, D7."""
    return W.pick_first(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


@query("""with a as (select user_id, value, 0 source_priority, event_id from events where event_type = 'purchase' union all select user_id, value, 1, event_id from events where event_type = 'view'), r as (select *, row_number() over (partition by user_id order by source_priority, event_id) r from a) select user_id, value, source_priority, event_id from r where r = 1""")
def prefer_source_union(spark, sf):
    """W2, U2."""
    e = table(spark, sf, "events", "user_id", "value", "event_type", "event_id")
    return W.prefer_source([e.where(f"event_type = '{t}'").drop("event_type") for t in ("purchase", "view")], ["user_id"], [F.asc("event_id")]).select("user_id", "value", "source_priority", "event_id")


@query("""with /*ENTRY*/, r as (select contest_id, entry_no, price, row_number() over (partition by contest_id order by price desc, entry_no) rank_in_group from entry) select contest_id, entry_no, price, rank_in_group::int rank_in_group from r where rank_in_group <= 2""")
def top_n_per_contest(spark, sf):
    """T2."""
    return W.top_n(entries(spark, sf).select("contest_id", "entry_no", "price"), ["contest_id"], [F.desc("price"), F.asc("entry_no")], 2)


@query("""with /*ENTRY*/, m as (select rider, count(*) n, count(discount) discount_n, round(sum(discount), 6) discount_sum, round(sum(discount * discount), 6) discount_sq from entry group by 1) select * from m""")
def moments(spark, sf):
    """AG2."""
    return r6(A.moments(entries(spark, sf), ["rider"], ["discount"]))


SPREAD = "count(*) n, count({m}) n_present, round(count({m})::double / count(*), 6) present_rate, round(avg({m}), 6) mean, round(stddev_samp({m}), 6) sd, round(quantile_cont({m}, 0.5), 6) median, round(quantile_cont({m}, 0.1), 6) p10, round(quantile_cont({m}, 0.25), 6) p25, round(quantile_cont({m}, 0.75), 6) p75, round(quantile_cont({m}, 0.9), 6) p90"


@query(f"with /*ENTRY*/, x as (select klass, is_place, case when entry_no % 5 = 0 then null else price end price from entry) select klass, {SPREAD.format(m='price')}, round(avg(is_place), 6) label_rate from x group by 1")
def distribution_summary(spark, sf):
    """AG3, AG5, AG13."""
    e = entries(spark, sf).withColumn("price", F.when(F.col("entry_no") % 5 != 0, F.col("price")))
    s = A.distribution_summary(e, ["klass"], "price", "is_place")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "median", "p10", "p25", "p75", "p90")} | {c: F.round(c, 6) for c in ("present_rate", "label_rate")})


@query("""with /*ENTRY*/, x as (select is_place, case when entry_no % 4 = 0 then null else discount end discount, case when entry_no % 3 = 0 then null else tax end tax from entry), l as (select is_place, 'discount' column_name, discount v from x union all select is_place, 'tax', tax from x)
select column_name, round(avg((v is not null)::int), 6) present_rate, round(avg(v), 6) mean, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.1), 6) p10, round(quantile_cont(v, 0.9), 6) p90, round(avg(case when v is not null then is_place end), 6) label_rate_present from l group by 1""")
def availability_summary(spark, sf):
    """AG14, P27."""
    e = entries(spark, sf).select("is_place", F.when(F.col("entry_no") % 4 != 0, F.col("discount")).alias("discount"), F.when(F.col("entry_no") % 3 != 0, F.col("tax")).alias("tax"))
    return r6(A.availability_summary(e, ["discount", "tax"], "is_place"))


@query("""with /*ENTRY*/ select rider, round(avg(price), 6) mean, round(quantile_cont(price, 0.025), 6) low, round(quantile_cont(price, 0.975), 6) high, round(avg((abs(price) > 20000)::int), 6) p_beyond, avg((abs(price) > 20000)::int) >= 0.95 flagged from entry group by 1""")
def draws_ranking(spark, sf):
    """AG15."""
    d = A.draws_ranking(entries(spark, sf), "rider", "price", 20000)
    return d.select("rider", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_beyond", 6).alias("p_beyond"), "flagged")


@query("""with /*ENTRY*/ select rider, round(count(*) filter (surface = 'A')::double / nullif(count(*) filter (surface in ('A', 'N', 'R')), 0), 6) share_a, round(count(*) filter (surface = 'N')::double / nullif(count(*) filter (surface in ('A', 'N', 'R')), 0), 6) share_n, round(count(*) filter (surface = 'R')::double / nullif(count(*) filter (surface in ('A', 'N', 'R')), 0), 6) share_r from entry group by 1""")
def profile_share(spark, sf):
    """AG11."""
    return r6(A.profile_share(entries(spark, sf), "rider", "surface", ["A", "N", "R"]))


@query("""with /*ENTRY*/, c as (select rider, finish, count(*) n from entry group by all), m as (select rider, arg_max(finish, (n, -finish)) mode_label from c group by 1), s as (select rider, count(*) n, round(avg(price), 4) mean, round(median(price), 4) median, 0.0::double missing_rate from entry group by 1) select m.rider, mode_label, n, mean, median, missing_rate from m join s using (rider)""")
def entity_summary(spark, sf):
    """AG10, AG12."""
    e = entries(spark, sf)
    s = A.entity_summary(e, "rider", "price").withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})
    return A.mode_label(e, "rider", "finish").join(s, "rider")


@query("""select year(o_orderdate)::int as year, o_orderpriority reason, count(*) n from orders group by all""")
def coverage_by_reason(spark, sf):
    """AG9, P26."""
    return A.coverage(table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("reason")), ["year", "reason"])


@query("""with f as (select l_suppkey g, l_partkey % 40 c, l_orderkey from lineitem), c0 as (select g, c, count(*) n from f group by all), """ + ", ".join(f"c{i + 1} as (select g, c, n from (select *, sum(n) over (partition by g) t, count(*) over (partition by g) k from c{i} where n >= 12) where t >= 400 and k >= 25)" for i in range(6)) + """ select g, count(*) n from f join c6 using (g, c) group by 1""")
def sparse_filter(spark, sf):
    """FL6."""
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 40).alias("c"))
    return J.sparse_filter(f, "g", "c", 400, 12, 25).groupBy("g").agg(F.count("*").alias("n"))


@query(RATE.format(keys="rider", unit="month", label="is_place", m=35, prior=0.3, strength=20))
def incremental_rates(spark, sf):
    """Rates kept as a table: built while some rows are missing or wrong, then refreshed with the late and the
    corrected ones. The SQL computes all from scratch."""
    e = S.settled(entries(spark, sf).select("contest_id", "rider", "held_date", "is_place"))
    late = (F.col("contest_id") % 97 == 5) & F.month("held_date").isin(3, 4)
    wrong = (F.col("contest_id") % 89 == 7) & (F.month("held_date") == 10)
    kept = KeptRates(spark, f"{S.own_dir(spark)}/rates-{uuid.uuid4().hex}", ["rider"], "held_date", "is_place", 35, "month", 0.3, 20)
    kept.rebuild(e.where(~late).withColumn("is_place", F.when(wrong, 1 - F.col("is_place")).otherwise(F.col("is_place"))))
    kept.refresh(e, e.where(late | wrong).select("held_date"))
    return r6(spark.read.parquet(kept.rates).select("rider", "period", "past_n", "past_k", "rate"))


@query("""select o_orderkey, o_custkey, o_totalprice, extract(year from o_orderdate)::int as year from orders""")
def jdbc_orders(spark, sf):
    """Orders through a database, read back in even parts by their price. The database (one that Spark brings along) lives in
    the driver, so elsewhere than in a local session contestlab.jdbc.url must name one that all executors reach."""
    url = spark.conf.get("contestlab.jdbc.url", None)
    if not url:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set contestlab.jdbc.url to a database that all executors reach")
        url = f"jdbc:derby:memory:contestlab{uuid.uuid4().hex};create=true"
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("held_year"))
    name = f"orders_{uuid.uuid4().hex}"
    o.write.jdbc(url, name, properties={"batchsize": "5000"})
    return S.read_jdbc_even(spark, url, name, "o_totalprice", 8).withColumnRenamed("held_year", "year")
