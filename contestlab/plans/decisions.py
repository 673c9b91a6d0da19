"""Queries of quotes, prices, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.functions import columns as C
from contestlab.operators import effects as X
from contestlab.operators import evaluation as E
from contestlab.operators import quotes as Q
from contestlab.operators import windows as W
from contestlab.operators.boosting import grow
from contestlab.operators.confirmation import confirm_pairs
from contestlab.plans.base import ENTRY, entries, parts, query, r6, spread, table
from contestlab.sources.tables import settled

MAX_AGE = 14_400.0


def quote_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Contests are a user's days, starting at noon; quotes are the user's events, one market price and a price range."""
    e = table(spark, sf, "events")
    day = F.to_date("ts")
    targets = e.select("user_id", day.alias("day")).distinct().withColumn("scheduled_start_at", F.when(F.col("user_id") % 11 != 0, F.col("day").cast("timestamp") + F.expr("interval 12 hours")))
    price = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    quotes = e.groupBy("user_id", day.alias("day"), F.col("ts").alias("published_at")).agg(F.max_by(F.struct(price.alias("win_odds"), (F.col("value") / 2).alias("place_low"), (F.col("value") * 0.75).alias("place_high"), (F.col("event_id") % 9).cast("double").alias("win_popularity")), "event_id").alias("q"))
    return targets, quotes.select("user_id", "day", "published_at", "q.*", F.lit(None).cast("timestamp").alias("available_at"))


TARGETS = """t as (select distinct user_id, ts::date as day from events), c as (select *, case when user_id % 11 <> 0 then day::timestamp + interval 12 hour - interval 10 minute end cutoff_at from t),
q0 as (select *, row_number() over (partition by user_id, ts order by event_id desc) r from events), q as (select user_id, ts::date as day, ts published_at, case when event_id % 7 <> 0 then value end win_odds, value / 2 place_low, value * 0.75::double place_high, (event_id % 9)::double win_popularity from q0 where r = 1),
s as (select c.user_id, c.day, c.cutoff_at, q.published_at, q.win_odds, q.place_low, q.place_high, q.win_popularity, row_number() over (partition by c.user_id, c.day order by q.published_at desc) r from c left join q on c.user_id = q.user_id and c.day = q.day and q.published_at <= c.cutoff_at),
sel as (select *, case when cutoff_at is null then 'unknown_cutoff' when published_at is null then 'missing' when epoch(cutoff_at) - epoch(published_at) > 14400 then 'stale' when win_odds is null then 'unavailable' when win_odds >= 1 then 'available' else 'invalid' end win_status,
case when cutoff_at is null then 'unknown_cutoff' when published_at is null then 'missing' when epoch(cutoff_at) - epoch(published_at) > 14400 then 'stale' when place_low is null or place_high is null then 'unavailable' when place_low >= 1 and place_high >= place_low then 'available' else 'invalid' end place_status from s where r = 1)"""


def selected(spark, sf) -> DataFrame:
    t, q = quote_tables(spark, sf)
    return Q.select_quotes(t, q, ["user_id", "day"], ["win_odds", "place_low", "place_high"], Q.QuotePolicy(10, max_age=MAX_AGE))[0]


@query(f"with {TARGETS} select user_id, day, cutoff_at, published_at, win_odds from sel")
def asof_quotes_prestart(spark, sf):
    """JN10, O2, O3, D6: entries without quote stay."""
    return selected(spark, sf).select("user_id", "day", "cutoff_at", "published_at", "win_odds")


@query(f"with {TARGETS} select user_id, day, win_status, place_status from sel")
def market_status(spark, sf):
    """O1."""
    s = selected(spark, sf)
    return s.select("user_id", "day", Q.market_status(["win_odds"], MAX_AGE).alias("win_status"), Q.market_status(["place_low", "place_high"], MAX_AGE).alias("place_status"))


@query(f"""with {TARGETS}, f as (select user_id, day, case when win_status = 'available' then win_odds end p, case when epoch(cutoff_at) - epoch(published_at) <= 14400 and win_popularity >= 1 then win_popularity end pop from sel)
select user_id, day, p quote_price, round(ln(p), 6) quote_ln_price, pop quote_popularity, round(pop / 9, 6) quote_popularity_ratio, p is not null and pop is not null ready from f""")
def quote_features(spark, sf):
    """O4, O5."""
    f = Q.quote_features(selected(spark, sf).withColumn("starters", F.lit(9)), "win_odds", "win_popularity", "starters", MAX_AGE)
    return r6(f.select("user_id", "day", "quote_price", "quote_ln_price", "quote_popularity", "quote_popularity_ratio", Q.features_ready(["quote_price", "quote_popularity"]).alias("ready")))


#: Every entry's planted probability and price.
BETS = f"""{ENTRY}, bets0 as (select contest_id, entry_no, held_date, surface, klass, runner, field_size, is_place, is_win, (round(0.05::double + 4 * discount + tax, 4) + 0.00137::double) prob, 1 + quantity / 5.0::double odds from entry), bets1 as (select *, 1 / (1 + exp(-(ln(prob / (1 - prob)) + 0.2::double))) prob2 from bets0),
bets as (select *, round(prob - least(0.8::double / odds, 1), 9) edge, prob * odds - 1 ev from bets1)"""


def bets(spark, sf) -> DataFrame:
    e = entries(spark, sf).withColumns({"p": F.round(0.05 + 4 * F.col("discount") + F.col("tax"), 4) + 0.00137, "o": 1 + F.col("quantity") / 5.0})
    e = Q.edge_frame(e, "p", "o").withColumn("edge", F.round("edge", 9)).withColumn("prob2", 1 / (1 + F.exp(-(F.ln(F.col("prob") / (1 - F.col("prob"))) + 0.2))))
    return e


def held_bets(spark, sf) -> DataFrame:
    """bets, written once: operators that rank values read them several times. Building such a query runs jobs."""
    return settled(bets(spark, sf).select("contest_id", "entry_no", "held_date", "surface", "is_place", "prob", "prob2", "odds"))


@query(f"""with {BETS} select contest_id, entry_no, round(prob, 6) prob, round(1 / odds, 6) implied_prob, round(edge, 6) edge, round(ev, 6) ev, case when odds > 1 and odds <= 3 then '1-3' when odds > 3 and odds <= 6 then '3-6' when odds > 6 and odds <= 11 then '6-11' end odds_band,
round(case when odds > 1 then least(greatest((prob * odds - 1) / (odds - 1), 0), 0.05) end, 6) kelly_fraction, round(1 / (1 + exp(-(0.9::double * ln(prob / (1 - prob)) - 0.3::double * ln(odds) + 0.1))), 6) platt from bets""")
def edge_kelly(spark, sf):
    """O6, O7, O9, P33."""
    b = Q.kelly_ev(bets(spark, sf), "prob", "odds", 2000, 1.0, 0.05)
    return r6(b.select("contest_id", "entry_no", "prob", "implied_prob", "edge", "ev", C.cut_bands("odds", [1, 3, 6, 11], ["1-3", "3-6", "6-11"]).alias("odds_band"), "kelly_fraction", C.platt_apply("prob", "odds", 0.9, -0.3, 0.1).alias("platt")))


THRESHOLDS = (-0.1, 0.0, 0.05, 0.1, 0.2, 0.3)


@query(f"""with {BETS}, r as (select *, row_number() over (partition by contest_id order by edge desc, entry_no) r from bets), t as (select unnest({list(THRESHOLDS)})::double threshold)
select threshold, count(*) n_pool, count(*) filter (edge >= threshold) n_bets, (count(*) filter (edge >= threshold))::double total_stake, round(coalesce(sum(odds) filter (edge >= threshold and is_place = 1), 0), 4) total_return, round(avg(is_place) filter (edge >= threshold), 6) hit_rate, round(avg(edge) filter (edge >= threshold), 6) avg_edge, round(avg(ev) filter (edge >= threshold), 6) avg_ev,
round((count(*) filter (edge >= threshold))::double / count(*), 6) bets_rate, round(coalesce(sum(odds) filter (edge >= threshold and is_place = 1), 0) / nullif(count(*) filter (edge >= threshold), 0), 6) roi from r, t where r <= 1 group by 1""")
def threshold_sweep(spark, sf):
    """O8."""
    s = Q.threshold_sweep(bets(spark, sf), THRESHOLDS, "contest_id", "entry_no", "is_place")
    return r6(s).withColumn("total_return", F.round("total_return", 4))


@query(f"""with {BETS} select contest_id, entry_no, round(edge, 6) edge from bets where edge >= 0.25""")
def edge_candidates(spark, sf):
    """T3."""
    return r6(Q.edge_candidates(bets(spark, sf), 0.25, ["contest_id"]).select("contest_id", "entry_no", "edge"))


@query()
def logit_shift(spark, sf):
    """No SQL twin for bisection; tests hold the sums and the brute-force shift against it."""
    return r6(Q.logit_shift(bets(spark, sf), "contest_id", "entry_no", "prob").select("contest_id", "entry_no", "p_shifted"))


@query(f"""with {BETS}, s as (select contest_id, sum(prob) s, sum(prob2) s2, case when count(*) <= 7 then least(2, count(*)) else 3 end k from bets group by 1) select round(avg(abs(s - k)), 6) prob_mean_abs, round(avg(abs(s2 - k)), 6) prob2_mean_abs from s""")
def sum_check(spark, sf):
    """E16."""
    k = F.least(F.when(F.col("field_size") <= 7, 2).otherwise(3), F.col("field_size"))
    return r6(E.sum_check(bets(spark, sf), "contest_id", ["prob", "prob2"], k))


@query(f"""with {ENTRY}, x as (select contest_id, entry_no, field_size, case when entry_no % 9 = 8 then null else discount end p, case when contest_id % 5 = 0 then field_size + 1 else field_size end declared from entry)
select contest_id, entry_no, count(p) over w = count(*) over w and min(declared) over w = count(*) over w complete from x window w as (partition by contest_id)""")
def complete_contests(spark, sf):
    """O12, Q6."""
    e = entries(spark, sf).withColumns({"p": F.when(F.col("entry_no") % 9 != 8, F.col("discount")), "declared": F.when(F.col("contest_id") % 5 == 0, F.col("field_size") + 1).otherwise(F.col("field_size"))})
    return e.select("contest_id", "entry_no", Q.complete_contests("contest_id", "p", "declared").alias("complete"))


@query(f"""with {TARGETS}, p as (select user_id, day, cutoff_at + interval 10 minute start_at, win_status, place_status, case when win_status in ('available', 'unavailable') then 0.3::double end prob from sel),
r as (select *, case when start_at is null then 'unknown_start' when start_at <= timestamp '2024-01-10 12:00:00' then 'race_closed' when win_status not in ('available', 'unavailable') then 'missing_model_odds' when win_status <> 'available' then 'missing_calibration_odds' else 'predicted' end prediction_status, case when prob is null then 'prediction_unavailable' when place_status = 'available' then 'calculated' else place_status end ev_status from p)
select user_id, day, prediction_status, ev_status, case when ev_status = 'calculated' then '' else ev_status end skip_reason from r""")
def prediction_status(spark, sf):
    """O13."""
    s = selected(spark, sf).withColumns({"win_status": Q.market_status(["win_odds"], MAX_AGE), "place_status": Q.market_status(["place_low", "place_high"], MAX_AGE)})
    s = s.withColumn("prob", F.when(F.col("win_status").isin("available", "unavailable"), 0.3)).withColumns(Q.ev_status("prob", "place_status"))
    status = Q.prediction_status("scheduled_start_at", F.lit("2024-01-10 12:00:00").cast("timestamp"), F.col("prob").isNotNull(), F.col("win_status") == "available")
    return s.select("user_id", "day", status.alias("prediction_status"), "ev_status", "skip_reason")


@query(f"""with {BETS} select contest_id, entry_no, round(prob / sum(prob) over (partition by contest_id), 6) p_norm from bets""")
def normalized_probabilities(spark, sf):
    """O19."""
    return r6(Q.normalize_in_group(bets(spark, sf), "contest_id", "prob").select("contest_id", "entry_no", "p_norm"))


@query(f"""with {BETS}, d as (select prob2 - prob d from bets) select round(avg(d), 6) mean, round(stddev_samp(d), 6) sd, round(quantile_cont(abs(d), 0.95), 6) abs_p95, round(quantile_cont(abs(d), 0.99), 6) abs_p99, round(max(abs(d)), 6) abs_max from d""")
def shift_statistics(spark, sf):
    """O19."""
    return r6(Q.delta_stats(held_bets(spark, sf), "prob", "prob2"))


@query()
def pair_probabilities(spark, sf):
    """Iterative fitting has no SQL twin; tests check its marginals."""
    return r6(Q.pair_probabilities(bets(spark, sf), "contest_id", "entry_no", "prob"))


@query(f"""with {BETS}, b as (select *, ntile(10) over (order by odds, contest_id, entry_no) bucket from bets), m as (select floor(odds) bucket, avg(is_place) expected from bets group by 1) select contest_id, entry_no, round(is_place - expected, 6) excess from bets join m on floor(odds) = bucket""")
def excess_vs_market(spark, sf):
    """O16."""
    return r6(Q.excess_vs_market(bets(spark, sf).withColumn("bucket", F.floor("odds")), "bucket", "is_place").select("contest_id", "entry_no", "excess"))


@query(f"""with {BETS}, m as (select runner, median(prob) mp, median(odds) mo from bets group by 1) select contest_id, entry_no, round(prob - mp, 6) prob_residual, round(odds - mo, 6) odds_residual, round((prob - mp + odds - mo) / 2, 6) residual_mean from bets join m using (runner)""")
def residual_scores(spark, sf):
    """O17."""
    return r6(Q.residual_scores(bets(spark, sf), "runner", ["prob", "odds"]).select("contest_id", "entry_no", "prob_residual", "odds_residual", "residual_mean"))


@query(f"""with {BETS}, r as (select surface, is_place y, prob p, rank() over w + (count(*) over (partition by surface, prob) - 1) / 2.0 k from bets window w as (partition by surface order by prob))
select surface, count(*) n, sum(y)::bigint n_pos, round(avg((p - y) * (p - y)), 6) brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) logloss, round((sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::double), 6) auc from r group by 1""")
def binary_metrics(spark, sf):
    """Ranks of distinct values, not of rows."""
    return r6(E.binary_metrics(held_bets(spark, sf), "is_place", "prob", ["surface"]))


@query(f"""with {BETS}, e as (select unnest(quantile_cont(prob, {[i / 10 for i in range(11)]})) e from bets), d as (select e, row_number() over (order by e) - 1 i from (select distinct e from e)), m as (select max(i) m from d), b as (select prob, is_place, coalesce((select max(i) from d, m where i > 0 and i < m and e < prob), 0) bin from bets)
select bin::int bin, count(*) n, round(avg(prob), 6) p_mean, round(avg(is_place), 6) rate, round(avg(is_place) - avg(prob), 6) gap from b group by 1""")
def reliability_table(spark, sf):
    """E14."""
    return r6(E.reliability_table(held_bets(spark, sf), "prob", "is_place", 10))


@query(f"""with {BETS} select case when odds <= 3 then '1-3' when odds <= 6 then '3-6' else '6-11' end band, count(*) n, round(avg(prob), 6) p_mean, round(avg(is_place), 6) rate, round(avg(is_place) - avg(prob), 6) gap from bets group by 1 having count(*) >= 50""")
def reliability_by_band(spark, sf):
    """E15."""
    b = bets(spark, sf).withColumn("band", C.cut_bands("odds", [1, 3, 6, 11], ["1-3", "3-6", "6-11"], True))
    return r6(E.reliability_by_band(b, "band", "prob", "is_place", 50))


@query(f"""with {BETS}, l as (select is_place y, 'prob' predictor, prob v from bets union all select is_place, 'prob2', prob2 from bets) select predictor, count(*) n, round(avg((v - y) * (v - y)), 6) mse, round(sqrt(avg((v - y) * (v - y))), 6) rmse, round(avg(abs(v - y)), 6) mae, round(avg(v - y), 6) bias from l group by 1""")
def cohort_error_metrics(spark, sf):
    """E17."""
    return r6(E.error_metrics(bets(spark, sf), "is_place", ["prob", "prob2"]))


@query(f"""with {BETS} select surface, count(*) n, round(avg(abs(prob2 - prob)), 6) mean_abs, round(median(abs(prob2 - prob)), 6) median_abs, round(avg(((prob >= 0.5)::int = is_place)::int), 6) match_rate, round(avg(is_place), 6) label_rate from bets group by 1""")
def gap_summary(spark, sf):
    """E18."""
    b = held_bets(spark, sf).withColumn("delta", F.col("prob2") - F.col("prob"))
    return r6(E.gap_summary(b, "surface", "delta", (F.col("prob") >= 0.5).cast("int") == F.col("is_place"), "is_place"))


BUCKET = "greatest(1, ceil((row_number() over (partition by {by} order by {c}, contest_id, entry_no) - 1) * least(10, count(*) over (partition by {by})) / nullif(count(*) over (partition by {by}) - 1, 0)::double))::int"
WILSON = "round(sum(is_place)::double / count(*), 6) rate, round((sum(is_place)::double / count(*) + 3.841458820694124 / (2 * count(*))) / (1 + 3.841458820694124 / count(*)) - 1.959963984540054 * sqrt(sum(is_place)::double / count(*) * (1 - sum(is_place)::double / count(*)) / count(*) + 3.841458820694124 / (4.0 * count(*) * count(*))) / (1 + 3.841458820694124 / count(*)), 6) low, round((sum(is_place)::double / count(*) + 3.841458820694124 / (2 * count(*))) / (1 + 3.841458820694124 / count(*)) + 1.959963984540054 * sqrt(sum(is_place)::double / count(*) * (1 - sum(is_place)::double / count(*)) / count(*) + 3.841458820694124 / (4.0 * count(*) * count(*))) / (1 + 3.841458820694124 / count(*)), 6) high"


@query(f"with {BETS}, b as (select *, {BUCKET.format(by='surface', c='odds')} bucket from bets) select surface, bucket, count(*) n, round(avg(odds), 6) mean, sum(is_place)::bigint k, {WILSON} from b group by all")
def decile_wilson(spark, sf):
    """E19, E20."""
    b = E.rank_buckets(held_bets(spark, sf), "odds", ["contest_id", "entry_no"], 10, by=["surface"])
    return r6(E.bucket_summary(b, ["surface", "bucket"], "odds", "is_place"))


@query(f"with {BETS}, b as (select *, {BUCKET.format(by='surface', c='odds')} bucket from bets) select surface, count(*) filter (bucket = 1) n_first, count(*) filter (bucket = 10) n_last, round(avg(is_place) filter (bucket = 1), 6) rate_first, round(avg(is_place) filter (bucket = 10), 6) rate_last, round(avg(is_place) filter (bucket = 1) - avg(is_place) filter (bucket = 10), 6) difference from b group by 1")
def segment_contrast(spark, sf):
    """E21, E23."""
    b = E.rank_buckets(held_bets(spark, sf), "odds", ["contest_id", "entry_no"], 10, by=["surface"])
    return r6(E.segment_contrast(b, ["surface"], "bucket", "is_place"))


@query(f"with {BETS}, b as (select *, {BUCKET.format(by='surface', c='odds')} x, {BUCKET.format(by='surface', c='prob')} y from bets) select surface, x, y, count(*) n, round(avg(prob), 6) mean, sum(is_place)::bigint k, {WILSON} from b group by all")
def heatmap_wilson(spark, sf):
    """E22."""
    b = E.rank_buckets(held_bets(spark, sf), "odds", ["contest_id", "entry_no"], 10, "x", ["surface"])
    # added up from the smallest on, as means of few decimals are often half a unit of the last digit
    b = E.rank_buckets(b, "prob", ["contest_id", "entry_no"], 10, "y", ["surface"]).select("surface", "x", "y", "prob", "is_place").sortWithinPartitions("surface", "prob")
    return r6(E.bucket_summary(b, ["surface", "x", "y"], "prob", "is_place"))


@query(f"""with {BETS}, r as (select surface, rank() over (partition by surface order by prob) + (count(*) over (partition by surface, prob) - 1) / 2.0 x, rank() over (partition by surface order by odds) + (count(*) over (partition by surface, odds) - 1) / 2.0 y from bets) select surface, round(corr(x, y), 6) rank_correlation, count(*) n from r group by 1""")
def rank_correlation(spark, sf):
    """E24."""
    return r6(E.rank_correlation(held_bets(spark, sf), "prob", "odds", ["surface"]))


@query(f"""with {BETS}, s as (select surface g, count(*) n, avg(odds) m, var_samp(odds) v, median(odds) med from bets group by 1), p as (select a.g surface_a, b.g surface_b, a.n na, b.n nb, a.m - b.m mean_diff, a.med - b.med median_diff, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) cohen_d from s a join s b on a.g < b.g),
x as (select surface_a, surface_b, na, nb, odds, count(*) filter (surface = surface_a) ca, count(*) filter (surface = surface_b) cb from p join bets on surface = surface_a or surface = surface_b group by all), w as (select *, sum(ca) over o fa, sum(cb) over o fb from x window o as (partition by surface_a, surface_b order by odds rows unbounded preceding)),
t as (select surface_a, surface_b, max(abs(fa / na::double - fb / nb::double)) ks, sum(ca * (fb - cb / 2.0::double))::double u from w group by 1, 2) select surface_a, surface_b, round(mean_diff, 6) mean_diff, round(median_diff, 6) median_diff, round(cohen_d, 6) cohen_d, round(ks, 6) ks, round(u, 2) u from p join t using (surface_a, surface_b)""")
def pairwise_tests(spark, sf):
    """E25."""
    return r6(E.pairwise_tests(held_bets(spark, sf), "surface", "odds").drop("p_value"))


@query(f"""with {BETS}, b as (select case when abs(prob - is_place) <= 0.33 then 'le_0.33' when abs(prob - is_place) <= 0.66 then 'le_0.66' when abs(prob - is_place) <= 1 then 'le_1.00' end band, is_place from bets) select band, count(*) n, round(avg(is_place), 6) rate from b group by 1""")
def outcome_by_band(spark, sf):
    """E38."""
    b = bets(spark, sf).withColumn("delta", F.col("prob") - F.col("is_place"))
    return r6(X.outcome_by_band(b, "delta", "is_place", [0, 0.33, 0.66, 1.0], ["le_0.33", "le_0.66", "le_1.00"]))


def contributions(spark, sf) -> DataFrame:
    b = bets(spark, sf)
    part = [("prob", F.col("prob") - 0.3), ("odds", (F.col("odds") - 5) / 10), ("edge", F.col("edge"))]
    return b.select("contest_id", "entry_no", F.year("held_date").alias("year"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("contribution")) for n, c in part])).alias("x")).select("contest_id", "entry_no", "year", "x.*")


@query(f"""with {BETS}, l as (select year(held_date)::int as year, 'prob' feature, prob - 0.3::double c from bets union all select year(held_date)::int, 'odds', (odds - 5) / 10 from bets union all select year(held_date)::int, 'edge', edge from bets), m as (select feature, year, avg(abs(c)) mean_abs from l group by all)
select feature, year, round(mean_abs, 6) mean_abs, rank() over (partition by year order by mean_abs desc)::int contribution_rank, round(mean_abs / sum(mean_abs) over (partition by year), 6) contribution_share from m""")
def contribution_review(spark, sf):
    """Ranks by year."""
    return r6(X.contribution_review(contributions(spark, sf), "feature", "contribution", "year"))


@query(f"""with {BETS}, c as (select corr(prob, prob2) a, corr(prob, odds) b, corr(prob, edge) c from bets) select unnest(['prob2', 'odds', 'edge']) other, round(unnest([a, b, c]), 6) correlation, abs(unnest([a, b, c])) >= 0.9 redundant from c""")
def feature_redundancy(spark, sf):
    """E34."""
    return r6(X.redundancy(bets(spark, sf), "prob", ["prob2", "odds", "edge"]))


@query(f"""with {BETS}, c as (select contest_id, entry_no, case when prob >= 0.5 then case when is_place = 1 then 'TP' else 'FP' end when is_place = 1 then 'FN' else 'TN' end as "case", abs(prob - 0.5) d from bets), r as (select *, row_number() over (partition by "case" order by round(d, 9) desc, contest_id, entry_no)::int case_no from c) select "case", case_no, round(d, 6) distance from r where case_no <= 20""")
def review_cases(spark, sf):
    """The clearest hits and misses."""
    b = bets(spark, sf).withColumn("prob", F.round("prob", 9))
    return r6(X.case_lists(b, "prob", "is_place", [F.col("contest_id"), F.col("entry_no")], 20).select("case", "case_no", F.abs(F.col("prob") - 0.5).alias("distance")))


@query(f"""with {BETS} select contest_id, date_trunc('week', min(held_date))::date as week, round(avg(-case when is_place = 1 then ln(prob2) else ln(1 - prob2) end + case when is_place = 1 then ln(prob) else ln(1 - prob) end), 6) delta_logloss, round(avg((prob2 - is_place) * (prob2 - is_place) - (prob - is_place) * (prob - is_place)), 6) delta_brier from bets group by 1""")
def contest_metric_diff(spark, sf):
    """E33."""
    return r6(X.contest_metric_diff(bets(spark, sf), "contest_id", "held_date", "is_place", "prob", "prob2"))


@query()
def block_bootstrap(spark, sf):
    """Seeded draws of weeks, and the verdict by given thresholds; confirmed_pairs has the whole confirmation."""
    d = X.contest_metric_diff(bets(spark, sf), "contest_id", "held_date", "is_place", "prob", "prob2")
    i = X.block_bootstrap(d, "delta_logloss", "week", 200, 3)
    return r6(X.confirm(d.withColumn("fold", F.year("week")).groupBy("fold").agg(F.avg("delta_logloss").alias("delta_logloss")), i, 0.02, 0.01, 0.6))


@query()
def cell_effects(spark, sf):
    """Shrunk entity-by-condition effects; tests hold them against per-cell Newton in numpy."""
    return r6(X.cell_effects(bets(spark, sf), "runner", "surface", "prob", "is_place"))


@query()
def screened_pair(spark, sf):
    return r6(X.screen_pairs(X.cell_effects(bets(spark, sf), "runner", "surface", "prob", "is_place"), 5, 0.5, 0.01))


def _main_effects_sql(rounds: int = 10, strength: float = 10.0) -> str:
    """Alternating Newton steps, a table a step."""
    parts = ["g as (select ln(sum(is_place) / (count(*) - sum(is_place))) b from entry)"]
    parts.append("t0 as (select rider, surface, count(*) n, sum(is_place)::double k, 0::double e, 0::double c from entry group by all)")
    for i in range(2 * rounds):
        key, x = ("rider", "e") if i % 2 == 0 else ("surface", "c")
        step = f"(sum(k - n * p) over (partition by {key}) - {strength} * {x}) / (sum(n * p * (1 - p)) over (partition by {key}) + {strength})"
        kept = ", ".join(f"{x} + {step} {x}" if y == x else y for y in "ec")
        parts.append(f"t{i + 1} as materialized (select rider, surface, n, k, {kept} from (select *, 1 / (1 + exp(-(b + e + c))) p from t{i}, g))")
    return f"""with {ENTRY}, {', '.join(parts)}
select rider, surface, n, k, round(e, 6) e, round(c, 6) c, round(1 / (1 + exp(-(b + e + c))), 6) offset_p from t{2 * rounds}, g"""


@query(_main_effects_sql())
def main_effects(spark, sf):
    """Effects of rider and surface on the log-odds, fitted in turn, ten rounds as in the SQL."""
    return r6(X.main_effects(entries(spark, sf), "rider", "surface", "is_place", rounds=10))


def _centred_sql(rounds: int = 20) -> str:
    parts = ["t0 as (select rider, klass, avg(is_place) v, count(*)::double w from entry group by all)"]
    for i in range(rounds):
        parts.append(f"t{2 * i + 1} as materialized (select rider, klass, v - sum(v * w) over (partition by rider) / sum(w) over (partition by rider) v, w from t{2 * i})")
        parts.append(f"t{2 * i + 2} as materialized (select rider, klass, v - sum(v * w) over (partition by klass) / sum(w) over (partition by klass) v, w from t{2 * i + 1})")
    return f"with {ENTRY}, {', '.join(parts)} select rider, klass, round(v, 6) v from t{2 * rounds}"


@query(_centred_sql())
def double_center(spark, sf):
    """E29."""
    cells = entries(spark, sf).groupBy("rider", "klass").agg(F.avg("is_place").alias("v"), F.count("*").cast("double").alias("w"))
    return r6(X.double_center(cells, "rider", "klass", "v", "w").select("rider", "klass", "v"))


@query(f"""with {BETS}, f as (select runner, surface, year(held_date) fold, avg(is_place - prob) effect, count(*) n from bets group by all), s as (select runner, surface, count(*) fold_count, avg(effect) m, quantile_cont(effect, 0.025) lo, quantile_cont(effect, 0.975) hi, avg((effect > 0)::int) filter (abs(effect) > 1e-12) up, arg_max(n, fold) latest_n from f group by all)
select runner, surface, fold_count, round(m, 6) effect_mean, round(lo, 9) effect_low, round(hi, 9) effect_high, round(coalesce(greatest(up, 1 - up), 0), 6) sign_stability, latest_n, round(1 / (1 + exp(-(-1.3862943611198906 + m))) - 0.2, 6) effect_at_20pct from s""")
def cell_stability(spark, sf):
    """E32."""
    f = bets(spark, sf).groupBy("runner", "surface", F.year("held_date").alias("fold")).agg(F.avg(F.col("is_place") - F.col("prob")).alias("effect"), F.count("*").alias("n"))
    out = X.cell_stability(f, ["runner", "surface"])
    return out.withColumns({c: F.round(c, 9 if c in ("effect_low", "effect_high") else 6) for c, t in out.dtypes if t == "double"})


@query(f"""with {BETS}, m as (select surface scenario, avg(prob) auc, avg(prob2) logloss, avg(edge) brier from bets group by 1), b as (select auc a, logloss l, brier r from m where scenario = 'A'), d as (select scenario, auc - a da, logloss - l dl, brier - r db from m, b)
select scenario, round(da, 6) delta_auc, round(dl, 6) delta_logloss, round(db, 6) delta_brier, case when scenario = 'A' then 'baseline' when da > 0 and dl < 0 then 'improved' when da > 0 or dl < 0 then 'mixed' else 'not_improved' end judgement, case when scenario = 'A' then 'baseline' when da > 0 and dl < 0 then 'adopt' when da > 0 or dl < 0 then 'hold' else 'reject' end decision from d""")
def scenario_decision(spark, sf):
    """E35."""
    m = bets(spark, sf).groupBy(F.col("surface").alias("scenario")).agg(F.avg("prob").alias("auc"), F.avg("prob2").alias("logloss"), F.avg("edge").alias("brier"))
    return r6(X.decide_scenarios(m, "A").select("scenario", "delta_auc", "delta_logloss", "delta_brier", "judgement", "decision"))


@query(f"""with {BETS}, m as (select klass, surface, avg(prob) - 0.33 delta_auc, avg(odds) - 6.1 delta_logloss from bets group by all), c as (select *, (delta_auc > 0.002 and delta_logloss < -0.01) good from m), d as (select * from (select *, max(good::int) over (partition by klass) a from c) where good or a = 0),
b as (select *, first_value(delta_auc) over w ba, first_value(delta_logloss) over w bl from d window w as (partition by klass order by delta_auc desc, delta_logloss)), t as (select *, count(*) over (partition by klass) ties, row_number() over (partition by klass order by surface) r from b where abs(ba - delta_auc) <= 0.002 and abs(bl - delta_logloss) <= 0.01)
select klass, surface winner, case when ties > 1 then case when a = 1 then 'tie_prefer_simpler' else 'relative_tie_prefer_simpler' end else case when a = 1 then 'improved_best' else 'relative_best' end end reason, round(delta_auc, 6) delta_auc, round(delta_logloss, 6) delta_logloss from t where r = 1""")
def winner_selection(spark, sf):
    """E36."""
    m = bets(spark, sf).groupBy("klass", "surface").agg((F.avg("prob") - 0.33).alias("delta_auc"), (F.avg("odds") - 6.1).alias("delta_logloss"))
    return r6(X.choose_winners(m, "klass", "surface", "surface", 0.002, -0.01))


@query(f"""with {ENTRY}, y as (select contest_id, entry_no, max((entry_no = 5 and contest_id % 3 = 0)::int) over (partition by contest_id) bad, held_date from entry) select contest_id, entry_no, case when held_date < date '1999-01-01' then 'train' when held_date < date '2000-01-01' then 'validation' else 'test' end split from y where bad = 0""")
def contest_partition(spark, sf):
    """E2."""
    e = entries(spark, sf).withColumn("y", F.when(~((F.col("entry_no") == 5) & (F.col("contest_id") % 3 == 0)), F.col("is_place")))
    import datetime as dt

    return E.partition_contests(e, "contest_id", "held_date", "y", dt.date(1999, 1, 1), dt.date(2000, 1, 1)).select("contest_id", "entry_no", "split")


@query(f"""with {ENTRY}, f as (select unnest(range(0, 4)) fold) select fold::int fold, part, count(*) n from (select fold, case when held_date < (date '1999-01-01' + to_months((fold * 6)::int))::date then 'train' when held_date < (date '1999-01-01' + to_months(((fold + 1) * 6)::int))::date then 'validation' end part from entry, f) where part is not null group by all""")
def expanding_folds(spark, sf):
    """E7."""
    return E.expanding_folds(entries(spark, sf), "held_date", "1999-01-01", 6, 4).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query(f"""with {ENTRY}, y as (select *, year(held_date) y from entry), f as (select distinct y fold from y where y > (select min(y) from y)) select fold::int fold, case when y = fold then 'validation' else 'train' end part, count(*) n from y, f where y <= fold group by all""")
def year_folds(spark, sf):
    """E1, E8."""
    f, _ = E.year_folds(entries(spark, sf).withColumn("y", F.year("held_date")), "y", "contest_id")
    return f.groupBy("fold", "part").agg(F.count("*").alias("n"))


@query(f"""with {ENTRY}, t as (select * from entry where held_date < date '1999-01-01'), s as (select avg(price) m, stddev_pop(price) s from t), v as (select klass, row_number() over (order by klass) + 2 code from (select distinct klass from t))
select contest_id, entry_no, round((price - m) / s, 6) price_std, price is null price_missing, coalesce(code, 1)::int klass_code from entry left join v using (klass), s""")
def preprocess(spark, sf):
    """E3, E4."""
    e = entries(spark, sf)
    stats, vocab = E.fit_preprocess(e.where("held_date < date '1999-01-01'"), ["price"], ["klass"])
    return r6(E.apply_preprocess(e, stats, vocab, ["klass"]).select("contest_id", "entry_no", "price_std", "price_missing", "klass_code"))


@query()
def history_arrays(spark, sf):
    """E5, JN16: the last five runs of each entry's runner, padded, with masks; tests compare with lags."""
    e = spread(entries(spark, sf).select("contest_id", "entry_no", "runner", "held_date", "price", "finish"), parts(spark, sf), "runner")
    e = W.number_runs(e, "runner", ["held_date", "contest_id", "entry_no"]).withColumn("end_no", F.col("run_no") - 1)
    return E.history_arrays(e, e, ["contest_id", "entry_no"], "runner", "run_no", "end_no", ["price", "finish"], 5)


@query()
def contest_batches(spark, sf):
    """E6."""
    return E.contest_batches(entries(spark, sf), "contest_id", "entry_no", ["price", "discount"])


@query()
def sampled_entries(spark, sf):
    """The sampling feature itself, 50 rows a year by a seeded hash."""
    return X.sample_per_group(entries(spark, sf).withColumn("year", F.year("held_date")), ["year"], ["contest_id", "entry_no"], 50, 7).select("year", "contest_id", "entry_no")


FEATURES = ["quantity", "discount", "tax", "field_size"]


@query()
def boosted_metrics(spark, sf):
    """Boosted trees by year folds over all years, calibrated, with metrics by year."""
    e = settled(entries(spark, sf).select("contest_id", F.year("held_date").alias("year"), (1 + F.col("quantity") / 5.0).alias("odds"), "is_place", *FEATURES))
    oof = settled(E.oof_predictions(e, "year", "contest_id", FEATURES, "is_place").withColumns({"z": C.logit_clip("p"), "ln_odds": F.ln("odds")}))
    a, b, c = E.platt_fit(oof, "z", "ln_odds", "is_place")
    return E.binary_metrics(oof.withColumn("p_cal", C.platt_apply("p", "odds", a, b, c)), "is_place", "p_cal", ["year"])


@query()
def feature_importance(spark, sf):
    """Gain and number of splits of each feature in boosted trees over all entries."""
    trees = grow(entries(spark, sf).select("is_place", *FEATURES), FEATURES, "is_place", F.array(F.lit("all")))
    return spark.createDataFrame([r[1:] for r in trees.importance()], "feature string, gain double, splits long").orderBy(F.desc("gain"), "feature")


def _condition_split(spark, sf) -> DataFrame:
    return E.condition_split(entries(spark, sf), "surface", FEATURES, "is_place", F.col("held_date") < "1999-01-01")


@query()
def condition_split(spark, sf):
    """By surface, a model of all entries against one of the surface's entries, tried on the contests from 1999 on."""
    return _condition_split(spark, sf)


@query()
def condition_split_summary(spark, sf):
    """The experiment in one row, weighted by test rows."""
    return E.summarise_slices(_condition_split(spark, sf))


def _slices_sql(by: str) -> str:
    side = """m{s} as (select {by} c, count(*) n, avg((p - y) * (p - y)) brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) logloss, (sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::double) auc
from (select {by}, is_place y, {p} p, rank() over w + (count(*) over (partition by {by}, {p}) - 1) / 2.0 k from bets window w as (partition by {by} order by {p})) group by 1)"""
    sides = ",\n".join(side.format(s=s, by=by, p=p) for s, p in (("b", "prob"), ("l", "prob2")))
    return f"{sides},\ns as (select b.c, b.n, b.auc auc_base, b.brier brier_base, b.logloss logloss_base, l.auc auc_local, l.brier brier_local, l.logloss logloss_local from mb b join ml l using (c))"


WEIGHTED = ", ".join(f"round(sum({x} * n) / sum(n), 6) weighted_{c}" for c, x in [(f"{m}_{s}", f"{m}_{s}") for s in ("base", "local") for m in ("auc", "brier", "logloss")] + [(f"delta_{m}", f"({m}_local - {m}_base)") for m in ("auc", "brier", "logloss")])


@query(f"""with {BETS}, {_slices_sql("klass")}
select count(*) slices, count(*) compared_slices, 0::bigint skipped_slices, count(*) filter (logloss_local < logloss_base) improved_slices, sum(n)::bigint test_rows, sum(n)::bigint compared_test_rows,
coalesce(sum(n) filter (logloss_local < logloss_base), 0)::bigint improved_test_rows, {WEIGHTED} from s""")
def weighted_slices(spark, sf):
    """Two predictions compared by class, weighted by rows."""
    b = settled(bets(spark, sf).select("klass", "is_place", "prob", "prob2"))
    return r6(E.summarise_slices(E.compare_slices(b, "klass", "is_place", "prob", "prob2")))


@query()
def effect_summary(spark, sf):
    """Effects alone and beside controls."""
    b = bets(spark, sf).withColumn("year", F.year("held_date") - 1995)
    return r6(E.effect_summary(b, ["odds", "prob", "discount"], "is_place", ["field_size", "year"], "finish"))


@query()
def interaction_effects(spark, sf):
    """Products of two columns and what is derived from them, beside controls."""
    b = bets(spark, sf).withColumns({"last": F.col("quantity") / 4.0, "total": F.col("quantity") / 2.0 + 100 * F.col("tax") + 5 * F.col("discount")})
    return r6(E.interaction_effects(b, {"pace": ("last", "total"), "price": ("discount", "tax")}, "is_place", lambda x, y: (F.col(y) - F.col(x)) / 3 - F.col(x), ["field_size"]))


@query()
def confirmed_pairs(spark, sf):
    """Two pairs of entity and condition confirmed out of sample over four half-years."""
    return r6(confirm_pairs(bets(spark, sf), {"rider/surface": ("rider", "surface"), "trainer/klass": ("trainer", "klass")}, "held_date", "contest_id", "prob", "is_place", "1997-01-01"))


BANDED = "x as (select *, case when odds <= 3 then '1-3' when odds <= 6 then '3-6' else '6-11' end band from bets)"


@query(f"with {BETS}, {BANDED}, b as (select *, {BUCKET.format(by='band', c='prob').replace('least(10,', 'least(5,')} bin from x) select band, bin, count(*) n, round(avg(prob), 6) p_mean, round(avg(is_place), 6) rate, round(avg(is_place) - avg(prob), 6) gap from b group by all having count(*) >= 20")
def reliability_curves(spark, sf):
    """A reliability curve of five points for each odds band."""
    b = held_bets(spark, sf).withColumn("band", C.cut_bands("odds", [1, 3, 6, 11], ["1-3", "3-6", "6-11"], True))
    return r6(E.reliability_curves(b, "band", "prob", "is_place", ["contest_id", "entry_no"], 5, 20))


@query(f"with {BETS}, o as (select *, {BUCKET.format(by='surface', c='odds').replace('least(10,', 'least(4,')} outer_bucket from bets), b as (select *, {BUCKET.format(by='surface, outer_bucket', c='prob')} bucket from o) select surface, outer_bucket, bucket, count(*) n, round(avg(prob), 6) mean, sum(is_place)::bigint k, {WILSON} from b group by all")
def nested_deciles(spark, sf):
    """Deciles of the probability within quarters of the odds."""
    return r6(E.nested_buckets(held_bets(spark, sf), "odds", "prob", ["contest_id", "entry_no"], 4, 10, "is_place", ["surface"]))
