"""Composed feature pipelines: facts, histories, encodings, and the feature row of an entry, each a table by itself. A row
of features uses only what was known before its contest's date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions import columns as C
from contestlab.operators import checks as K
from contestlab.operators import joins as J
from contestlab.operators import windows as W
from contestlab.plans.base import ENTRY, entries, parts, query, r6, spread, table
from contestlab.plans.decisions import MAX_AGE, TARGETS, selected
from contestlab.operators import quotes as Q
from contestlab.streaming.quotes import latest_quotes, prestart_entries, prestart_quotes

PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


@query("""select o_orderkey contest_id, o_orderdate::date held_date, month(o_orderdate)::int as month, year(o_orderdate)::int as year, date_trunc('month', o_orderdate)::date month_start, make_date(year(o_orderdate), 1, 1) year_start,
(lpad(o_custkey::varchar, 6, '0') || lpad(o_orderkey::varchar, 8, '0'))::bigint contest_code, case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 2 when '5-LOW' then 1 else 0 end level,
case when o_totalprice < 50000 then 0 when o_totalprice < 100000 then 1 when o_totalprice < 200000 then 2 when o_totalprice is not null then 3 end price_bin, ntile(3) over (partition by o_orderpriority order by o_totalprice nulls last, o_orderkey)::int price_third from orders""")
def contest_facts(spark, sf):
    """P1, P10, P11, P26, W5."""
    o = table(spark, sf, "orders").withColumn("held_date", F.col("o_orderdate").cast("date"))
    o = W.ntile_in_group(o, ["o_orderpriority"], [F.asc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 3, "price_third")
    return o.select(F.col("o_orderkey").alias("contest_id"), "held_date", *[c.alias(n) for n, c in C.calendar_parts("held_date").items()], C.composite_id(["o_custkey", "o_orderkey"], [6, 8]).alias("contest_code"), C.map_codes("o_orderpriority", PRIORITY, 0).alias("level"), C.bin_fixed("o_totalprice", [50000, 100000, 200000]).alias("price_bin"), "price_third")


@query("""with r as (select *, case when l_quantity % 10 = 0 then '----' else lpad((l_quantity * 10)::int::varchar, 4, '0') end raw, case when l_linenumber % 3 = 0 then '-' when l_linenumber % 3 = 1 then '+' else ' ' end sign, (l_linenumber * 7)::varchar mag from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(try_cast(raw as double) / 10, 6) clean_quantity, case when try_cast(raw as int) > 0 then round(floor(try_cast(raw as int) / 1000.0) * 60 + (try_cast(raw as int) % 1000) / 10.0, 6)::double end clock, case trim(sign) when '+' then mag::int when '-' then -mag::int end signed, greatest(l_discount - 0.05, 0)::double clamped, '07-' || lpad((l_linenumber + 10)::varchar, 2, '0') pair_key, l_quantity::double as "leading" from r""")
def cleaned_entries(spark, sf):
    """P2 to P7 on text made of the numbers."""
    li = table(spark, sf, "lineitem").withColumns({
        "raw": F.when(F.col("l_quantity") % 10 == 0, "----").otherwise(F.lpad((F.col("l_quantity") * 10).cast("int").cast("string"), 4, "0")), "sign": F.when(F.col("l_linenumber") % 3 == 0, "-").when(F.col("l_linenumber") % 3 == 1, "+").otherwise(" "), "mag": (F.col("l_linenumber") * 7).cast("string"),
        "pair": F.concat_ws(" / ", F.lpad((F.col("l_linenumber") + 10).cast("string"), 2, "0"), F.lit("07")), "messy": F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("kg(+2)")),
    })
    return r6(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", C.clean_num("raw", ["", "----", "****"], 10).alias("clean_quantity"), C.clock_to_seconds("raw").alias("clock"), C.signed_value("sign", "mag").alias("signed"), C.clamp_nonneg(F.col("l_discount") - 0.05).alias("clamped"), C.pair_key("pair").alias("pair_key"), C.extract_number("messy").alias("leading")))


@query("""select event_id, ts, (ts - interval 9 hour)::timestamp as published_utc, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') row_id from events""")
def normalised_quotes(spark, sf):
    """P8, P9, P34: a publication time without year, in a zone, against the contest's date."""
    e = table(spark, sf, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    at = C.roll_year_timestamp(F.year("ts"), F.date_format("minute", "MMddHHmm"), F.to_date("ts"), "Asia/Tokyo")
    rest = F.col("ts").cast("timestamp").cast("double") - F.col("minute").cast("timestamp").cast("double")
    return e.select("event_id", "ts", F.timestamp_micros(((at.cast("double") + rest) * 1e6).cast("long")).cast("timestamp_ntz").alias("published_utc"), C.row_hash(["event_id", "event_type"]).alias("row_id"))


@query(f"""with {ENTRY}, l as (select *, case when entry_no % 6 = 0 then null else finish end result from entry) select contest_id, entry_no, case when result is not null then 'resulted' when tax < 0.02 then 'scratched' else 'declared' end status, result is null and not tax < 0.02 is_target, case when discount <= 0.03 then (1 / (1 + discount))::double end blended from l where true""", name="entry_status")
def entry_status(spark, sf):
    """Lifecycle of an entry."""
    e = entries(spark, sf).withColumn("result", F.when(F.col("entry_no") % 6 != 0, F.col("finish")))
    status = F.when(F.col("result").isNotNull(), "resulted").when(F.col("tax") < 0.02, "scratched").otherwise("declared")
    return e.select("contest_id", "entry_no", status.alias("status"), (status == "declared").alias("is_target"), F.when(F.col("discount") <= 0.03, 1 / (1 + F.col("discount"))).alias("blended"))


@query(f"""with {ENTRY} select contest_id, entry_no, round((quantity + price / 1000) / 2, 6) mid, round(0.7::double * quantity + 0.3::double * price / 1000, 6) weighted, round(((price / 100 - discount * 10) / 3 - discount * 10), 6) sharpness, nullif(case when quantity % 2 = 0 then price else tax end, 0) half, round(log10(quantity + 1), 6) log_quantity, round(ln(nullif(discount, 0)), 6) ln_discount,
round(ln((least(greatest(discount, 1e-6::double), 1 - 1e-6::double)) / (1 - least(greatest(discount, 1e-6::double), 1 - 1e-6::double))) - ln((least(greatest(tax, 1e-6::double), 1 - 1e-6::double)) / (1 - least(greatest(tax, 1e-6::double), 1 - 1e-6::double))), 6) logit_diff, coalesce(surface, klass) first_known, tax is null tax_missing from entry""")
def entry_formulas(spark, sf):
    """P21 to P25, P27, P30."""
    e = entries(spark, sf).withColumn("high", F.col("price") / 1000)
    s = e.withColumns({"l4": F.col("price") / 100, "l1": F.col("discount") * 10, "d": F.col("quantity") * 100})
    return r6(s.select("contest_id", "entry_no", C.blend_price("quantity", "high").alias("mid"), C.blend_price("quantity", "high", "weighted").alias("weighted"), C.sharpness("l4", "l1").alias("sharpness"), C.half_length("d", "price", "tax").alias("half"), C.log10p1("quantity").alias("log_quantity"), C.safe_ln("discount").alias("ln_discount"), C.logit_diff("discount", "tax").alias("logit_diff"), F.coalesce("surface", "klass").alias("first_known"), C.missing_flags(["tax"])["tax_missing"].alias("tax_missing")))


SOFT = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(f"""with {ENTRY}, c as (select unnest({list(range(5))}) b), r as (select surface, least(floor(quantity / 50 * 4), 4)::int b, avg(is_place) v from entry group by all), x as (select contest_id, entry_no, surface, least(greatest(quantity / 50, 0), 1) x from entry),
w as (select x.*, c.b, greatest(0, 1 - abs(x - c.b * 0.25::double) / 0.25::double) w from x, c) select w.contest_id, w.entry_no, round(sum(w * v) / nullif(sum(case when v is not null then w end), 0), 6) soft_rate, any_value(case when x < 0.25 then 0 when x < 0.5 then 1 when x < 0.75 then 2 else 3 end)::int hard_bin from w left join r on r.surface = w.surface and r.b = w.b where w > 0 group by 1, 2""")
def soft_bin_lookup(spark, sf):
    """Rates of neighbouring bins mixed by triangular weights."""
    e = entries(spark, sf)
    rates = e.groupBy("surface", F.least(F.floor(F.col("quantity") / 50 * 4), F.lit(4)).cast("int").alias("b")).agg(F.avg("is_place").alias("v"))
    x = e.withColumn("x", F.least(F.greatest(F.col("quantity") / 50, F.lit(0.0)), F.lit(1.0))).select("contest_id", "entry_no", "surface", "x", F.posexplode(C.soft_bin_weights("x", SOFT, 0.25)).alias("b", "w")).where("w > 0")
    out = x.join(rates, ["surface", "b"], "left").groupBy("contest_id", "entry_no").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), F.lit(0.0))).alias("soft_rate"), F.first(C.hard_bin("x", [0.25, 0.5, 0.75])).alias("hard_bin"))
    return r6(out)


@query(f"""with {ENTRY}, n as (select contest_id, entry_no, runner, held_date, row_number() over (partition by runner order by held_date, contest_id, entry_no) run_no from entry where not (entry_no = 2 and contest_id % 4 = 0)),
l as (select e.contest_id, e.entry_no, max(n.run_no) end_no from entry e join n on n.runner = e.runner and n.held_date < e.held_date group by all) select e.contest_id, e.entry_no, coalesce(end_no, 0)::bigint end_no, e.field_size from entry e left join l using (contest_id, entry_no)""")
def run_record_pointer(spark, sf):
    """W17, W18, JN11: numbered runs without nonstarters, and how far back an entry may look."""
    e = entries(spark, sf)
    runs = W.number_runs(e.where("not (entry_no = 2 and contest_id % 4 = 0)").select("contest_id", "entry_no", "runner", "held_date"), "runner", ["held_date", "contest_id", "entry_no"])
    out = J.last_before(e.select("contest_id", "entry_no", "runner", "held_date", "field_size"), runs, "runner", "held_date", "held_date", "run_no", ["run_no"])
    return out.select("contest_id", "entry_no", F.coalesce("last_run_no", F.lit(0)).cast("long").alias("end_no"), "field_size")


def past_counts(keys: list[str], month: str, label: str, back: int) -> tuple[Column, Column]:
    """Rows and hits of a key in the `back` observed months before each row's, as columns of the rows themselves; month numbers the key's
    months without gaps."""
    w = Window.partitionBy(*keys).orderBy(month).rangeBetween(-back, -1)
    return F.coalesce(F.count("*").over(w), F.lit(0)), F.coalesce(F.sum(F.col(label).cast("long")).over(w), F.lit(0))


def feature_matrix_of(e: DataFrame, n: int | None = None) -> DataFrame:
    """A short row per entry with rates of its rider, its pair history, lags, relative form and peers. A row moves once by rider
    and once by runner (in n tasks each), and windows look back from it there; what needs its contest comes first, where entries
    lie by contest."""
    e = W.group_z(e.select("contest_id", "entry_no", "held_date", "rider", "runner", "surface", "quantity", "finish", "is_place", "is_win"), ["contest_id"], ["quantity"]).drop("quantity")
    month = F.trunc("held_date", "month")
    e = spread(e, n, "rider")
    e = e.withColumns({"__m": F.dense_rank().over(Window.partitionBy("rider").orderBy(month)), "__ms": F.dense_rank().over(Window.partitionBy("rider", "surface").orderBy(month))})
    dated = F.col("rider").isNotNull() & F.col("held_date").isNotNull()
    for name, keys, m, known in (("rider", ["rider"], "__m", dated), ("surface", ["rider", "surface"], "__ms", dated & F.col("surface").isNotNull())):
        past_n, past_k = past_counts(keys, m, "is_place", 35)
        e = e.withColumns({f"{name}_n": past_n, f"{name}_k": past_k}).withColumns({f"{name}_n": F.when(known, F.col(f"{name}_n")), f"{name}_k": F.when(known, F.col(f"{name}_k"))})
    e = spread(e.drop("__m", "__ms", "rider", "surface"), n, "runner")
    lags = W.lag_vector(e, "runner", ["held_date", "contest_id", "entry_no"], ["finish", "held_date"], 3)
    # several runs of one day count as one time: only lags of earlier dates are seen
    seen = {f"finish_lag{i}": F.when(F.col(f"held_date_lag{i}") < F.col("held_date"), F.col(f"finish_lag{i}")) for i in (1, 2, 3)}
    out = J.decayed_rows(lags.withColumns(seen), ["runner"], "held_date", ["is_place"], 180)
    out = out.withColumns({"runner_decayed": F.when(F.col("runner").isNotNull() & F.col("held_date").isNotNull(), F.col("is_place_decayed")), "rider_rate": F.when(F.col("rider_n").isNotNull(), C.smooth_rate("rider_k", "rider_n", 0.3, 20)), "rider_surface_rate": F.when(F.col("surface_n").isNotNull(), C.smooth_rate("surface_k", "surface_n", 0.3, 20))})
    lag = ["finish_lag1", "finish_lag2", "finish_lag3"]
    return out.select("contest_id", "entry_no", "held_date", "rider_rate", "rider_n", C.logit_diff("rider_surface_rate", "rider_rate").alias("surface_logit_diff"), "runner_decayed", C.lag_avg(lag).alias("finish_avg3"), C.lag_wavg(lag, [0.5, 0.3, 0.2]).alias("finish_wavg3"), C.lag_min(lag).alias("finish_best3"), "quantity_z", "is_place", "is_win")


@query(f"""with {ENTRY}, p as (select rider, date_trunc('month', held_date)::date as month, count(*) n, sum(is_place) k from entry group by all), r as (select rider, month, (coalesce(sum(k) over w, 0) + 6::double) / (coalesce(sum(n) over w, 0) + 20::double) rider_rate, coalesce(sum(n) over w, 0)::bigint rider_n from p window w as (partition by rider order by month rows between 35 preceding and 1 preceding)),
ps as (select rider, surface, date_trunc('month', held_date)::date as month, count(*) n, sum(is_place) k from entry group by all), rs as (select rider, surface, month, (coalesce(sum(k) over w, 0) + 6::double) / (coalesce(sum(n) over w, 0) + 20::double) q from ps window w as (partition by rider, surface order by month rows between 35 preceding and 1 preceding)),
d as (select runner, held_date, sum(is_place) k from entry group by all), h as (select a.runner, a.held_date, sum(b.k * pow(0.5, date_diff('day', b.held_date, a.held_date) / 180.0::double)) runner_decayed from d a left join d b on a.runner = b.runner and b.held_date < a.held_date group by all),
l as (select *, lag(finish, 1) over w f1, lag(finish, 2) over w f2, lag(finish, 3) over w f3, lag(held_date, 1) over w d1, lag(held_date, 2) over w d2, lag(held_date, 3) over w d3, (quantity - avg(quantity) over c) / nullif(stddev_pop(quantity) over c, 0) quantity_z from entry window w as (partition by runner order by held_date, contest_id, entry_no), c as (partition by contest_id)),
m as (select *, case when d1 < held_date then f1 end a, case when d2 < held_date then f2 end b, case when d3 < held_date then f3 end c from l)
select contest_id, entry_no, m.held_date, round(rider_rate, 6) rider_rate, rider_n, round(ln(q / (1 - q)) - ln(rider_rate / (1 - rider_rate)), 6) surface_logit_diff, round(runner_decayed, 6) runner_decayed, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0)::double, 6) finish_avg3,
round((coalesce(a * 0.5::double, 0) + coalesce(b * 0.3::double, 0) + coalesce(c * 0.2::double, 0)) / nullif(case when a is not null then 0.5::double else 0 end + case when b is not null then 0.3::double else 0 end + case when c is not null then 0.2::double else 0 end, 0), 6) finish_wavg3, least(a, b, c) finish_best3, round(quantity_z, 5) quantity_z, is_place, is_win
from m join r on m.rider = r.rider and date_trunc('month', m.held_date)::date = r.month join rs on m.rider = rs.rider and m.surface = rs.surface and date_trunc('month', m.held_date)::date = rs.month join h on m.runner = h.runner and m.held_date = h.held_date""")
def feature_matrix(spark, sf):
    """D23 to D26."""
    f = feature_matrix_of(entries(spark, sf), parts(spark, sf))
    return r6(f.withColumn("quantity_z", F.round("quantity_z", 5)))


@query(f"""with {TARGETS} select user_id, day, case when win_status = 'available' then win_odds end win_price, bool_or(win_status = 'available') over (partition by day) any_price from sel""")
def inference_contract(spark, sf):
    """D26, AG5, FL2."""
    s = selected(spark, sf).withColumn("status", Q.market_status(["win_odds"], MAX_AGE))
    return s.select("user_id", "day", F.when(F.col("status") == "available", F.col("win_odds")).alias("win_price"), F.bool_or(F.col("status") == "available").over(Window.partitionBy("day")).alias("any_price"))


@query("""select l_orderkey, l_partkey, p_brand, p_type, s_name, n_name, r_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def wide_view(spark, sf):
    """D28, JN1, JN2, JN6: a readable row; nation and region have 25 and 5 rows by definition, so they are broadcast."""
    place = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part", "p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_brand", "p_type", "s_name", "n_name", "r_name")


@query("""with m as (select p_partkey, case when p_size >= 1 and p_size < 15 then 'small' when p_size >= 15 and p_size < 40 then 'middle' end s, p_brand from part) select p_partkey, length(p_brand) || ':' || p_brand || '|' || length(s) || ':' || s condition_key, s is not null fits from m""")
def condition_keys(spark, sf):
    """P32."""
    spec = {"kind": "cross", "parts": [{"kind": "identity", "column": "p_brand"}, {"kind": "ranges", "column": "p_size", "ranges": [("small", 1, 15), ("middle", 15, 40)]}]}
    key, fits = C.materialize_condition(spec)
    return table(spark, sf, "part").select("p_partkey", key.alias("condition_key"), fits.alias("fits"))


@query("""select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1""")
def dq_unique_grain(spark, sf):
    """Q1."""
    return K.not_unique(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("""with a as (select user_id, event_type from events), b as (select user_id, case when event_id % 50 = 0 then 'other' else event_type end event_type from events) select *, 'left' side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)""")
def dq_symmetric_diff(spark, sf):
    """Q2, U3."""
    e = table(spark, sf, "events")
    return K.symmetric_difference(e.select("user_id", "event_type"), e.select("user_id", F.when(F.col("event_id") % 50 == 0, "other").otherwise(F.col("event_type")).alias("event_type")))


@query("""select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') or o_totalprice is null or o_totalprice < 5000""")
def dq_values(spark, sf):
    """Q4, Q11."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return K.violations(o, K.accepted("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]) | K.not_null("o_totalprice") | {"price": F.col("o_totalprice") >= 5000}).drop("violations")


@query(f"""with {ENTRY}, n as (select contest_id, entry_no, runner, held_date, row_number() over (partition by runner order by held_date, contest_id, entry_no) run_no from entry), g as (select * from n where run_no % 10 <> 3), p as (select *, lag(run_no) over (partition by runner order by run_no) l from g) select contest_id, entry_no, runner, run_no from p where run_no <> coalesce(l, 0) + 1""")
def dq_sequence(spark, sf):
    """Q8: gaps in numbered runs."""
    n = W.number_runs(entries(spark, sf).select("contest_id", "entry_no", "runner", "held_date"), "runner", ["held_date", "contest_id", "entry_no"]).where("run_no % 10 <> 3")
    return K.broken_sequence(n, "runner", "run_no", "held_date").select("contest_id", "entry_no", "runner", F.col("run_no").cast("long").alias("run_no"))


@query(f"""with {TARGETS}, x as (select c.user_id, c.day, bool_or(q.published_at > c.cutoff_at) late from c join q using (user_id, day) group by all) select user_id, day, late from x where late""")
def dq_late_quotes(spark, sf):
    """Q5."""
    from contestlab.plans.decisions import quote_tables

    t, q = quote_tables(spark, sf)
    return K.late_quotes(q.join(t.withColumn("cutoff_at", Q.QuotePolicy(10).cutoff()), ["user_id", "day"]), ["user_id", "day"], "published_at", "cutoff_at")


@query("""with f as (select l_orderkey k, count(*) n from lineitem where l_linenumber <> 7 group by 1), d as (select l_orderkey k, count(*) declared from lineitem group by 1) select k contest_id, declared, n n_entries from d full join f using (k) where declared is distinct from n""")
def dq_incomplete_fields(spark, sf):
    """Q6."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest_id"), "l_linenumber")
    return K.incomplete_fields(li.where("l_linenumber <> 7"), li.groupBy("contest_id").agg(F.count("*").alias("declared")), "contest_id", "declared")


@query("""select o_orderkey, o_totalprice l, case when o_orderkey % 20 = 0 then null else o_totalprice end r from orders where o_orderkey % 20 = 0""")
def dq_parity(spark, sf):
    """Q9, FL5."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    d = K.rows_differ(o, o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_totalprice"))), ["o_orderkey"], ["o_totalprice"])
    return d.select("o_orderkey", F.col("left_row.o_totalprice").alias("l"), F.col("right_row.o_totalprice").alias("r"))


@query("""select distinct l_partkey p_partkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 5)""")
def dq_uncovered(spark, sf):
    """Q10."""
    return K.uncovered(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), table(spark, sf, "part").where("p_size > 5"), ["p_partkey"])


@query("""with k as (select *, count(*) over (partition by l_orderkey, l_linenumber) n from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from k where n > 1 or l_linenumber < 1""")
def dq_frame(spark, sf):
    """Q12."""
    return K.frame_checks(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], "l_linenumber", "l_orderkey").drop("violations")


@query(f"""with {ENTRY} select contest_id, count(distinct held_date) dates, count(*) n from entry group by 1 having count(*) <> max(case when contest_id % 9 = 0 then field_size + 1 else field_size end)""")
def dq_bundle(spark, sf):
    """Q13."""
    e = entries(spark, sf).withColumn("declared", F.when(F.col("contest_id") % 9 == 0, F.col("field_size") + 1).otherwise(F.col("field_size")))
    return K.bundle_checks(e, "contest_id", "held_date", "declared", "is_place").select("contest_id", "dates", "n")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) select user_id, ts, event_id, value from r where r = 1""")
def latest_quotes_batch(spark, sf):
    """ST1's batch twin."""
    return latest_quotes(table(spark, sf, "events"), ["user_id"], "ts", "event_id", ["value"])


@query("""with q as (select user_id, ts, event_id, value from events), c as (select user_id, max(ts) - interval 1 day cutoff from q group by 1), r as (select q.*, cutoff, row_number() over (partition by user_id, cutoff order by ts desc, event_id desc) r from q join c using (user_id) where ts <= cutoff)
select user_id, cutoff, ts, event_id, value from r where r = 1""")
def prestart_batch(spark, sf):
    """ST2's batch twin: each user's newest event up to a day before their last."""
    q = table(spark, sf, "events", "user_id", "ts", "event_id", "value")
    c = q.groupBy("user_id").agg((F.max("ts") - F.expr("interval 1 day")).alias("cutoff"))
    return prestart_quotes(q, c, ["user_id"], "ts", "cutoff", "event_id", ["value"])


@query(f"""with {TARGETS}, p as (select user_id, day, min(cutoff_at) cutoff_at from c group by all), q1 as (select *, row_number() over (partition by p.user_id, p.day order by published_at desc) rr from p left join q using (user_id, day) where published_at is null or cutoff_at is null or published_at <= cutoff_at)
select p.user_id, p.day, p.cutoff_at, x.published_at, x.win_odds from p left join (select * from q1 where rr = 1 and published_at <= cutoff_at) x on x.user_id = p.user_id and x.day = p.day""")
def prestart_entries_batch(spark, sf):
    """ST2, D6: every declared entry with its newest quote by the cutoff, those without a quote too; the stream's batch twin."""
    from contestlab.plans.decisions import quote_tables

    t, q = quote_tables(spark, sf)
    entries = t.withColumn("cutoff_at", Q.QuotePolicy(10).cutoff())
    q = q.withColumn("tie", F.lit(0))
    return prestart_entries(q, entries, ["user_id", "day"], "published_at", "cutoff_at", "tie", ["win_odds"]).select("user_id", "day", "cutoff_at", "published_at", "win_odds")


@query("""select 'o_clerk' column_name, 'missing' violation, 0::bigint n_values union all select 'o_custkey', 'forbidden', count(o_custkey) from orders union all select 'o_totalprice', 'not_allowed', count(case when o_totalprice >= 5000 then o_totalprice end) from orders""")
def dq_column_boundary(spark, sf):
    """Q3: an allow-list that misses a column, a forbidden column, and one that is not allowed."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("o_totalprice", F.when(F.col("o_totalprice") >= 5000, F.col("o_totalprice")))
    return K.column_boundary(o, ["o_orderkey", "o_custkey", "o_orderdate", "o_clerk"], ["o_custkey"])


REVISED = """r as (select user_id, day, published_at, published_at + case when hash3 = 0 then -interval 1 minute else interval 0 minute end available_at, win_odds from (select q.*, extract(minute from published_at)::int % 5 hash3 from q)
union all select user_id, day, published_at, published_at + case when extract(minute from published_at)::int % 5 = 0 then -interval 1 minute else interval 0 minute end, win_odds + 1 from q where extract(minute from published_at)::int % 7 = 0
union all select user_id, day, null, null, win_odds from q where extract(minute from published_at)::int = 30)"""


@query(f"""with {TARGETS}, {REVISED}, x as (select distinct r.*, c.cutoff_at from r join c using (user_id, day)), n as (select *, count(*) over (partition by user_id, day, published_at, available_at) same from x),
v as (select *, case when published_at is null and win_odds is not null then 'price_without_time' when available_at < published_at then 'available_before_published' when same > 1 and published_at <= cutoff_at and (available_at is null or available_at <= cutoff_at) then 'conflicting_revisions' end violation from n)
select user_id, day, published_at, win_odds, violation from v where violation is not null""")
def quote_violations(spark, sf):
    """O2: prices without time, quotes available before they were published, and revisions that contradict each other."""
    from contestlab.plans.decisions import quote_tables

    t, q = quote_tables(spark, sf)
    q = q.select("user_id", "day", "published_at", "win_odds")
    minute = F.minute("published_at")
    at = F.col("published_at") - F.when(minute % 5 == 0, F.expr("interval 1 minute")).otherwise(F.expr("interval 0 minute"))
    known = q.withColumn("available_at", at)
    again = known.where(minute % 7 == 0).withColumn("win_odds", F.col("win_odds") + 1)
    none = q.where(minute == 30).withColumns({"published_at": F.lit(None).cast("timestamp"), "available_at": F.lit(None).cast("timestamp")})
    bad = Q.select_quotes(t, known.unionByName(again).unionByName(none), ["user_id", "day"], ["win_odds"], Q.QuotePolicy(10))[1]
    return bad.select("user_id", "day", "published_at", "win_odds", "violation")
