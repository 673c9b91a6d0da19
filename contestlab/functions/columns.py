"""Column functions: cleaning, ids, bins, lag statistics, rates and formulas. All return Column and stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge of the middle third of a standard normal distribution.
Z_THIRD = 0.4307273


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composite_id(parts: Sequence[Column | str], widths: Sequence[int]) -> Column:
    """A long from zero-padded text parts; null if any part is null or no number."""
    padded = [F.lpad(F.trim(col(p).cast("string")), w, "0") for p, w in zip(parts, widths, strict=True)]
    some_null = reduce(lambda a, b: a | b, [p.isNull() for p in padded])
    return F.when(~some_null, F.concat_ws("", *padded).try_cast("long"))


def clean_num(c: Column | str, sentinels: Sequence[str] = ("",), scale: float = 1.0) -> Column:
    """Text to a scaled double; sentinels and text that is no number become null."""
    t = F.trim(col(c))
    return F.when(~t.isin(*sentinels), t.try_cast("double") / F.lit(float(scale)))


def extract_number(c: Column | str) -> Column:
    """The leading number of a messy text, or null."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def clock_to_seconds(c: Column | str) -> Column:
    """Text of minutes, two-digit seconds and tenths (MSST) to seconds; 0 or no number is null."""
    n = F.trim(col(c)).try_cast("int")
    return F.when(n > 0, F.floor(n / 1000) * 60 + (n % 1000) / F.lit(10.0))


def signed_value(sign: Column | str, magnitude: Column | str) -> Column:
    """Magnitude with its sign column; a sign other than + and - gives 0 for magnitude 0, else null."""
    s, m = F.trim(col(sign)), F.trim(col(magnitude).cast("string")).try_cast("int")
    return F.when(s == "+", m).when(s == "-", -m).when(m == 0, 0)


def clamp_nonneg(c: Column | str) -> Column:
    return F.when(col(c) < 0, F.lit(0.0)).when(col(c) >= 0, col(c).cast("double"))


def pair_key(text: Column | str) -> Column:
    """Two two-digit numbers in any writing to NN-NN, the smaller first."""
    d = F.regexp_replace(col(text), r"\D", "")
    a, b = F.substring(d, 1, 2), F.substring(d, 3, 2)
    return F.when(F.length(d) == 4, F.concat_ws("-", F.least(a, b), F.greatest(a, b)))


def roll_year_timestamp(year: Column, mmddhhmm: Column | str, ref_date: Column, tz: str) -> Column:
    """UTC instant of a publication time without year: December before a January date falls in the year before, January
    after a December date in the next. Malformed text is null."""
    t = F.trim(col(mmddhhmm))
    month = F.when(t.rlike(r"^\d{8}$"), F.substring(t, 1, 2).cast("int"))
    y = year.cast("int") + F.when((month == 12) & (F.month(ref_date) == 1), -1).when((month == 1) & (F.month(ref_date) == 12), 1).otherwise(0)
    text = F.concat_ws("", F.lpad(y.cast("string"), 4, "0"), t)
    return F.when(month.isNotNull() & (t != "00000000"), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")), tz))


def local_start_at(date: Column | str, seconds: Column | str, tz: str) -> Column:
    """UTC instant of a local date and second of the day."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(col(date).cast("timestamp")) + col(seconds)), tz)


def map_codes(c: Column | str, codes: Mapping, default=None) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in codes.items():
        out = out.when(col(c) == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def bin_fixed(c: Column | str, edges: Sequence[float], right_closed: bool = False) -> Column:
    """Number of the bin between edges, from 0; null stays null."""
    out = F.when(col(c).isNull(), F.lit(None).cast("int"))
    for k, e in enumerate(edges):
        out = out.when(col(c) <= e if right_closed else col(c) < e, k)
    return out.otherwise(len(edges))


def third(z: Column | str) -> Column:
    return F.when(col(z) < -Z_THIRD, 1).when(col(z) <= Z_THIRD, 2).when(col(z) > Z_THIRD, 3)


def joint_bin3(z1: Column | str, z2: Column | str) -> Column:
    """1 to 9 by the thirds of two z-scores, 0 if one is missing."""
    return F.coalesce((third(z1) - 1) * 3 + third(z2), F.lit(0))


def monotone_flag(cols: Sequence[Column | str]) -> Column:
    """1 if values fall strictly up to the first null, 0 if not, null without two values."""
    cs = [col(c) for c in cols]
    fine, seen = F.lit(True), cs[0].isNotNull()
    for a, b in zip(cs, cs[1:], strict=False):
        seen = seen & b.isNotNull()
        fine = fine & (~seen | (b < a))
    return F.when(cs[0].isNotNull() & cs[1].isNotNull(), fine.cast("int"))


def _count(cs: Sequence[Column]) -> Column:
    return reduce(add, [c.isNotNull().cast("int") for c in cs])


def _sum(cs: Sequence[Column]) -> Column:
    return reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs])


def lag_avg(cols: Sequence[Column | str]) -> Column:
    cs = [col(c) for c in cols]
    return _sum(cs) / F.nullif(_count(cs), F.lit(0))


def lag_wavg(cols: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """Mean weighted over the values that are there."""
    cs = [col(c) for c in cols]
    w = reduce(add, [F.when(c.isNotNull(), float(x)).otherwise(0.0) for c, x in zip(cs, weights, strict=True)])
    return _sum([c * x for c, x in zip(cs, weights, strict=True)]) / F.nullif(w, F.lit(0.0))


def lag_stddev(cols: Sequence[Column | str]) -> Column:
    """Sample deviation over columns; null for fewer than two values, tiny negative variances count as 0."""
    cs = [col(c) for c in cols]
    n, s, q = _count(cs), _sum(cs), _sum([c * c for c in cs])
    v = (q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    return F.when(n > 1, F.sqrt(F.when((v < 0) & (v >= -1e-12), F.lit(0.0)).otherwise(v)))


def lag_trend(cols: Sequence[Column | str]) -> Column:
    """First minus last: what is most recent minus what is oldest."""
    return col(cols[0]) - col(cols[-1])


def lag_slope3(cols: Sequence[Column | str]) -> Column:
    return (col(cols[0]) - col(cols[2])) / 2.0


def trend_voladj(cols: Sequence[Column | str]) -> Column:
    return lag_trend(cols) / F.nullif(lag_stddev(cols), F.lit(0.0))


def short_long_gap(short: Sequence[Column | str], long: Sequence[Column | str]) -> Column:
    return lag_avg(short) - lag_avg(long)


def lag_min(cols: Sequence[Column | str]) -> Column:
    return F.least(*[col(c) for c in cols])


def change_score(current: Column | str, lags: Sequence[Column | str], least: float | None = None) -> Column:
    """How many lags differ from the current value, by at least `least` for numbers."""
    differ = lambda x: (F.abs(col(current) - x) >= least) if least is not None else (col(current) != x)
    return reduce(add, [F.coalesce(differ(col(x)).cast("int"), F.lit(0)) for x in lags])


def smooth_rate(k: Column | str, n: Column | str, prior: Column | float, strength: float) -> Column:
    """(k + prior * strength) / (n + strength), null for a null prior."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (F.coalesce(col(k), F.lit(0)) + p * strength) / F.nullif(F.coalesce(col(n), F.lit(0)) + F.lit(float(strength)), F.lit(0.0))


def logit_clip(p: Column | str, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return F.when(col(p).isNotNull(), F.ln(q / (1 - q)))


def logit_diff(p: Column | str, q: Column | str, eps: float = 1e-6) -> Column:
    return logit_clip(p, eps) - logit_clip(q, eps)


def log10p1(c: Column | str) -> Column:
    return F.log10(col(c) + 1)


def safe_ln(c: Column | str) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def blend_price(low: Column | str, high: Column | str, method: str = "mid") -> Column:
    """mid, weighted (0.7 low, 0.3 high), low or high; null unless both are there."""
    x = {"mid": (col(low) + col(high)) / 2.0, "weighted": col(low) * 0.7 + col(high) * 0.3, "low": col(low), "high": col(high)}[method]
    return F.when(col(low).isNotNull() & col(high).isNotNull(), x)


def place_label(finish: Column | str, field_size: Column | str) -> Column:
    """1 within the first two of fields below 8, else within the first three."""
    return (col(finish) <= F.when(col(field_size) < 8, 2).otherwise(3)).cast("int")


def sharpness(last4: Column | str, last1: Column | str) -> Column:
    """Mean of the three earlier sections less the last."""
    return (col(last4) - col(last1)) / 3.0 - col(last1)


def half_length(distance: Column | str, s3: Column | str, s4: Column | str) -> Column:
    """The earlier half's time: of three sections where distance is a multiple of 200, else of four; 0 is null."""
    return F.nullif(F.when(col(distance) % 200 == 0, col(s3)).otherwise(col(s4)), F.lit(0.0))


def age_in_months(born: Column | str, day: Column | str) -> Column:
    return (F.year(col(day)) - F.year(col(born))) * 12 + F.month(col(day)) - F.month(col(born))


def calendar_parts(date: Column | str) -> dict[str, Column]:
    d = col(date)
    return {"month": F.month(d), "year": F.year(d), "month_start": F.trunc(d, "month"), "year_start": F.make_date(F.year(d), F.lit(1), F.lit(1))}


def missing_flags(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNull() for c in cols}


def soft_bin_weights(x: Column | str, centers: Sequence[float], width: float) -> Column:
    """Triangular weights around centers, adding up to 1; null if x is null or out of reach."""
    w = F.transform(F.array(*[F.lit(float(c)) for c in centers]), lambda c: F.greatest(F.lit(0.0), 1 - F.abs(col(x) - c) / width))
    total = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.transform(w, lambda v: v / total))


def hard_bin(x: Column | str, edges: Sequence[float]) -> Column:
    """Bin of a predicted value clipped to 0 to 1."""
    return bin_fixed(F.least(F.greatest(col(x), F.lit(0.0)), F.lit(1.0)), edges)


def cut_bands(c: Column | str, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed band that holds c; null outside."""
    out = F.when(F.lit(False), F.lit(None))
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        above = (col(c) >= lo) if include_lowest and lo == edges[0] else (col(c) > lo)
        out = out.when(above & (col(c) <= hi) if not math.isinf(hi) else above, label)
    return out


def row_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of the row's JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def null_key(c: Column | str) -> Column:
    """Key that makes nulls equal to each other."""
    return F.coalesce(col(c).cast("string"), F.lit("__NULL__"))


def kelly_stake(p: Column | str, odds: Column | str, fraction: float = 1.0, cap: float = 0.05) -> Column:
    o = col(odds)
    return F.when(o > 1, F.least(F.greatest(F.lit(fraction) * (col(p) * o - 1) / (o - 1), F.lit(0.0)), F.lit(cap)))


def platt_apply(p: Column | str, odds: Column | str, a: float, b: float, c: float) -> Column:
    clip = lambda z: F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))
    z = clip(a * clip(logit_clip(p, 1e-15)) + b * F.ln(col(odds)) + c)
    return 1 / (1 + F.exp(-z))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate."""
    p = k / F.nullif(n, F.lit(0))
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def materialize_condition(spec: Mapping) -> tuple[Column, Column]:
    """Key of a condition and whether the row fits it. kind: identity (column), ranges (column, ranges of (label, low,
    high)) or cross (parts): parts are joined with their lengths, so that no two combinations look alike."""
    kind = spec["kind"]
    if kind == "identity":
        return col(spec["column"]).cast("string"), col(spec["column"]).isNotNull()
    if kind == "ranges":
        out = F.when(F.lit(False), F.lit(None))
        for label, low, high in spec["ranges"]:
            out = out.when((col(spec["column"]) >= low) & (col(spec["column"]) < high), label)
        return out, out.isNotNull()
    keys, fits = zip(*[materialize_condition(s) for s in spec["parts"]], strict=True)
    fit = reduce(lambda a, b: a & b, fits)
    return F.when(fit, F.concat_ws("|", *[F.concat(F.length(k).cast("string"), F.lit(":"), k) for k in keys])), fit
