"""Target-distribution importance resampling: weights scored from arrays of bucket gains, then ranks from a distributed
radix sort, least significant digit first."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlab.llm.common import TERM_BYTES, drop_path, materialise, new_path, read, term_lists, tidy, translated

GRAMS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Features whose value a task remembers at most.
REMEMBERED = 1 << 20
#: Bits of a digit; rows of a block, which one task sorts at once.
DIGIT, BLOCK = 12, 1 << 18


class Remembered(dict):
    """Values by feature, worked out once as long as there is room."""

    def __init__(self, value):
        self.value = value

    def __missing__(self, feature: bytes) -> int:
        x = self.value(feature)
        if len(self) < REMEMBERED:
            self[feature] = x
        return x


def features(raw: memoryview, grams: int) -> Iterator[list[bytes]]:
    """All runs of 1 to `grams` terms of a text put through TERM_BYTES, a bounded part at a time."""
    before: list[bytes] = []
    for terms in term_lists(raw):
        yield terms
        joined = before + terms
        for k in range(2, grams + 1):
            yield [b" ".join(joined[i - k + 1 : i + 1]) for i in range(max(len(before), k - 1), len(joined))]
        before = joined[len(joined) - grams + 1 :] if grams > 1 else []


def bucket_counts(docs: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task adds up its own; what it sends is bounded by the number of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bucket = np.zeros(buckets, np.int64), Remembered(lambda f: zlib.crc32(f) % buckets)
        for b in batches:
            seen: Counter = Counter()
            for raw in translated(b[0], TERM_BYTES):
                for part in features(raw, grams):
                    seen.update(part)
                    if len(seen) > REMEMBERED:
                        np.add.at(n, [bucket[f] for f in seen], [*seen.values()])
                        seen.clear()
            if seen:
                np.add.at(n, [bucket[f] for f in seen], [*seen.values()])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(key: object, seed: int) -> int:
    """floor(1000 * a Gumbel variate) drawn from the hash of seed and key; a null key counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: Sequence[int], key: str = "doc_id", text: str = "text", grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight and score of each row of docs."""
    gain, buckets = list(gain), len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = Remembered(lambda f: gain[zlib.crc32(f) % buckets])
        for b in batches:
            words, n, weight = [], [], []
            for raw in translated(b[1], TERM_BYTES):
                total = count = one = 0
                for k, part in enumerate(features(raw, grams)):
                    total, count, one = total + sum(map(worth.__getitem__, part)), count + len(part), one + len(part) * (k % grams == 0)
                words.append(one)
                n.append(count)
                weight.append(total // count if count else 0)
            out = [w + noise(k, seed) for k, w in zip(b[0].to_pylist(), weight, strict=True)]
            yield pa.RecordBatch.from_arrays([b[0], *[pa.array(x, pa.int64()) for x in (words, n, weight, out)]], names=["doc", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(score), f"doc {kind}, n_words long, n_features long, weight long, score long")


def _move(digit: str, bits: int, size: int, order: Sequence[str]):
    """One block's part of a pass: a stable counting sort by the digit; the block's rows with equal digits go to successive
    places from their start on."""

    def move(rows: pa.Table, starts: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        d = rows[digit].to_numpy().astype(np.uint16)
        by = np.argsort(d, kind="stable")  # of 16-bit numbers: by counting
        n = np.bincount(d, minlength=1 << bits)
        start = np.zeros(1 << bits, np.int64)
        start[starts["of"].to_numpy()] = starts["start"].to_numpy()
        place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(d))
        kept = rows.drop_columns(["block", "place", digit]).take(pa.array(by))
        return kept.append_column("block", pa.array(place // size)).append_column("place", pa.array(place))

    return move


def radix_sorted(rows: DataFrame, parts: Sequence[tuple[str, int]], digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """rows with place: 0, 1, 2 ... in the order of a composite key. parts lists its columns, the most significant first: longs
    of 0 or more with the number of bits that they have at most.

    Each pass counts digits by block (a range of places), turns the counts into each block's start for each digit by prefix sums
    over digits and over blocks, and moves each row to its place; then places are dealt into blocks of equal size anew, so
    that no key, however frequent, makes a block large. A pass is written before the next one reads it. Rows with equal keys stay in
    the order of the first deal, which is by a hash of the whole row: give rows that repeat a column that tells them apart."""
    spark, path, own = rows.sparkSession, None, rows.columns
    n = rows.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block))
    size = max(1, -(-n // blocks))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64(*own), F.lit(blocks)), "place": F.xxhash64(*own)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in own) + ", block long, place long"
    order = ["place"]
    for column, width in reversed(parts):
        for k in range(passes := -(-width // digit)):
            bits = -(-width // passes)
            held = rows.withColumn("digit", F.shiftright(column, k * bits).bitwiseAND(F.lit((1 << bits) - 1)))
            counts = held.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
            totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).orderBy("digit").collect()  # at most 2^bits rows
            ends = np.cumsum([0, *[r["n"] for r in totals]]).tolist()
            base = spark.createDataFrame([(r["digit"], e) for r, e in zip(totals, ends, strict=False)], "digit long, base long")
            before = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
            starts = counts.join(F.broadcast(base), "digit").select(F.col("block").alias("from"), F.col("digit").alias("of"), (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"))
            moved = held.groupBy("block").cogroup(starts.groupBy("from")).applyInArrow(_move("digit", bits, size, order), schema)
            last, path = path, new_path(spark, "radix")
            moved.write.option("compression", "zstd").parquet(path)
            if last:
                drop_path(spark, last)
            rows, order = spark.read.schema(moved.schema).parquet(path), ["place"]
    return rows.drop("block")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_features, weight, score and rank of each row of docs; rank is null for rows that are not drawn.

    A bucket's gain compares its share of the target's features with its share of docs'; a row's weight is the floored mean of
    its features' gains, its score adds Gumbel noise seeded by the key, and the highest scores among rows with enough words
    are drawn: sampling without replacement in proportion to exp(weight / 1000).

    Null or wordless text: no features, weight 0, never drawn (unless least_words is 0). Ties go to the smaller key, nulls last;
    rows with equal key and score to fewer features, and such rows that agree there too are told apart by nothing and share
    their ranks in any order. Repeated rows are rows of their own. An empty target makes all features of docs unwanted alike; an
    empty docs gives an empty result. Other columns of docs are not looked at."""
    gain = gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, text, grams, buckets))
    rows = materialise(scored(docs, gain, key, text, grams, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = rows.where(F.col("n_words") >= least_words).drop("n_words")
    rest = rows.where(F.col("n_words") < least_words).select("doc", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    named = lambda df: df.select(F.col("doc").alias(key), "n_features", "weight", "score", "rank")
    x = fit.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("n_features").alias("most"), F.sum(F.isnull("doc").cast("long")).alias("nulls")).first()
    if not x["n"]:
        return named(rest)
    first, last = (x["first"], x["last"]) if x["first"] is not None else (0, 0)
    if last - first < 1 << 63:
        ids = {"k_doc": F.coalesce(F.col("doc").cast("long") - F.lit(first), F.lit(0))}, [("k_doc", (last - first).bit_length())]
    else:  # too far apart for a difference in 64 bits: the upper and the lower half, the sign turned
        ids = {"k_up": F.shiftright("doc", 32) + F.lit(1 << 31), "k_down": F.col("doc").bitwiseAND(F.lit((1 << 32) - 1))}, [("k_up", 32), ("k_down", 32)]
        ids = {c: F.coalesce(v, F.lit(0)) for c, v in ids[0].items()}, ids[1]
    parts = [("k_score", (x["high"] - x["low"]).bit_length()), ("k_null", 1 if x["nulls"] else 0), *ids[1]]
    held = fit.withColumns({"k_score": F.lit(x["high"]) - F.col("score"), "k_null": F.isnull("doc").cast("long"), **ids[0]})
    if not fit.groupBy("doc").count().where("count > 1").isEmpty():
        parts.append(("n_features", x["most"].bit_length()))
    if not any(width for _, width in parts):
        parts[0] = ("k_score", 1)
    order = radix_sorted(held, [p for p in parts if p[1]])
    rank = F.when(F.col("place") < F.lit(percent * x["n"] // 100), F.col("place") + 1)
    return named(order.select("doc", "n_features", "weight", "score", rank.alias("rank")).unionByName(rest))


def op11(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: crc32 by its rule: a table of 256 entries from the reversed polynomial, then one step for each byte.
SQL = r"""with recursive t(i, k, c) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8),
tab as materialized (select list(c order by i) tab from t where k = 8),
d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as materialized (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
o as materialized (select row_number() over () r, doc_id, w from d), dw as materialized (select r, unnest(w) x from o), bw as materialized (select unnest(w) x from b),
v as materialized (select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::bigint)), lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1])), 4294967295) % 10000 k from (select distinct x from (select x from dw union all select x from bw)), tab),
s as (select k, count(*) s from dw join v using (x) group by k), u as (select k, count(*) u from bw join v using (x) group by k), n as (select (select count(*) from dw) s_all, (select count(*) from bw) u_all),
g as materialized (select k, floor(1000 * ln((coalesce(u, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (u_all + 10000))))::bigint g from s left join u using (k), n),
f as (select r, count(*) n_features, floor(sum(g)::double / count(*))::bigint weight from dw join v using (x) join g using (k) group by r),
z as materialized (select r, doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score from o left join f using (r)),
q as (select r, row_number() over (order by score desc, doc_id nulls last, n_features) q, count(*) over () c from z where n_features >= 20)
select doc_id, n_features, weight, score, case when q <= 10 * c // 100 then q end rank from z left join q using (r)"""

QUERIES = {"op11_importance_resampling": op11}
ORACLES = {"op11_importance_resampling": SQL}
