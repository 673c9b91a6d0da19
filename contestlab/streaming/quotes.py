"""Structured Streaming twins of the batch quote queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contestlab.sources.tables import settled, upsert


def latest_quotes(quotes: DataFrame, keys: Sequence[str], published: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Newest row per key, for a batch or a stream; a stream keeps one row of state per key."""
    newest = quotes.groupBy(*keys).agg(F.max_by(F.struct(published, tie, *values), F.struct(published, tie)).alias("__q"))
    return newest.select(*keys, "__q.*")


def put_by_key(batch: DataFrame, keys: Sequence[str], target: str, buckets: int) -> None:
    """Replace rows of a bucketed Parquet folder by key; buckets without a row in batch are not touched."""
    spark = batch.sparkSession
    batch = settled(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]
    try:
        old = spark.read.schema(batch.schema).parquet(target).where(F.col("bucket").isin(touched))
    except AnalysisException as e:  # nothing was written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = batch.limit(0)
    new = settled(upsert(old, batch, keys).repartition("bucket"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)


def latest_quotes_stream(stream: DataFrame, keys: Sequence[str], published: str, tie: str, values: Sequence[str], target: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keeps target, a Parquet folder with a partition for each hash bucket of the keys, up to date with the newest quote
    per key. A batch rewrites the buckets that it touches and no others; as rows replace rows by key, a batch that is run
    again after a failure comes to the same."""
    fields = [*keys, published, tie, *[v for v in values if v not in (published, tie)]]

    def put(batch: DataFrame, _: int) -> None:
        put_by_key(batch.select(*fields), keys, target, buckets)

    return latest_quotes(stream, keys, published, tie, values).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prestart_quotes(quotes: DataFrame, contests: DataFrame, keys: Sequence[str], published: str, cutoff: str, tie: str, values: Sequence[str]) -> DataFrame:
    """The newest quote published by each contest's cutoff; contests without one have no row. The stream's batch twin."""
    near = quotes.join(contests, list(keys)).where(F.col(published) <= F.col(cutoff))
    newest = near.groupBy(*keys, cutoff).agg(F.max_by(F.struct(published, tie, *values), F.struct(published, tie)).alias("__q"))
    return newest.select(*keys, cutoff, "__q.*")


def prestart_stream(stream: DataFrame, contests: DataFrame, keys: Sequence[str], published: str, cutoff: str, tie: str, values: Sequence[str], late: str = "1 hour") -> DataFrame:
    """The newest quote by each contest's cutoff, once for each contest: when the watermark (the newest publication seen,
    less `late`) has passed the cutoff, the state closes and the row is final. Quotes older than the watermark are dropped.

    The state is the best quote so far, as JSON, and what orders it; tie must be an integer (null: least)."""
    order = [F.unix_micros(published).alias("__at"), F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))).alias("__tie")]
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    near = stream.withWatermark(published, late).join(contests, list(keys)).where(F.col(published) <= F.col(cutoff))
    row = F.struct(*keys, cutoff, published, tie, *values)
    kind = near.select(row.alias("r")).schema["r"].dataType
    packed = near.select(published, F.to_json(F.struct(*keys, cutoff)).alias("__key"), F.unix_millis(cutoff).alias("__end"), *order, F.to_json(row, whole).alias("__row"))

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            best = state.get
            state.remove()
            yield pd.DataFrame({"__row": [best[2]]})
            return
        best = state.get if state.exists else None
        for b in batches:
            at = b.sort_values(["__at", "__tie"]).iloc[-1]
            one = (int(at["__at"]), int(at["__tie"]), at["__row"])
            best = one if best is None or one[:2] > tuple(best[:2]) else best
        state.update(best)
        state.setTimeoutTimestamp(max(int(key[1]), state.getCurrentWatermarkMs() + 1))

    out = packed.groupBy("__key", "__end").applyInPandasWithState(newest, "__row string", "at long, tie long, row string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("__row", kind, whole).alias("r")).select("r.*")


def prestart_entries(quotes: DataFrame, entries: DataFrame, keys: Sequence[str], published: str, cutoff: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Every entry with the newest quote published by its cutoff; entries without one, or without a cutoff, have nulls. An entry
    that is declared again counts with its latest cutoff (the largest). The batch twin of prestart_entries_stream()."""
    declared = entries.groupBy(*keys).agg(F.max(cutoff).alias(cutoff))
    found = prestart_quotes(quotes, declared, keys, published, cutoff, tie, values)
    return declared.join(found.drop(cutoff), list(keys), "left")


def prestart_entries_stream(quotes: DataFrame, entries: DataFrame, keys: Sequence[str], published: str, declared: str, cutoff: str, tie: str, values: Sequence[str], late: str = "1 hour") -> DataFrame:
    """prestart_entries() for two streams: quotes, and the entries' declarations (keys, declared, cutoff). The declaration opens an
    entry's state and sets its timer, so that an entry without quotes ends with a row of nulls; quotes that come before it
    wait in the state. An entry is final once the watermark (of both streams' times, less `late`) has passed its cutoff; a null
    cutoff is final at once. Rows older than the watermark are dropped. No keys may be null."""
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    row = F.struct(published, tie, *values)
    kind = quotes.select(row.alias("r")).schema["r"].dataType
    key = F.to_json(F.struct(*keys))
    key_kind = quotes.select(F.struct(*keys).alias("k")).schema["k"].dataType
    least, none = F.lit(-(1 << 63)), F.lit(None)
    a = quotes.select(F.col(published).alias("__time"), key.alias("__key"), none.cast("boolean").alias("__open"), none.cast("long").alias("__end"), F.unix_micros(published).alias("__at"), F.coalesce(F.col(tie).cast("long"), least).alias("__tie"), F.to_json(row, whole).alias("__row"))
    b = entries.select(F.col(declared).alias("__time"), key.alias("__key"), F.lit(True).alias("__open"), F.unix_micros(cutoff).alias("__end"), none.cast("long").alias("__at"), none.cast("long").alias("__tie"), none.cast("string").alias("__row"))
    both = a.unionByName(b).withWatermark("__time", late)

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, end, waiting = state.get if state.exists else (False, None, "[]")
        quotes = json.loads(waiting)
        if state.hasTimedOut:
            state.remove()
            yield final(key, end, quotes)
            return
        for b in batches:
            for r in b.itertuples(index=False):
                if r[0] is True:
                    new = None if pd.isna(r[1]) else int(r[1])
                    end, opened = new if not opened or end is None else end if new is None else max(end, new), True
                else:
                    quotes.append([int(r[2]), int(r[3]), r[4]])
        if opened:  # only the best is kept from here on, and those that a later cutoff might let in
            early = [q for q in quotes if end is not None and q[0] <= end]
            quotes = ([max(early, key=lambda q: q[:2])] if early else []) + [q for q in quotes if end is not None and q[0] > end]
        if opened and end is None:
            state.remove()
            yield final(key, None, [])
            return
        state.update((opened, end, json.dumps(quotes)))
        if opened:
            state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    def final(key: tuple, end: int | None, quotes: list) -> pd.DataFrame:
        early = [q for q in quotes if end is not None and q[0] <= end]
        return pd.DataFrame({"__key": [key[0]], "__end": pd.array([end], "Int64"), "__row": [max(early, key=lambda q: q[:2])[2] if early else None]})

    out = both.groupBy("__key").applyInPandasWithState(newest_of(newest), "__key string, __end long, __row string", "opened boolean, end long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("__key", key_kind).alias("k"), F.timestamp_micros("__end").alias(cutoff), F.from_json("__row", kind, whole).alias("r")).select("k.*", cutoff, "r.*")


def newest_of(step: Callable) -> Callable:
    """step with batches of the columns that it reads, in order."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from step(key, (b[["__open", "__end", "__at", "__tie", "__row"]].astype(object) for b in batches), state)

    return run


def entries_to_table(out: DataFrame, keys: Sequence[str], target: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keeps target, a Parquet folder with a partition for each hash bucket of the keys, up to date with the rows of
    prestart_entries_stream(): a row replaces what is there for its keys, also one of nulls an older quote."""
    def put(batch: DataFrame, _: int) -> None:
        put_by_key(batch, keys, target, buckets)

    return run_to_table(out, put, checkpoint)


def run_to_table(out: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
