"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: bytes.translate table that keeps the bytes of search terms (digits, letters, all of other characters), A-Z as a-z, and makes
#: all else a space.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c) in LOWER + "0123456789" else c + 32 if chr(c) in UPPER else 0x20 for c in range(256))
#: Bytes of a text whose words are held as objects at once.
STEP = 1 << 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local runs."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="contestlab-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/contestlab-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the cluster keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has written in between. Results that were not written or collected are lost."""
    drop_path(spark, own_dir(spark))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand what earlier tasks of this Python worker freed back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A function for mapInPandas or mapInArrow that leaves no memory behind in the worker."""

    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from task(batches)
        give_back()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the filter of listed rows: so many for each of them, and at most so many in all (16 MB, whatever the data's size).
BITS_EACH, MOST_BITS = 16, 1 << 27


def bitmap_of(listed: DataFrame, row: str, count: int) -> np.ndarray:
    """Bloom filter with two places for each 64-bit row hash (of its bits from 0 and from 27 on), as 64-bit words."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (count * BITS_EACH).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned(row, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 27)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    found = listed.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, rows: np.ndarray) -> np.ndarray:
    yes, rows = np.ones(len(rows), bool), rows.view(np.uint64)
    for k in (0, 27):
        p = (rows >> np.uint64(k)) & np.uint64(len(bitmap) * 64 - 1)
        yes &= (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return yes


class Listing:
    """Tells rows whose 64-bit hash may be in a table's column from those that surely are not, by a filter of bounded size, so
    that these can go on where they are read and only the others be shuffled. Equal hashes are always told alike."""

    def __init__(self, listed: DataFrame, row: str):
        count = listed.count()
        self.bits = listed.sparkSession.sparkContext.broadcast(bitmap_of(listed, row, count)) if count else None

    def split(self, df: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
        """Rows that may be listed, and rows that are not."""
        bits = self.bits
        if bits is None:
            return df.where(F.lit(False)), df

        @F.pandas_udf("boolean")
        def perhaps(rows: pd.Series) -> pd.Series:
            return pd.Series(in_bitmap(bits.value, rows.to_numpy(np.int64)))

        return df.where(perhaps(row)), df.where(~perhaps(row))


def by_listing(own: DataFrame, listed: DataFrame, row: str) -> tuple[DataFrame | None, DataFrame]:
    """own in two parts: rows whose hash `row` may be in listed (None if nothing is listed), and the others."""
    listing = Listing(listed, row)
    return (None, own) if listing.bits is None else listing.split(own, row)


#: Parts that the rows of one key are dealt into by a salted join.
SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """The inner join of many rows a key with one row a key (a small table), a key's rows dealt over SALTS parts by spread."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return many.withColumn("__salt", salt).join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"]).drop("__salt")


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) if raw else np.zeros(0, kind)


def translated(texts: pa.Array, table: bytes) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text (null: none), put through a bytes.translate table that leaves bytes from 128 on alone."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]] if len(texts) else memoryview(b"")
    raw, ends = memoryview(raw.tobytes().translate(table)), (ends - ends[0]).tolist() if len(texts) else []
    for a, b in zip(ends, ends[1:], strict=False):
        yield raw[a:b]


def term_lists(raw: memoryview, step: int = STEP) -> Iterator[list[bytes]]:
    """The terms of a text put through TERM_BYTES, in order, a bounded part at a time."""
    if len(raw) <= step:
        yield raw.tobytes().split()
        return
    raw, a = raw.tobytes(), 0
    while a < len(raw):
        b = raw.find(b" ", a + step)
        b = len(raw) if b < 0 else b
        yield raw[a:b].split()
        a = b


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def input_partitions(df: DataFrame) -> int:
    """Partitions in which Spark reads df: they grow with the data."""
    return max(1, df.rdd.getNumPartitions())
