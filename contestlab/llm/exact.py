"""Exact dedup: sorted, Golomb-coded fingerprints go to their owners, bitmaps of the repeated ones come back, and only the
texts of suspects are shuffled, to be compared byte by byte."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import LOWER, LOWER_BYTES, UPPER, Listing, in_bitmap, materialise, read, salted_join, tidy, translated

#: Rows of one input partition whose fingerprints are sent together.
CHUNK_BITS = 18
#: Fingerprints that one owner receives, about.
OWNED = 1 << 18
#: Bits of a fingerprint beyond those that number the rows: one text in 2^14 is a suspect though it has no copy.
SPARE_BITS = 14


def golomb(values: np.ndarray, below: int) -> tuple[int, bytes]:
    """Sorted distinct integers from 0 to `below` as Golomb codes of their gaps, with a power of two as parameter (its exponent
    comes first): all quotients in unary, then all remainders, so that both are coded and read by whole arrays."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    b = max(0, int(math.log2(max(1.0, math.log(2) * below / len(values)))))
    ends = np.cumsum(gaps >> np.uint64(b)).astype(np.int64) + np.arange(len(values))
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = np.empty((len(values), b), np.uint8)
    for k in range(b):
        rest[:, k] = (gaps >> np.uint64(b - 1 - k)) & np.uint64(1)
    return b, np.packbits(unary).tobytes() + np.packbits(rest.reshape(-1)).tobytes()


def ungolomb(n: int, b: int, code: bytes) -> np.ndarray:
    """The n integers that golomb() has coded."""
    cut = len(code) - -(-n * b // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, cut)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=cut))[: n * b].reshape(n, b)
    for k in range(b):
        gaps = gaps << np.uint64(1) | rest[:, k]
    return np.cumsum(gaps)


def sha256(raw: memoryview) -> bytes:
    return hashlib.sha256(raw).digest()


def prints(digests: list[bytes]) -> np.ndarray:
    """Fingerprints: the first 64 bits of digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.int64 if not digests else np.uint64).view(np.int64)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _keyed(docs: DataFrame, key: str, text: str, digest) -> DataFrame:
    """doc, digest and fp of each row, with row (its number) and chunk, written once: from here on both are fixed."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(t) for t in translated(b["t"], LOWER_BYTES)]
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(found, pa.binary()), pa.array(prints(found))], names=["doc", "digest", "fp"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).mapInArrow(tidy(hashed), f"doc {_kind(docs, key)}, digest binary, fp long")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return materialise(rows.withColumn("chunk", F.shiftright("row", CHUNK_BITS)), "keyed")


def _suspects(rows: DataFrame, count: int) -> DataFrame:
    """rows with suspect: whether another row may have the same fingerprint, as told by the exchange."""
    bits = min(62, count.bit_length() + SPARE_BITS)
    own = min(bits, max(3, math.ceil(math.log2(max(1, count / OWNED)))))  # 2^own owners, each of a range of fingerprints
    below = 1 << (bits - own)

    def distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints, each row's place among them, their counts, and where each owner's begin."""
        f = t["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        u, at, n = np.unique(f, return_inverse=True, return_counts=True)
        return u, at, n, np.searchsorted(u, np.arange((1 << own) + 1, dtype=np.uint64) << np.uint64(bits - own))

    def send(t: pa.Table) -> pa.Table:
        u, _, _, ends = distinct(t)
        out = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
        codes = [golomb(u[a:b] - np.uint64(k * below), below) for k, a, b in out]
        return pa.table({"owner": pa.array([k for k, _, _ in out], pa.int32()), "chunk": pa.array([t["chunk"][0].as_py()] * len(out), pa.int64()), "n": pa.array([int(b - a) for _, a, b in out], pa.int32()), "rice": pa.array([b for b, _ in codes], pa.int32()), "code": pa.array([c for _, c in codes], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        lists = [ungolomb(n, b, c) for n, b, c in zip(t["n"].to_pylist(), t["rice"].to_pylist(), t["code"].to_pylist(), strict=True)]
        _, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice, ends = n[at] > 1, np.cumsum([0, *map(len, lists)])
        maps = [np.packbits(twice[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"chunk": t["chunk"], "owner": t["owner"], "bitmap": pa.array(maps, pa.binary())})

    def receive(t: pa.Table, replies: pa.Table) -> pa.Table:
        u, at, n, ends = distinct(t)
        bad = n > 1
        for k, m in zip(replies["owner"].to_pylist(), replies["bitmap"].to_pylist(), strict=True):
            a, b = ends[k], ends[k + 1]
            bad[a:b] |= np.unpackbits(np.frombuffer(m, np.uint8))[: b - a].astype(bool)
        return t.append_column("suspect", pa.array(bad[at]))

    sent = rows.select("chunk", "fp").groupBy("chunk").applyInArrow(send, "owner int, chunk long, n int, rice int, code binary")
    replies = sent.groupBy("owner").applyInArrow(answer, "chunk long, owner int, bitmap binary")
    schema = ", ".join(f"{c} {_kind(rows, c)}" for c in rows.columns) + ", suspect boolean"
    return materialise(rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(receive, schema), "suspects")


def _texts(docs: DataFrame, key: str, text: str, digest, listing: Listing) -> DataFrame:
    """doc, digest and normalised bytes of the rows whose fingerprint is listed (and of a few more)."""
    bits = listing.bits

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(translated(b["t"], LOWER_BYTES))
            found = [digest(t) for t in texts]
            at = np.flatnonzero(in_bitmap(bits.value, prints(found))) if found else []
            yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], pa.binary()), pa.array([texts[i] for i in at], pa.binary())], names=["doc", "digest", "bytes"])

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).mapInArrow(tidy(pick), f"doc {_kind(docs, key)}, digest binary, bytes binary")


def _settled(rows: DataFrame, same: str) -> DataFrame:
    """Groups of rows with the same value in a column: the row with the largest doc stays (nulls are smallest), of equal ones the
    last. Groups are aggregated before they are shuffled and their rows dealt out, so that a large group is no large task."""
    groups = rows.groupBy(same).agg(F.max(F.struct("doc", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    out = salted_join(rows, groups, same, "row")
    return out.select("doc", F.col("top.doc").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "digest")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """For each row of docs: key, keep_id (the key of the row that stays of those whose texts are equal but for the case of A-Z),
    group_size, kept and text_sha256.

    Input partitions send the sorted fingerprints of their rows, Golomb-coded, to owners of ranges of fingerprints; these answer
    with one bit for each. Texts of suspects alone are shuffled and grouped by their bytes, so that no digest is trusted: texts
    that differ though their digests agree are told apart. What is read twice is only the texts.

    Null text: empty, so that null and empty texts are copies of each other. Ties: of rows with equal text and key one stays.
    A null key is smaller than any other. Texts may be of any length, groups of any size. Empty table: empty result. Other
    columns of docs are not looked at, whatever their names."""
    rows = _keyed(docs, key, text, digest)
    told = _suspects(rows, max(1, rows.count()))
    named = lambda df: df.select(F.col("doc").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    single = named(told.where(~F.col("suspect")).select("doc", F.col("doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"))
    listing = Listing(told.where("suspect").select("fp").distinct(), "fp")
    if listing.bits is None:
        return single
    twins = _unlike(_texts(docs, key, text, digest, listing))
    suspects = told.where("suspect")
    if twins.isEmpty():
        return single.unionByName(named(_settled(suspects, "digest")))
    apart = materialise(_texts(docs, key, text, digest, listing).join(twins, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "twins")
    # a row of twins that is no suspect is on its own; it is told apart with them, as one of a group of one
    single = named(told.where(~F.col("suspect")).join(twins, "digest", "left_anti").select("doc", F.col("doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"))
    alike = _settled(suspects.join(twins, "digest", "left_anti"), "digest")
    return single.unionByName(named(alike)).unionByName(named(_settled(apart, "bytes")))


def _unlike(texts: DataFrame) -> DataFrame:
    """Digests that more than one text has, compared byte by byte. Copies meet where they are read, before the shuffle."""
    verified = texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return materialise(verified.groupBy("digest").count().where("count > 1").select("digest"), "unlike")


def keep_largest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of exact_groups(). Rows whose fingerprint no other
    row has go on where they are read; of the others, one row of each text and partition is shuffled."""
    rows = _keyed(docs, key, text, sha256)
    told = _suspects(rows, max(1, rows.count()))
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    fp = F.conv(F.substring(F.sha2(lowered.cast("binary"), 256), 1, 16), 16, -10).cast("long")
    held = docs.select(F.struct("*").alias("__own"), F.col(key).alias("__key"), lowered.alias("__text"), fp.alias("__fp"))
    copies, rest = Listing(told.where("suspect").select("fp").distinct(), "fp").split(held, "__fp")
    best = copies.groupBy("__text").agg(F.max_by("__own", F.struct("__key")).alias("__own"))
    return rest.select("__own.*").unionByName(best.select("__own.*"))


def op12(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = f"""with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents), g as (select t, max(doc_id) keep_id, count(*) group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(n.t) text_sha256 from n join g on n.t = g.t"""

QUERIES = {"op12_exact_dedup": op12}
ORACLES = {"op12_exact_dedup": SQL}
