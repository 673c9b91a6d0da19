"""WARC archives: written with revisit records for equal payloads, and read back by boundary-chain verification: tasks
emit candidate records with their successors' offsets, and pointer jumping keeps those reachable from a file's start."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.llm.common import by_listing, free_name, materialise, new_path, read

MAGIC, END = b"WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are always stored. Parts that a much repeated digest is dealt into. Records in a file.
SMALLEST_REVISIT, SALTS, RECORDS = 100, 32, 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """pages with digest (SHA-256 of the payload's UTF-8), payload_bytes, and first: the smallest key with an equal payload
    of at least `smallest` bytes, null for that row itself and for payloads without equals. Digests are counted with
    partial sums; only pages whose digest may repeat are shuffled, each digest's over SALTS parts."""
    body = F.coalesce(F.col(payload), F.lit(""))
    row = free_name(pages, "__row")
    based = pages.withColumns({"digest": F.sha2(body, 256), "payload_bytes": F.octet_length(body).cast("long")})
    firsts = based.where(F.col("payload_bytes") >= smallest).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select("digest", "first"), "warc-firsts")
    hits, rest = by_listing(based.withColumn(row, F.xxhash64("digest")), firsts.select(F.xxhash64("digest").alias(row)), row)
    out = rest.withColumn("first", F.lit(None).cast(based.schema[key].dataType))
    if hits is not None:
        parts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        out = out.unionByName(hits.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(parts, ["digest", "salt"], "left").drop("salt"))
    return out.drop(row).withColumn("first", F.when(~F.col("first").eqNullSafe(F.col(key)), F.col("first")))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", compression: str = "none") -> None:
    """One record per row of pages as WARC files of at most RECORDS records under path: plain, so that a file is read in
    splits, or with compression "gzip". Rows that repeat a key: each has its record, of equal name. Null url: no target
    header; null payload: empty; null key: an empty name. Line breaks in urls are percent-encoded. Empty table: no records."""
    r = with_revisits(pages.select(key, url, payload), key, payload)
    body = F.coalesce(F.col(payload), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    revisit = F.col("first").isNotNull()
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC.decode()), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(key), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit("\r\n")), F.lit("")), F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("first"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), block_bytes, F.lit(END), http, F.when(revisit, "").otherwise(body),
    )
    r.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)


FIELDS = "record_type string, page string, url string, digest string, refers_to string, payload_bytes long, payload_sha256 string"
#: A file (by the hash of its path, as each candidate is sent about many times) and a place where the magic stands (at, in
#: bytes from its split's start), where the record that would follow begins (-1: this
#: is no record), and where the next magic or the file's end is. Rows without `at` tell the bytes of a split.
CANDIDATE = f"file long, split long, at long, next long, end long, {FIELDS}, body binary"
NOTHING = (None,) * 7


def header_of(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields of the record header at the piece's start (after the magic), where it ends, and the block's length; None if
    there is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    length = fields.get("content-length", "")
    return (fields, end + 4, int(length)) if length.isascii() and length.isdigit() and len(length) < 16 else None


def fields_of(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    n = int(stated[0]) if stated and stated[0].isdigit() else len(payload)
    name = lambda k: fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None
    revisit = fields.get("warc-type") == "revisit"
    return fields.get("warc-type"), name("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), name("warc-refers-to"), n, None if revisit else hashlib.sha256(payload).hexdigest()


def candidate(piece: bytes) -> tuple[int, tuple]:
    """Length of the record that the piece (what follows a magic up to the next one) begins, without the magic, or -1; and
    its fields, if the whole record lies in the piece. One that goes on behind the next magic is taken on trust here."""
    head = header_of(piece)
    if head is None:
        return -1, NOTHING
    fields, start, length = head
    after = start + length
    if after + 4 > len(piece):
        return after + 4, NOTHING
    if piece[after : after + 4] != b"\r\n\r\n":
        return -1, NOTHING
    return after + 4, fields_of(fields, piece[start:after])


def scan(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """The candidates of all files under path (bodies: the bytes themselves instead of their fields). Files are cut at the
    magic as they stream by, in splits where they are plain; a task holds no file and sees no record before its split."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, pos = None, 0
        names = [f.split()[0] for f in CANDIDATE.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"at": "Int64", "next": "Int64", "end": "Int64", "payload_bytes": "Int64"})
        for b in batches:
            rows = []
            for file, split, piece in zip(b["file"].tolist(), b["split"].tolist(), b["piece"], strict=True):
                if (file, split) != where:
                    if where:
                        rows.append((*where, None, None, pos, *NOTHING, None))
                    where, pos, before = (file, split), 0, split == 0
                if not before:  # a file's first piece stands before its first magic
                    size, fields = (0, NOTHING) if bodies else candidate(piece)
                    at = pos - len(MAGIC)
                    rows.append((file, split, at, pos + size if size >= 0 else None, pos + len(piece), *fields, piece if bodies else None))
                before = False
                pos += len(piece) + len(MAGIC)
            yield frame(rows)
        if where:
            yield frame([(*where, None, None, pos, *NOTHING, None)])

    pieces = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("value").cast("binary").alias("piece"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return pieces.mapInPandas(find, CANDIDATE)


def placed(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The candidates with places counted from their file's start; sizes: the rows without `at` (file, split, end)."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.where("at is null").select("file", "split", F.coalesce(F.sum("end").over(before), F.lit(0)).alias("base"))
    out = found.where("at is not null").join(base, ["file", "split"])
    return out.withColumns({"at": F.col("at") + F.col("base"), "next": F.coalesce(F.col("next") + F.col("base"), F.lit(-1)), "end": F.col("end") + F.col("base")}).drop("base", "split")


def reachable(candidates: DataFrame) -> DataFrame:
    """file, at of the candidates that a chain of successors from offset 0 of their file reaches. In each round every
    pointer jumps over twice as many records and the reached set doubles, so rounds grow with the logarithm of the
    records in the largest file. Each round is a pair of joins by (file, offset), written to the shared folder."""
    links = candidates.select("file", "at", "next", (F.col("at") == 0).alias("reached"))
    most = candidates.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = links
    for _ in range(max(0, int(most - 1).bit_length()) if most else 0):
        marks = state.where("reached and next >= 0").select("file", F.col("next").alias("at"), F.lit(True).alias("marked")).distinct()
        jump = state.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        state = state.join(marks, ["file", "at"], "left").join(jump, ["file", "next"], "left")
        state = materialise(state.select("file", "at", F.coalesce("beyond", F.lit(-1)).alias("next"), (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")), "warc-jump")
    return state.where("reached").select("file", "at")


def put_together(spark: SparkSession, path: str, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The reached records of found (with the flag `reached`) that go on behind a magic inside of them: their pieces, one
    after another, are read once more. A record is held by one task, like any row."""
    so_far = Window.partitionBy("file").orderBy("at")
    light = found.where(~(F.col("reached") & F.col("record_type").isNotNull())).select("file", "at", "next", "reached")
    owner = lambda c: F.last(F.when(F.col("reached"), F.col(c)), ignorenulls=True).over(so_far)
    needed = light.select("file", "at", owner("at").alias("first"), owner("next").alias("last")).where("at < last").select("file", "at", "first", "last")
    parts = placed(scan(spark, path, True), sizes).select("file", "at", "body").join(needed, ["file", "at"])
    whole = parts.groupBy("file", F.col("first").alias("at"), F.col("last").alias("next")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]).alias("bodies"))

    @F.pandas_udf(FIELDS)
    def fields(bodies: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for b, n in zip(bodies, size, strict=True):
            record = MAGIC.join(b)[:n]
            rows.append(candidate(record)[1] if len(record) == n else NOTHING)
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")]).astype({"payload_bytes": "Int64"})

    names = [f.split()[0] for f in FIELDS.split(", ")]
    out = whole.withColumn("f", fields("bodies", F.col("next") - F.col("at") - len(MAGIC))).select("file", "at", "next", *[F.col("f")[n].alias(n) for n in names])
    return out.where("record_type is not null")


def broken(found: DataFrame) -> DataFrame:
    """file, at of the reached candidates (rows with the flag `reached`) after which a chain ends before its file does: what
    follows them was not read."""
    ends = found.groupBy("file").agg(F.max("end").alias("file_end"))
    starts = found.select("file", F.col("at").alias("next"), F.lit(True).alias("goes_on"))
    last = found.where("reached").join(starts, ["file", "next"], "left").join(ends, "file")
    return last.where(F.col("goes_on").isNull() & (F.col("next") != F.col("file_end"))).select("file", "at")


def chained(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All candidates under path with the flag `reached`, and the sizes of splits."""
    found = materialise(scan(spark, path), "warc-scan")
    here = placed(found, found)
    reached = reachable(here).select("file", "at", F.lit(True).alias("reached"))
    return materialise(here.join(reached, ["file", "at"], "left").fillna(False, ["reached"]), "warc-chained"), found


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of the archives under path, with file, at, next and FIELDS; digest is the stated one, which for
    responses must equal payload_sha256 (else digest is null). Records of equal names, and of none, are records like others;
    no files' records: empty result. What stands behind a broken link is not returned; broken() lists such places."""
    found, sizes = chained(spark, path)
    names = ["file", "at", "next", *[f.split()[0] for f in FIELDS.split(", ")]]
    whole = found.where("reached and next >= 0 and record_type is not null").select(*names)
    if found.where("reached and next > end").limit(1).count():
        whole = whole.unionByName(put_together(spark, path, found, sizes).select(*names))
    return whole.withColumn("digest", F.when(F.col("payload_sha256").isNull() | (F.col("payload_sha256") == F.col("digest")), F.col("digest")))


def op9(spark, sf_dir):
    path = new_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first_id from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end record_type,
case when payload_bytes >= 100 and first_id <> page_id then first_id end refers_to from f"""

QUERIES = {"op9_warc": op9}
ORACLES = {"op9_warc": SQL}
