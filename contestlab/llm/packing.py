"""Sum-of-squares packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import materialise, read, tidy

LENGTH = 2048
#: Pieces that one task packs; each shard may leave a few sequences unfilled, so it should be large.
SHARD = 60_000
#: Sequences filled less than this are packed once more, across shards.
REPACK_BELOW = 0.98
#: Chunks whose ids a Python worker keeps at most; when there are more, it goes on with those that it met first, among which
#: the frequent ones are.
CACHED, KEPT = 300_000, 100_000
#: New chunks that are encoded as one text.
JOINED = 32
#: Documents whose new chunks are encoded in one call.
GROUP = 256
#: Texts in these characters are lower-cased as the tokenizer does it; a full stop or comma after a letter and before white
#: space is a chunk of its own to the tokenizer too. All white space among them is white space to str.split().
PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ]*")
SIX = re.compile("[\\x20\\x09-\\x0D]+")
POINT = re.compile("(?<=[a-zß-öø-ɏ])[.,](?=[ \n]|$)")

PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


class Codes(dict):
    """Numbers chunks in the order in which they are first asked for; `new` lists those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        self.new.append(chunk)
        return k


class ChunkTokenizer:
    """Ids of a text as the concatenated ids of its chunks between white space, which the tokenizer drops and never
    reads across. Ids of chunks already seen come from a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        #: Control strings: the tokenizer looks for them in the text as it stands, and each gives one id.
        self.control = {t.content: i for i, t in added.items()}
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.control, key=len, reverse=True)) or "(?!)")
        self.model.encode_special_tokens = not self.whole  # what is between them is ordinary text
        #: Stands before each of several chunks that are encoded as one text.
        self.mark = next((t.content for t in added.values() if t.special), None)
        self.marked = Tokenizer.from_file(path)
        self.marked.encode_special_tokens = False
        self.clear()

    def clear(self) -> None:
        self.codes, self.used = Codes(), 0
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)

    def shrink(self) -> None:
        kept = Codes()
        kept.update(zip(itertools.islice(self.codes, KEPT), range(KEPT)))
        self.codes, self.used = kept, int(self.start[KEPT])

    def learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        first = len(self.codes) - len(new)
        size, flat = self.encoded(new)
        if len(self.codes) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.codes)), np.resize(self.size, 2 * len(self.codes))
        if self.used + len(flat) > len(self.flat) or (len(flat) and flat.max() > np.iinfo(self.flat.dtype).max):
            kind = np.uint32 if len(flat) and flat.max() > 65_535 else self.flat.dtype
            self.flat = np.resize(self.flat.astype(kind), 2 * (self.used + len(flat)))
        self.size[first : len(self.codes)] = size
        self.start[first : len(self.codes)] = self.used + size.cumsum() - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids. Chunks go JOINED at a time, with a control string before each."""
        if self.mark and not any(c[:1] == " " for c in chunks):
            texts = [self.mark + self.mark.join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.marked.encode_batch_fast(texts, add_special_tokens=False)])
            own = ids != self.control[self.mark]
            starts = np.flatnonzero(~own)
            if len(starts) == len(chunks):  # else the mark's id is in a chunk
                return (np.diff(starts, append=len(ids)) - 1).astype(np.int32), ids[own]
        lists = [e.ids for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
        lists = [[self.control[c[1:]]] if c[:1] == " " else x for c, x in zip(chunks, lists, strict=True)]
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        return size, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))

    def chunks(self, text: str) -> list[str]:
        """Pieces of the text whose ids, one after another, are the text's; a control string has a space before it."""
        marks = self.cut.findall(text)
        if marks:
            parts = self.cut.split(text)
            return [c for part, mark in zip(parts, [*marks, ""], strict=True) for c in (*self.chunks(part), *([" " + mark] if mark else ()))]
        # elsewhere only the six characters that are white space beyond doubt part chunks
        return POINT.sub(r" \g<0>", text.lower()).split() if PLAIN.fullmatch(text) else SIX.split(text)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; chunks not seen before are encoded in one call for all texts."""
        if self.whole:
            yield from (np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False))
            return
        if len(self.codes) > CACHED:
            self.shrink()
        coded = []
        for text in texts:
            chunks = self.chunks(text)
            coded.append(np.fromiter(map(self.codes.__getitem__, chunks), np.int32, len(chunks)))
        if self.codes.new:
            self.learn()
        for codes in coded:
            size = self.size[codes]
            ends = size.cumsum()
            yield self.flat[np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@functools.lru_cache(1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, so that its cache lasts from task to task."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", end: int = 0, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Cut each document's ids, then id `end`, into pieces of at most `length`; only longer documents are cut.
    One row per piece: the columns of docs without text, then piece, start, length, ids_crc32, and, if asked for, ids
    (little-endian unsigned 32-bit). Null text: as empty, one piece of one id. Repeated rows: each has its own pieces.
    Columns of docs that bear one of these names are left out."""
    own = [f.split()[0] for f in PIECES.split(", ")]
    rest = docs.select(*[c for c in docs.columns if c != text and c not in own], F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "__text"] + [PIECES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for first in range(0, len(b), GROUP):
                texts = [t or "" for t in b["__text"].slice(first, GROUP).to_pylist()]
                for at, ids in enumerate(encode.ids(texts), first):
                    ids = np.append(ids, ids.dtype.type(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), length)):
                        raw = ids[s : s + length].tobytes()
                        rows.append((at, k, s, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            at, *made = zip(*rows, strict=True) if rows else [()] * 6
            kept = [c for c in b.schema.names if c != "__text"]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[b[c].take(pa.array(at, pa.int32())) for c in kept], *map(pa.array, made, kinds)], names=kept + own)

    out = rest.mapInArrow(tidy(cut), schema)
    return out if with_ids else out.drop("ids")


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed one by one (longest first) where the sum over gaps of the squared number of
    open bins with that gap becomes smallest; a tie goes to the smallest gap, and a new bin is opened only where no open one has
    room, so that as few as can be are used."""
    lengths = np.asarray(lengths, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max // 4
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        if s == 0 or s == capacity:
            fresh, gap = True, capacity
        else:
            # of the sum of squares: one bin fewer with the old gap and one more with the new; n[0] stays 0
            change = np.where(n[s:capacity] > 0, 2 * (n[: capacity - s] - n[s:capacity] + 1), far)
            if n[s]:
                change[0] = 1 - 2 * n[s]  # the bin is full then and counts no more
            gap = s + int(change.argmin())
            fresh = change[gap - s] >= far
        if fresh:
            gap, b = capacity, made
            made += 1
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if 0 < (left := gap - s) < capacity:
            open_bins[left].append(b)
            n[left] += 1
    return bins, offsets


def _packed(items: DataFrame, size: str, count: int, capacity: int, level: int) -> DataFrame:
    """items with bin (a number of its own in this level) and place (offset in it), packed in shards of about SHARD rows."""
    shards = max(1, -(-count // SHARD))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema] + ["bin long", "place long"])

    def shard(b: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(b[size].to_numpy(), capacity)
        return b.drop(columns="__shard").assign(bin=(level << 60) + (int(b["__shard"].iloc[0]) << 32) + bins, place=offsets)

    return items.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("__shard").applyInPandas(shard, schema)


def pack(items: DataFrame, length: str = "length", capacity: int = LENGTH) -> DataFrame:
    """items (each of 0 < length <= capacity) with sequence_id and offset. Shards are packed on their own; what they
    leave in sequences filled less than REPACK_BELOW is packed as whole blocks once more, in fewer shards.

    Only lengths and keys are shuffled. Both rounds are written before they are read, so that all of a sequence comes from
    one run of its shard. Repeated rows and ties: each row has its own place. Empty table: empty result.
    Columns named sequence_id or offset are replaced."""
    items = items.drop("sequence_id", "offset")
    if not (count := items.count()):
        return items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = materialise(_packed(items, length, count, capacity, 0), "packed")
    fill = first.groupBy("bin").agg(F.sum(length).alias("fill"))
    loose = materialise(fill.where(F.col("fill") < REPACK_BELOW * capacity), "loose")
    out = first.join(_repacked(loose, capacity), "bin", "left")
    return out.withColumns({"sequence_id": F.coalesce("new_bin", "bin"), "offset": F.col("place") + F.coalesce("shift", F.lit(0))}).drop("bin", "place", "new_bin", "shift")


def _repacked(loose: DataFrame, capacity: int) -> DataFrame:
    """bin, new_bin, shift: where each loosely filled sequence goes as one block."""
    blocks = loose.select(F.col("bin").alias("old"), "fill")
    packed = _packed(blocks, "fill", blocks.count(), capacity, 1)
    # written, as ties fall by the order of arrival: a shard worked out anew may place its blocks otherwise
    return materialise(packed.select(F.col("old").alias("bin"), F.col("bin").alias("new_bin"), F.col("place").alias("shift")), "repacked")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text) with their places; the tokens are counted once and written."""
    cut = pieces(docs.select("doc_id", "text"), tokenizer or public_tokenizer(), with_ids=False)
    return pack(materialise(cut, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(spark, sf_dir):
    return packed_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10}
