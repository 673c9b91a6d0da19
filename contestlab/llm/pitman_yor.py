"""Language-model scoring with a hierarchical Pitman-Yor model.

Words are the dishes. The word before is the context. Every word that occurs in training has a restaurant of its own as a
context; its parent is the restaurant of its class, which words that end alike share (short words stand for themselves), and where
the first words of texts sit at once. All classes share the root, whose base is uniform over the vocabulary and one unknown
word. A restaurant's customers are its own occurrences and the tables of its children.

Seating is sampled by Gibbs: a customer, chosen at random among a dish's, leaves its table and sits down again by the
Chinese-restaurant process given all others; when a table opens or closes, a customer joins or leaves the parent. Words are
dealt out into buckets with their dishes in all restaurants, so that only a restaurant's totals (customers, tables) are shared.
They are summed after each round; while a round runs, a bucket sees its own changes at once and others' as they were. Totals of the
root, the classes and the FREQUENT most frequent contexts go to all tasks, as vectors of bounded lengths. Those of all other (rare)
contexts are summed where the context's id belongs, from the buckets that hold words after it, and each of these gets them back.

Dishes of a bucket are visited side by side. Of a small dish (up to SMALL customers) only the number of tables is kept, since no
probability depends on more: a sweep draws it anew by its exact law, all seatings with so many tables taken together. All customers
of a larger dish stand up and sit down again as one block: the places in their order of arrival at which tables open are drawn gap
by gap, then the tables' sizes, and the new seating is taken or refused by Metropolis-Hastings, which makes it an exact move. It
costs as much as the dish has tables, however many customers sit there. The seating (numbers of tables, and the sizes of larger
dishes' tables) is written after each round and the next goes on from it; totals are always those of the seating that is written,
so that the predictive probabilities of a sample add up to one. The samples' probabilities are averaged.

A bucket's counts are summed within batches of documents first. Occurrences stream through a task; a bucket with many is
dealt to several tasks, each with the bucket's seating. Every token counts, and no number of contexts is bounded (FREQUENT only says whose totals go to all tasks; rare contexts are told
apart by 48 bits of a hash)."""

from __future__ import annotations

import functools
import itertools
import math
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import LOWER_BYTES, STEP, input_partitions, materialise, planes, read, tidy, unplanes

#: Discounts and strengths of the root, the classes and the contexts.
DISCOUNT, STRENGTH = (0.70, 0.75, 0.80), (10.0, 5.0, 2.0)
#: The most frequent words, whose totals as contexts go to all tasks, and classes of words.
FREQUENT, CLASSES = 61_440, 4_096
#: Words of at most so many bytes are a class of their own before hashing; of longer ones the last three bytes count.
SHORT = 5
#: More sweeps of the first round, sweeps of each round, rounds (each ends with a sample), and sweeps of the root for one of
#: the others.
BURN_IN, SWEEPS, ROUNDS, ROOT_SWEEPS = 1, 1, 2, 1
#: Customers from which on a dish is seated anew as a block, and changes of a dish's customers that are made one at a time.
LARGE, FEW = 6, 16
#: Customers up to which a dish's tables are drawn at once by their exact law, the tables' sizes summed out.
SMALL = 64
SEED = 11
#: Tokens that a task gathers before it deals them out.
CHUNK = 700_000
#: Log probabilities are sent as multiples of 2 ** -30.
UNIT = 1 << 30
START, END = b"\x00<start>", b"\x00<end>"
U = np.uint64


word_hash = xxhash.xxh3_64_intdigest


def class_of(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w if len(w) <= SHORT else b"\x01" + w[-3:], 1) % CLASSES


class Vocabulary:
    """Hash and context of each distinct word of a batch of documents, by its code: start, end, then the others. frequent: sorted
    hashes of the words whose totals all tasks know; the others' contexts are FREQUENT + class. rare: ids (48 bits of the hash)
    of those others as contexts, 0 for frequent words and the start."""

    def __init__(self, words: pa.LargeStringArray, frequent: np.ndarray) -> None:
        sizes = np.r_[len(START), len(END), pc.binary_length(words).to_numpy(zero_copy_only=False)]
        data, ends = START + END + (words.buffers()[2].to_pybytes() if len(words) else b""), np.r_[0, sizes.cumsum()].astype(np.int64)
        at = ends.tolist()
        self.hash = np.fromiter(map(word_hash, map(data.__getitem__, map(slice, at[:-1], at[1:]))), U, len(ends) - 1)
        place, known = _found(frequent, self.hash)
        rest = np.flatnonzero(~known)
        size, last = np.diff(ends)[rest], ends[rest + 1]
        long, short = size > SHORT, np.flatnonzero(size <= SHORT)
        classes, raw = np.zeros(len(rest), np.int64), np.frombuffer(data, np.uint8).astype(np.uint32)
        z = last[long]
        suffix, which = np.unique(raw[z - 3] << 16 | raw[z - 2] << 8 | raw[z - 1], return_inverse=True)
        classes[long] = np.array([class_of(bytes(SHORT) + int(x).to_bytes(3)) for x in suffix], np.int64)[which]
        classes[short] = [class_of(data[at[k] : at[k + 1]]) for k in rest[short].tolist()]
        place[rest] = FREQUENT + classes
        self.context = place.astype(np.uint16)
        self.rare = np.where(known, U(0), np.maximum(self.hash >> U(16), U(1)))
        self.rare[0] = 0


def word_arrays(texts: pd.Series) -> Iterator[tuple[pa.LargeStringArray, np.ndarray]]:
    """The words of some texts, as tokens_of() has them but without ends, and how many each text has, a few MB at a time."""
    texts = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum() // STEP
    cuts = np.r_[firsts(size), len(size)]
    for a, z in itertools.pairwise(cuts.tolist()):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[a:z]))
        words, offsets = lists.values, lists.offsets.to_numpy()
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        yield words.filter(pa.array(some)), np.diff(np.r_[0, some.cumsum()][offsets])


def tokens_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, then one end. bytes.split() parts at the six white-space bytes alone."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split(), END]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, unsigned ones in no more bytes a number than the largest needs."""
    sent = {k: a.astype(np.min_scalar_type(a.max())) if a.dtype.kind == "u" and len(a) else a for k, a in arrays.items()}
    return pickle.dumps({k: (arrays[k].dtype.str, a.dtype.str, planes(a)) for k, a in sent.items()}, 5)


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    return {k: unplanes(b, np.dtype(d)).astype(kind, copy=False) for k, (kind, d, b) in pickle.loads(raw).items()}


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes; cumsum() gives them back."""
    return np.diff(x, prepend=U(0))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, rising with the hash."""
    return ((x >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def firsts(x: np.ndarray) -> np.ndarray:
    """Places where a sorted array's runs begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


#: Rows that tasks send: where to, what, from where, and packed arrays. Kinds come in this order.
ROWS = "part int, kind int, no long, data binary"
COUNTS, STATE, TOTALS, LINKS, REPLY, IDS, OCCURRENCES = range(7)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "no", "data"])


def by_part(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator]]:
    """Rows, sorted by part and kind, part by part."""
    return itertools.groupby((r for b in batches for r in b.itertuples()), key=lambda r: r.part)


def placed(rows: DataFrame, parts: int) -> DataFrame:
    """Each part's rows in a partition of their own, in order."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "no")


# counting


def chunks(batches: Iterator[pd.DataFrame], frequent: np.ndarray, most: int = CHUNK) -> Iterator[tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (id, training, text) in batches of about so many tokens: vocabulary, the tokens' codes, the documents' numbers
    of tokens, ids and flags."""
    words, lengths, ids, train = [], [], [], []

    def one() -> tuple:
        coded, n, i, t = pa.concat_arrays(words).dictionary_encode(), np.concatenate(lengths) + 1, np.concatenate(ids), np.concatenate(train)
        for held in (words, lengths, ids, train):
            held.clear()
        codes, is_end = np.ones(int(n.sum()), np.uint32), np.zeros(int(n.sum()), bool)
        is_end[n.cumsum() - 1] = True
        codes[~is_end] = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(2)
        return Vocabulary(coded.dictionary, frequent), codes, n, i, t

    for b in batches:
        own, flags, done = b["id"].to_numpy(np.int64), b["training"].to_numpy(bool), 0
        for w, n in word_arrays(b["text"]):
            words.append(w)
            lengths.append(n)
            ids.append(own[done : done + len(n)])
            train.append(flags[done : done + len(n)])
            done += len(n)
            if sum(len(x) for x in words) + sum(len(x) for x in lengths) > most:
                yield one()
    if lengths:
        yield one()


def frequent_words(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the FREQUENT most frequent words of the training rows (ties by hash), and their classes."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vocab, codes, *_ in chunks(batches, np.zeros(0, U), 3 * CHUNK):
            yield one(vocab, np.bincount(codes, minlength=len(vocab.hash)))

    def one(vocab: Vocabulary, n: np.ndarray) -> pd.DataFrame:
        used = np.flatnonzero(n)
        used = used[np.argsort(vocab.hash[used])]
        hashes, n, c = vocab.hash[used], n[used], vocab.context[used] - np.uint16(FREQUENT)
        cuts = np.searchsorted(part_of(hashes, buckets), np.arange(buckets + 1))
        return _frame([(k, COUNTS, 0, pack(words=steps(hashes[a:z]), n=n[a:z].astype(np.uint32), classes=c[a:z])) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, own in by_part(batches):
            parts: list[tuple] = []
            for r in own:
                x = unpack(r.data)
                parts.append((x["words"].cumsum(dtype=U), x["n"].astype(np.int64), x["classes"]))
                if sum(len(p[0]) for p in parts[1:]) > max(400_000, len(parts[0][0])):
                    parts = [_added(parts)]
            words, n, c = _added(parts)
            best = np.lexsort((words, -n))[:FREQUENT]
            yield pd.DataFrame({"word": words[best].view(np.int64), "n": n[best], "class": c[best].astype(np.int32)})

    words = rows.where("training").mapInPandas(tidy(deal), ROWS)
    best = placed(words, buckets).mapInPandas(tidy(total), "word long, n long, class int").orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    words = best["word"].to_numpy(np.int64).view(U)
    order, classes = np.argsort(words), np.zeros(FREQUENT, np.int64)
    classes[: len(words)] = best["class"].to_numpy()[order]
    return words[order], classes


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, n, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(words)
    words, n = words[order], n[order]
    at = firsts(words)
    return words[at], np.add.reduceat(n, at) if len(at) else n, c[order][at]


def dealt(rows: DataFrame, buckets: int, frequent: np.ndarray, offsets: np.ndarray | None = None) -> DataFrame:
    """ROWS of (id, training, text), a batch of documents and a bucket of words at a time: the words, and for each its contexts
    with their numbers. Without offsets COUNTS, of training rows. With offsets (the first task of each bucket and their end)
    OCCURRENCES: also the documents of each, in a row for one of the bucket's tasks, and IDS: the batch's ids and their
    numbers of tokens."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, frequent):
            yield one(*chunk)

    def one(vocab: Vocabulary, word: np.ndarray, lengths: np.ndarray, ids: np.ndarray, train: np.ndarray) -> pd.DataFrame:
        before = np.r_[np.uint32(0), word[:-1]]
        before[np.r_[0, lengths.cumsum()[:-1]]] = 0
        used = np.flatnonzero(np.bincount(word))
        used = used[np.argsort(vocab.hash[used])]
        hashes, place = vocab.hash[used], np.zeros(len(vocab.hash), U)
        place[used] = np.arange(len(used), dtype=U)
        by_context, rank = np.lexsort((vocab.rare, vocab.context)), np.zeros(len(vocab.hash), U)
        rank[by_context] = np.arange(len(rank), dtype=U)
        bits, more = U(len(rank).bit_length()), U(len(ids).bit_length())  # words and documents have some 20 bits each
        key, rows = place[word] << bits | rank[before], []
        edges = np.searchsorted(part_of(hashes, buckets), np.arange(buckets + 1))
        if offsets is None:
            some = np.repeat(train, lengths)
            rare = vocab.rare[before]
            other = np.unique(key[~some & (rare > 0)])
            key = key[some]
            key.sort()
        else:
            key = key << more | np.repeat(np.arange(len(ids), dtype=U), lengths)
            key.sort()
            docs = (key & ((U(1) << more) - U(1))).astype(np.uint32)
            key >>= more
        at = firsts(key)
        cells, n = key[at], np.diff(np.r_[at, len(key)]).astype(np.uint32)
        if offsets is not None:
            ends = np.r_[0, n.cumsum(dtype=np.int64)]
            chunk = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
            rows.append((chunk % int(offsets[-1]), IDS, chunk, pack(ids=ids, n=lengths.astype(np.uint32))))
        code = lambda keys: by_context[(keys & ((U(1) << bits) - U(1))).astype(np.int64)]
        word, context = (cells >> bits).astype(np.int64), code(cells)
        context, rare = vocab.context[context], vocab.rare[context]
        cuts = np.searchsorted(word, edges)
        sizes = np.bincount(word, minlength=len(hashes)).astype(np.uint32)
        if offsets is None:
            asked, asked_cuts = vocab.rare[code(other)], np.searchsorted((other >> bits).astype(np.int64), edges)
        for k in range(buckets):
            a, z, p, q = cuts[k], cuts[k + 1], edges[k], edges[k + 1]
            if q == p:
                continue
            arrays = {"words": steps(hashes[p:q]), "sizes": sizes[p:q], "contexts": context[a:z], "n": n[a:z], "rare": rare[a:z][context[a:z] >= FREQUENT]}
            if offsets is None:
                rows.append((k, COUNTS, 0, pack(**arrays, asked=steps(np.unique(asked[asked_cuts[k] : asked_cuts[k + 1]])))))
            else:
                tasks = int(offsets[k + 1] - offsets[k])
                rows.append((int(offsets[k]) + chunk % tasks, OCCURRENCES, chunk, pack(**arrays, docs=docs[ends[a] : ends[z]])))
        return _frame(rows)

    return rows.mapInPandas(tidy(deal), ROWS)


#: A cell's key: the place of its word << 40 | its context << 24 | 1 + the place of a rare context's id (0: none).
WORD, CONTEXT = U(40), U(24)


def spread(x: dict[str, np.ndarray]) -> np.ndarray:
    """Ids of the rare contexts of all cells, 0 where there is none."""
    out = np.zeros(len(x["contexts"]), U)
    out[x["contexts"] >= FREQUENT] = x["rare"]
    return out


def _summed(parts: list[tuple]) -> tuple:
    """words, ids of rare contexts, key and n of several such; words without cells are left out."""
    words = np.unique(np.concatenate([p[0][np.unique((p[2] >> WORD).astype(np.int64))] for p in parts]))
    ids = np.unique(np.concatenate([p[1] for p in parts]))
    keys = []
    for w, i, key, _ in parts:
        rare = (key & ((U(1) << CONTEXT) - U(1))).astype(np.int64)
        own = np.r_[U(0), np.searchsorted(ids, i).astype(U) + U(1)]
        keys.append(np.searchsorted(words, w).astype(U)[(key >> WORD).astype(np.int64)] << WORD | key >> CONTEXT << CONTEXT & ((U(1) << WORD) - U(1)) | own[rare])
    key, n = np.concatenate(keys), np.concatenate([p[3] for p in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = firsts(key)
    return words, ids, key[at], np.add.reduceat(n, at) if len(at) else n


def merged(classes: np.ndarray, buckets: int) -> Callable:
    """COUNTS rows of a bucket to its STATE row without seating, its TOTALS: customers, and tables as if each dish had one, and
    LINKS: the same of its rare contexts."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, counted in by_part(batches):
            yield one(bucket, counted)

    def one(bucket: int, counted: Iterator) -> pd.DataFrame:
        parts: list[tuple] = []
        for r in counted:
            x = unpack(r.data)
            rare, word = spread(x), np.repeat(np.arange(len(x["sizes"]), dtype=U), x["sizes"])
            ids = np.unique(np.r_[rare[rare > 0], x["asked"].cumsum(dtype=U)])
            at = np.where(rare > 0, np.searchsorted(ids, rare).astype(U) + U(1), U(0))
            parts.append((x["words"].cumsum(dtype=U), ids, word << WORD | x["contexts"].astype(U) << CONTEXT | at, x["n"].astype(np.int64)))
            if sum(len(p[2]) for p in parts[1:]) > max(400_000, len(parts[0][2])):
                parts = [_summed(parts)]
        words, ids, key, n = _summed(parts)
        context, rare = (key >> CONTEXT).astype(np.uint16), key & ((U(1) << CONTEXT) - U(1))
        state = {"words": steps(words), "sizes": np.bincount((key >> WORD).astype(np.int64), minlength=len(words)).astype(np.uint32), "contexts": context, "n": n.astype(U), "rare": rare[context >= FREQUENT], "ids": steps(ids)}
        b = Bucket(state, classes)
        own = np.bincount(b.context[b.frequent], b.count[b.frequent], minlength=FREQUENT)
        ones = lambda x: np.ones(len(x), np.int64)
        return _frame([(bucket, STATE, 0, pack(**state)), b.totals(ones(b.low_count), ones(b.dish_class), ones(words), bucket, own, ones(b.rare_count)), *b.links(bucket, buckets, n=b.rare_count, t=ones(b.rare_count))])

    return merge


def replied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """LINKS of a part of the rare contexts, from all buckets, to the contexts' sums, in the order in which each bucket asked."""
    for part, rows in by_part(batches):
        asked = [(r.no, unpack(r.data)) for r in rows]
        ids = [x.pop("ids").cumsum(dtype=U) for _, x in asked]
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        sums = {k: np.bincount(at, np.concatenate([x[k] for _, x in asked]), minlength=len(every)).astype(U) for k in asked[0][1]}
        ends = np.r_[0, np.cumsum([len(i) for i in ids])]
        for k, (bucket, _) in enumerate(asked):
            own = at[ends[k] : ends[k + 1]]
            yield _frame([(bucket, REPLY, part, pack(**{c: v[own] for c, v in sums.items()}))])


def replies(made: DataFrame, buckets: int) -> DataFrame:
    return placed(made.where(F.col("kind") == LINKS), buckets).mapInPandas(tidy(replied), ROWS)


def _joined(rows: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([x[k] for x in rows]) for k in rows[0]} if rows else {"n": np.zeros(0, U), "t": np.zeros(0, U)}


# seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps further up."""
    y = x + 8.0
    steps_up = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps_up


class Law(NamedTuple):
    """Weights of a new table for dishes by the number of tables that they have themselves, all else as it is:
    (a + discount * i) * (x - parent_discount * min(parent_t, x) + rest) / (parent_n + each * i), x = parent_own + each * i."""

    discount: float
    parent_discount: float
    each: int
    a: np.ndarray
    parent_own: np.ndarray
    parent_t: np.ndarray
    rest: np.ndarray
    parent_n: np.ndarray

    def at(self, k: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of dishes k with i tables."""
        x = self.parent_own[k] + self.each * i
        up = (x - self.parent_discount * np.minimum(self.parent_t[k], x) + self.rest[k]) / (self.parent_n[k] + self.each * i)
        return np.maximum((self.a[k] + self.discount * i) * up, 1e-300)

    def damping(self, n: np.ndarray) -> np.ndarray:
        """Logs of factors, by doubling and dish, for drawing seatings of n customers: tables open less often among n customers
        of one dish than among those who sit down one by one, the more so the more customers are to come. It is the slope,
        by the number of tables, of the log weight of all that is to come, backwards along the expected numbers of tables.
        Any factors would do; the closer they are, the fewer seatings are refused."""
        k, d = np.arange(len(n)), self.discount
        edges = [np.minimum(2.0**s, n) for s in range(int(n.max(initial=2) - 1).bit_length() + 1)]
        t, out = [np.ones(len(n)) for _ in edges[1:]], np.zeros((len(edges) - 1, len(n)))
        for _ in range(4):
            ahead = np.zeros(len(n))
            for s in range(len(t) - 1, -1, -1):
                f = self.at(k, t[s])
                x = f * np.exp(ahead) - d * t[s]
                step = ((self.at(k, t[s] + 1) - f) * np.exp(ahead) - d) * np.log((edges[s + 1] + x) / (edges[s] + x))
                out[s] = np.clip(ahead + step / 2, -40.0, 0.0)
                ahead = np.clip(ahead + step, -40.0, 0.0)
            here = np.ones(len(n))
            for s in range(len(t)):
                f = self.at(k, here) * np.exp(out[s])
                more = f * np.log((edges[s + 1] + f - d * here) / (edges[s] + f - d * here))
                t[s] = np.minimum(here + more / 2, edges[s])
                here = np.minimum(here + more, edges[s + 1])
        return out

    def log_weight(self, damped: np.ndarray, n: np.ndarray, t: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log of how much likelier a seating of n customers, whose tables open at places, is than arrivals() draws it, up to a
        constant: the normalisers that the customers meet, and the damping of the openings undone. Between openings and
        doublings of the customers the normalisers' product is a ratio of gamma functions."""
        k, opened = np.repeat(np.arange(len(t)), t), np.flatnonzero(places > 0)
        out = -np.bincount(k[opened], damped[doubling(places[opened]), k[opened]], minlength=len(t))
        doublings = doubling(n - 1)
        at = np.repeat(np.arange(len(t)), doublings)
        powers = 2 << (np.arange(len(at)) - (doublings.cumsum() - doublings)[at])
        start, dish, opens = np.r_[places + 1, powers], np.r_[k, at], np.r_[np.ones(len(places), np.int64), np.zeros(len(powers), np.int64)]
        order = np.lexsort((start, dish))
        start, dish, tables = start[order], dish[order], opens[order].cumsum() - (t.cumsum() - t)[dish[order]]
        until = np.r_[start[1:], 0]
        last = np.r_[dish[1:] != dish[:-1], True]
        until[last] = n[dish[last]]
        x = self.at(dish, tables) * np.exp(damped[doubling(np.minimum(start, n[dish] - 1)), dish]) - self.discount * tables
        return out + np.bincount(dish, log_gamma(until + x) - log_gamma(start + x), minlength=len(t))

    def comers(self, rng: np.random.Generator, n: np.ndarray, t: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dishes and places of the tables that open when customers sit down one by one until there are goal, not n at t tables."""
        none = np.flatnonzero((n == 0) & (goal > 0))
        count, t, out = n.copy(), t.copy(), [(none, np.zeros(len(none), np.int64))]
        count[none], t[none] = 1, 1
        live = np.flatnonzero(count < goal)
        while len(live):
            chance = rng.beta(self.at(live, t[live]), count[live] - self.discount * t[live])
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                gap = np.maximum(np.ceil(np.log(1 - rng.random(len(live))) / np.log1p(-chance)), 1)
            opens = count[live] + gap <= goal[live]
            live = live[opens]
            count[live] += gap[opens].astype(np.int64)
            t[live] += 1
            out.append((live, count[live] - 1))
            live = live[count[live] < goal[live]]
        return tuple(np.concatenate([o[c] for o in out]) for c in range(2))

    def arrivals(self, rng: np.random.Generator, damped: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tables, and the places in their dish's order of arrival of the customers who open them, when n customers
        sit down one by one, openings damped. Until the next table opens or the customers have doubled, it is an urn with two
        colours: a beta-distributed chance, then a geometric gap."""
        t, count, live = np.ones(len(n), np.int64), np.ones(len(n), np.int64), np.flatnonzero(n > 1)
        out = [(np.arange(len(n)), np.zeros(len(n), np.int64))]
        while len(live):
            come = count[live]
            chance = rng.beta(np.maximum(self.at(live, t[live]) * np.exp(damped[doubling(come), live]), 1e-300), come - self.discount * t[live])
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                gap = np.maximum(np.ceil(np.log(1 - rng.random(len(live))) / np.log1p(-chance)), 1)
            end = np.minimum(np.ldexp(1.0, np.frexp(come)[1]), n[live]).astype(np.int64)
            opens = come + gap <= end
            some = live[opens]
            count[live] = end
            count[some] = come[opens] + gap[opens].astype(np.int64)
            t[some] += 1
            out.append((some, count[some] - 1))
            live = live[count[live] < n[live]]
        dish, place = (np.concatenate([o[c] for o in out]) for c in range(2))
        return t, place[np.lexsort((place, dish))]


def thinned(rng: np.random.Generator, t: np.ndarray, size: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Sizes (some now 0) of the tables when so many customers of each dish stay, all alike likely."""
    order, start, more_than = in_steps(t)
    keep, out = keep[order].copy(), np.zeros_like(size)
    rest = np.bincount(np.repeat(np.arange(len(t)), t), size, minlength=len(t)).astype(np.int64)[order]
    for s in range(int(t.max(initial=0))):
        c = more_than(s)
        at = start[:c] + s
        rest[:c] -= size[at]
        out[at] = x = rng.hypergeometric(size[at], rest[:c], keep[:c])
        keep[:c] -= x
    return out


def doubling(count: np.ndarray) -> np.ndarray:
    """The whole part of the logarithm by two."""
    return np.frexp(count)[1] - 1


def in_steps(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Dishes by falling numbers of tables, the place of each one's first table, and how many have more than s tables."""
    order = np.argsort(-t, kind="stable")
    falling = -t[order]
    return order, (t.cumsum() - t)[order], lambda s: int(np.searchsorted(falling, -s))


def table_sizes(rng: np.random.Generator, d: float, n: np.ndarray, t: np.ndarray, places: np.ndarray, at_first: np.ndarray) -> np.ndarray:
    """Sizes of tables that come after so many customers (places) and hold at_first customers then, from the last to the first:
    of the customers who come later and sit there or at an older one, a share by the urn of the two."""
    order, start, more_than = in_steps(t)
    left, size = n[order].copy(), np.empty(len(places), np.int64)
    for s in range(int(t.max(initial=1)) - 1, 0, -1):
        c = more_than(s)
        at = start[:c] + s
        p = places[at]
        own = at_first[at]
        size[at] = x = own + rng.binomial(left[:c] - p - own, rng.beta(own - d, p - d * s))
        left[:c] -= x
    size[start] = left
    return size


def places_of(rng: np.random.Generator, t: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at which tables of these sizes open when their customers come in random order. Customers come after times with
    an exponential law, so a table opens after the least of its customers' times; how many others come between two
    openings is binomial."""
    time = rng.exponential(size=len(size)) / size
    by_time = np.lexsort((time, np.repeat(np.arange(len(t)), t)))
    time, size = time[by_time], size[by_time]
    order, start, more_than = in_steps(t)
    here, waiting, places = np.ones(len(t), np.int64), size[start] - 1, np.zeros(len(size), np.int64)
    for s in range(1, int(t.max(initial=1))):
        c = more_than(s)
        at = start[:c] + s
        come = rng.binomial(waiting[:c], -np.expm1(time[at - 1] - time[at]))
        here[:c] += come
        places[at] = here[:c]
        here[:c] += 1
        waiting[:c] += size[at] - 1 - come
    return places


class Seats:
    """Customers of dishes at tables: the sizes of tables, dish by dish, and how many tables each dish has."""

    def __init__(self, rng: np.random.Generator, discount: float, size: np.ndarray, tables: np.ndarray, opening: Callable, moved: Callable, law: Callable, ids: np.ndarray | None = None):
        """opening(dishes): weights of a new table for one more customer of each; moved(dishes, by): tables came or went;
        law(dishes): their Law."""
        self.rng, self.d, self.size, self.t, self.opening, self.moved, self.law = rng, discount, size.astype(np.int64), tables.astype(np.int64), opening, moved, law
        self.ids = np.arange(len(tables)) if ids is None else ids
        self.n = np.bincount(np.repeat(np.arange(len(tables)), self.t), self.size, minlength=len(tables)).astype(np.int64)

    def leave(self, i: np.ndarray) -> None:
        """One customer of each dish of i (rising), all alike likely, leaves."""
        sums, start = np.r_[0, self.size.cumsum()], np.r_[0, self.t.cumsum()]
        slot = np.searchsorted(sums, sums[start[i]] + self.rng.integers(0, self.n[i]), "right") - 1
        self.size[slot] -= 1
        self.n[i] -= 1
        gone = self.size[slot] == 0
        if gone.any():
            self.size = np.delete(self.size, slot[gone])
            self.t[i[gone]] -= 1
            self.moved(self.ids[i[gone]], -1)

    def sit(self, i: np.ndarray) -> None:
        """One more customer of each dish of i sits down."""
        start = np.r_[0, self.t.cumsum()]
        new, old = self.opening(self.ids[i]), self.n[i] - self.d * self.t[i]
        opens = self.rng.random(len(i)) * (new + old) < new
        j, k = i[~opens], i[opens]
        if len(j):
            sums = np.r_[0.0, (self.size - self.d).cumsum()]
            low, high = sums[start[j]], sums[start[j + 1]]
            at = np.minimum(low + self.rng.random(len(j)) * (high - low), np.nextafter(high, 0))
            self.size[np.searchsorted(sums, at, "right") - 1] += 1
        if len(k):
            self.size = np.insert(self.size, start[k + 1], 1)
            self.t[k] += 1
            self.moved(self.ids[k], 1)
        self.n[i] += 1

    def part(self, i: np.ndarray) -> Seats:
        return Seats(self.rng, self.d, self.size[self._slots(i)], self.t[i], self.opening, self.moved, self.law, self.ids[i])

    def _slots(self, i: np.ndarray) -> np.ndarray:
        own = np.zeros(len(self.t), bool)
        own[i] = True
        return np.repeat(own, self.t)

    def put(self, i: np.ndarray, part: Seats) -> None:
        """Dishes i as they are in part."""
        others = self.size[~self._slots(i)]
        self.t[i], self.n[i] = part.t, part.n
        mine = self._slots(i)
        self.size = np.empty(len(mine), np.int64)
        self.size[~mine], self.size[mine] = others, part.size

    def sweep(self) -> None:
        large = np.flatnonzero(self.n >= LARGE)
        half = self.rng.random(len(large)) < 0.5  # so that each half knows what the other has come to
        for i in (large[half], large[~half]):
            if len(i):
                self.redraw(i)
        for low, high, visits in ((2, 3, 2), (3, LARGE, LARGE - 2)):
            i = np.flatnonzero((self.n >= low) & (self.n < high))
            if len(i):
                p = self.part(i)
                every = np.arange(len(i))
                for _ in range(visits):
                    p.leave(every)
                    p.sit(every)
                self.put(i, p)

    def redraw(self, i: np.ndarray) -> None:
        """All customers of each dish of i (rising) leave and sit down again, one by one, unless the move is refused: it is taken
        by the ratio of the weights that both seatings have beyond the chance of drawing them, in one random order each."""
        n, t, law = self.n[i], self.t[i], self.law(self.ids[i])
        damped = law.damping(n)
        tables, places = law.arrivals(self.rng, damped, n)
        gain = law.log_weight(damped, n, tables, places) - law.log_weight(damped, n, t, places_of(self.rng, t, self.size[self._slots(i)]))
        taken = np.log(1 - self.rng.random(len(i))) < gain
        j, by = i[taken], (tables - t)[taken]
        if len(j):
            opened = places[np.repeat(taken, tables)]
            size = table_sizes(self.rng, self.d, n[taken], tables[taken], opened, np.ones_like(opened))
            self.put(j, Seats(self.rng, self.d, size, tables[taken], self.opening, self.moved, self.law, self.ids[j]))
            self.moved(self.ids[j[by != 0]], by[by != 0])

    def bring(self, wanted: np.ndarray) -> None:
        """Customers leave and come, one at a time, until each dish has so many as wanted; where they are many, with the same
        law at once."""
        by = wanted - self.n
        many = np.flatnonzero(np.abs(by) > FEW)
        if len(many):
            self.bring_many(many, wanted[many])
        for i in (np.flatnonzero((by != 0) & (np.abs(by) <= 2)), np.flatnonzero((np.abs(by) > 2) & (np.abs(by) <= FEW))):
            if len(i):
                p, goal = self.part(i), wanted[i]
                while len(j := np.flatnonzero(p.n > goal)):
                    p.leave(j)
                while len(j := np.flatnonzero(p.n < goal)):
                    p.sit(j)
                self.put(i, p)

    def bring_many(self, i: np.ndarray, goal: np.ndarray) -> None:
        """As bring(), for dishes i (rising): those who leave are drawn table by table, those who come by the gaps between
        openings, at a cost by the dishes' tables."""
        n, t, law = np.minimum(self.n[i], goal), self.t[i], self.law(self.ids[i])
        size, dish = thinned(self.rng, t, self.size[self._slots(i)], n), np.repeat(np.arange(len(i)), t)
        size, dish = size[size > 0], dish[size > 0]
        new, places = law.comers(self.rng, n, np.bincount(dish, minlength=len(i)), goal)
        before = size.cumsum() - size - (n.cumsum() - n)[dish]
        dish, before, size = np.r_[dish, new], np.r_[before, places], np.r_[size, np.ones_like(places)]
        order, tables = np.lexsort((before, dish)), np.bincount(dish, minlength=len(i))
        some = goal > 0
        size = table_sizes(self.rng, self.d, goal[some], tables[some], before[order], size[order])
        self.put(i, Seats(self.rng, self.d, size, tables, self.opening, self.moved, self.law, self.ids[i]))
        by = tables - t
        self.moved(self.ids[i[by != 0]], by[by != 0])

    def start(self, wanted: np.ndarray) -> None:
        """A first seating, which the sweeps take on from: as many tables as would open when customers sit down one by one (a
        few at a time for large dishes, at the odds that the first of them meets), and customers dealt over them at random."""
        i = np.flatnonzero(wanted > 0)
        if not len(i):
            return
        goal = wanted[i].astype(np.int64)
        n, t = np.ones(len(i), np.int64), np.ones(len(i), np.int64)
        self.moved(self.ids[i], 1)
        live = np.flatnonzero(goal > 1)
        while len(live):
            come = np.minimum(goal[live] - n[live], np.maximum(1, n[live] // 8))
            new = self.opening(self.ids[i[live]])
            opened = self.rng.binomial(come, new / (new + n[live] - self.d * t[live]))
            n[live] += come
            t[live] += opened
            some = opened > 0
            self.moved(self.ids[i[live[some]]], opened[some])
            live = live[n[live] < goal[live]]
        self.n, self.t = wanted.astype(np.int64).copy(), np.zeros(len(wanted), np.int64)
        self.t[i] = t
        first = np.r_[0, t.cumsum()[:-1]].astype(np.int64)
        share = self.rng.gamma(1 - self.d, size=int(t.sum())) + 1e-12
        self.size = 1 + np.floor(share * np.repeat((goal - t) / np.add.reduceat(share, first), t)).astype(np.int64)
        self.size[first] += goal - np.add.reduceat(self.size, first)


@functools.cache
def stirling(d: float) -> tuple[np.ndarray, np.ndarray]:
    """By n customers and t tables up to SMALL: logs of S(n, t), the weight of all seatings of one dish, and the chance that any
    one customer of such a seating sits alone."""
    log_s = np.full((SMALL + 1, SMALL + 1), -np.inf)
    log_s[0, 0] = log_s[1, 1] = 0.0
    t = np.arange(1, SMALL + 1)
    for n in range(1, SMALL):
        log_s[n + 1, 1:] = np.logaddexp(log_s[n, :-1], log_s[n, 1:] + np.log(np.maximum(n - d * t, 1e-300)))
    alone, some = np.zeros_like(log_s), np.isfinite(log_s[1:, 1:])
    alone[1:, 1:][some] = np.exp(log_s[:-1, :-1][some] - log_s[1:, 1:][some])
    return log_s, alone


class Tables:
    """Customers of dishes of which the numbers of tables are wanted. Of dishes of at most SMALL customers no more is known: all
    seatings with so many tables are one state, which is drawn anew by its exact law. Of larger ones the tables' sizes are kept
    (size, dish by dish), and they sit as in Seats."""

    def __init__(self, rng: np.random.Generator, discount: float, n: np.ndarray, t: np.ndarray, size: np.ndarray, opening: Callable, moved: Callable, law: Callable):
        self.rng, self.d, self.n, self.t, self.size, self.opening, self.moved, self.law = rng, discount, n.astype(np.int64), t.astype(np.int64), size.astype(np.int64), opening, moved, law
        self.log_s, self.alone = stirling(discount)

    def start(self) -> None:
        """A first seating of the large dishes, instead of one table each."""
        i = np.flatnonzero(self.n > SMALL)
        if len(i):
            self.moved(i, -1)
            none = np.zeros(0, np.int64)
            seats = Seats(self.rng, self.d, none, np.zeros(len(i), np.int64), self.opening, self.moved, self.law, i)
            seats.start(self.n[i])
            self._take(i, seats)

    def _take(self, i: np.ndarray, seats: Seats) -> None:
        """Dishes i, all large ones among them, as they are in seats."""
        self.n[i], self.t[i] = seats.n, seats.t
        self.size = seats.size[np.repeat(seats.n > SMALL, seats.t)]

    def _seats(self, i: np.ndarray) -> Seats:
        """Dishes i (rising), all large ones among them, with sizes of their tables; those of small ones are drawn by their law:
        from the last customer to the first, each is the one who opened a table by the chance to sit alone."""
        small = self.n[i] <= SMALL
        n, t = self.n[i[small]], self.t[i[small]]
        first, left, places = t.cumsum() - t, t.copy(), np.zeros(int(t.sum()), np.int64)
        for m in range(int(n.max(initial=1)), 1, -1):
            k = np.flatnonzero(n >= m)
            k = k[self.rng.random(len(k)) < self.alone[m, left[k]]]
            left[k] -= 1
            places[first[k] + left[k]] = m - 1
        some = np.repeat(small, self.t[i])
        size = np.empty(len(some), np.int64)
        size[~some] = self.size
        if len(n):
            size[some] = table_sizes(self.rng, self.d, n, t, places, np.ones_like(places))
        return Seats(self.rng, self.d, size, self.t[i], self.opening, self.moved, self.law, i)

    def sweep(self) -> None:
        i = np.flatnonzero((self.n > 1) & (self.n <= SMALL))
        half = self.rng.random(len(i)) < 0.5
        self.draw(i[half])
        self.draw(i[~half])
        i = np.flatnonzero(self.n > SMALL)
        if len(i):
            seats = self._seats(i)
            seats.sweep()
            self._take(i, seats)

    def draw(self, i: np.ndarray) -> None:
        """Numbers of tables of small dishes i by their law, all else as it is: S(n, t) times the weights of the openings."""
        law, n, t = self.law(i), self.n[i], self.t[i]
        for below, most in itertools.pairwise((1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, SMALL)):
            k = np.flatnonzero((n > below) & (n <= most))
            if len(k):
                log_w = self.log_s[n[k], 1 : most + 1]
                log_w[:, 1:] += np.log(law.at(k[:, None], np.arange(1, most))).cumsum(axis=1)
                w = np.exp(log_w - log_w.max(axis=1, keepdims=True)).cumsum(axis=1)
                t[k] = 1 + (w <= self.rng.random((len(k), 1)) * w[:, -1:]).sum(axis=1)
        self._become(i, t)

    def _become(self, i: np.ndarray, t: np.ndarray) -> None:
        by = t - self.t[i]
        self.t[i] = t
        self.moved(i[by != 0], by[by != 0])

    def bring(self, wanted: np.ndarray) -> None:
        """As Seats.bring(); of a small dish, the customer who leaves has sat alone by the share of such seatings."""
        large = (self.n > SMALL) | (wanted > SMALL)
        i = np.flatnonzero(large)
        if (self.n[i] != wanted[i]).any():
            seats = self._seats(i)
            seats.bring(wanted[i])
            self._take(i, seats)
        live = np.flatnonzero(~large & (self.n != wanted))
        while len(live):
            leaves = self.n[live] > wanted[live]
            i, j = live[leaves], live[~leaves]
            t = self.t[i] - (self.rng.random(len(i)) < self.alone[self.n[i], self.t[i]])
            self.n[i] -= 1
            self._become(i, t)
            new = self.opening(j)
            t = self.t[j] + (self.rng.random(len(j)) * (new + self.n[j] - self.d * self.t[j]) < new)
            self.n[j] += 1
            self._become(j, t)
            live = live[self.n[live] != wanted[live]]


def _add(to: np.ndarray, at: np.ndarray, by: np.ndarray | int) -> None:
    """to[at] += by, at places that may be the same."""
    if len(at) > len(to) // 16:
        to += np.bincount(at, np.broadcast_to(by, len(at)), minlength=len(to)).astype(to.dtype)
    else:
        np.add.at(to, at, np.broadcast_to(by, len(at)).astype(to.dtype))


class Totals:
    """What every task knows of all: customers of contexts, tables of contexts, customers and tables of classes, customers and
    tables of the root, the vocabulary and the training tokens, and each frequent context's class."""

    def __init__(self, context_n: np.ndarray, context_t: np.ndarray, class_n: np.ndarray, class_t: np.ndarray, root_n: float, root_t: float, vocabulary: int, tokens: int, class_more: np.ndarray | None = None):
        """class_n: customers from frequent contexts and starts; class_more: from rare contexts."""
        self.context_n, self.context_t, self.class_n, self.class_t = context_n, context_t, class_n, class_t
        self.root_n, self.root_t, self.vocabulary, self.tokens, self.class_more = root_n, root_t, vocabulary, tokens, class_more

    def own(self, rare_n: np.ndarray | None = None, rare_t: np.ndarray | None = None) -> Totals:
        """A copy that a task may change: all customers of classes, and after the frequent contexts those rare ones it knows."""
        n, t = (x.copy() if r is None else np.r_[x, r.astype(x.dtype)] for x, r in ((self.context_n, rare_n), (self.context_t, rare_t)))
        class_n = self.class_n.copy() if self.class_more is None else self.class_n + self.class_more
        return Totals(n, t, class_n, self.class_t.copy(), self.root_n, self.root_t, self.vocabulary, self.tokens)

    def root(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probability in the root of words with n customers at t tables."""
        d, theta = DISCOUNT[0], STRENGTH[0]
        return (np.maximum(n - d * np.minimum(t, n), 0) + (theta + d * self.root_t) / (self.vocabulary + 1)) / (theta + self.root_n)

    def left_by(self, level: int, which: np.ndarray) -> np.ndarray:
        """What contexts (2) or classes (1) leave to their parents."""
        n, t = (self.context_n, self.context_t) if level == 2 else (self.class_n, self.class_t)
        return (STRENGTH[level] + DISCOUNT[level] * t[which]) / (STRENGTH[level] + n[which])


class Bucket:
    """The words of a bucket with their dishes in frequent contexts (`low`), classes (`high`) and the root (`top`)."""

    def __init__(self, state: dict[str, np.ndarray], classes: np.ndarray):
        """classes: of each frequent context."""
        self.static = {k: state[k] for k in ("words", "sizes", "contexts", "n", "rare", "ids", "rare_n") if k in state}
        self.words = state["words"].cumsum(dtype=U)
        self.word = np.repeat(np.arange(len(self.words)), state["sizes"])
        self.context, self.count = state["contexts"].astype(np.int64), state["n"].astype(np.int64)
        self.frequent = self.context < FREQUENT
        in_class = np.where(self.frequent, classes[np.minimum(self.context, FREQUENT - 1)], self.context - FREQUENT)
        bits = U(len(self.word).bit_length())
        place = (self.word.astype(U) << U(12) | in_class.astype(U)) << bits | np.arange(len(self.word), dtype=U)
        place.sort()
        key, dish = place >> bits, np.zeros(len(self.word), np.int64)
        first = firsts(key)
        dish[(place & ((U(1) << bits) - U(1))).astype(np.int64)] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        key = key[first]
        self.dish_key, self.dish_class, self.dish_word = key, (key & U(CLASSES - 1)).astype(np.int64), (key >> U(12)).astype(np.int64)
        self.low_context, self.low_count, self.low_dish = self.context[self.frequent], self.count[self.frequent], dish[self.frequent]
        self.at = np.zeros(len(self.count), np.int64)  # rare contexts of cells, from 1 on
        if "rare" in state:
            self.at[~self.frequent] = state["rare"].astype(np.int64)
        self.ids = state["ids"].cumsum(dtype=U) if "ids" in state else np.zeros(0, U)
        rare, start = self.at > 0, ~self.frequent & (self.at == 0)
        self.rare_at, self.rare_count = self.at[rare] - 1, self.count[rare]
        self.direct = np.bincount(dish[start], self.count[start], minlength=len(key)).astype(np.int64)
        self.cell_context, self.cell_count, self.cell_dish = np.r_[self.low_context, FREQUENT + self.rare_at], np.r_[self.low_count, self.rare_count], np.r_[self.low_dish, dish[rare]]

    def links(self, bucket: int, parts: int, **of_cells: np.ndarray) -> list[tuple]:
        """LINKS with sums by rare context."""
        sums = {k: np.bincount(self.rare_at, v, minlength=len(self.ids)).astype(U) for k, v in of_cells.items()}
        cuts = np.searchsorted(part_of(self.ids << U(16), parts), np.arange(parts + 1))
        return [(k, LINKS, bucket, pack(ids=steps(self.ids[a:z]), **{c: v[a:z] for c, v in sums.items()})) for k, (a, z) in enumerate(itertools.pairwise(cuts.tolist())) if z > a]

    def customers(self, level: int, tables: np.ndarray) -> np.ndarray:
        """Of dishes of classes (1), from the tables in frequent contexts, or in all if rare ones follow, or of words in the root
        (0), from those in classes."""
        if level:
            return self.direct + np.bincount(self.cell_dish[: len(tables)], tables, minlength=len(self.dish_key)).astype(np.int64)
        return np.bincount(self.dish_word, tables, minlength=len(self.words)).astype(np.int64)

    def totals(self, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray, bucket: int, counts: np.ndarray | None = None, rare: np.ndarray | None = None) -> tuple:
        n1, of = self.customers(1, t2), len(self.low_count)
        vectors = {
            "context_t": np.bincount(self.low_context, t2, minlength=FREQUENT), "class_n": np.bincount(self.dish_class, n1, minlength=CLASSES), "class_t": np.bincount(self.dish_class, t1, minlength=CLASSES),
            **({} if rare is None else {"class_more": np.bincount(self.dish_class[self.cell_dish[of:]], rare, minlength=CLASSES)}),
            "sums": np.array([t1.sum(), t0.sum(), len(self.words), self.count.sum()]), **({"counts": counts} if counts is not None else {}),
        }
        return bucket, TOTALS, int(self.count.sum()), pack(**{k: v.astype(U) for k, v in vectors.items()})

    def seat(self, rng: np.random.Generator, totals: Totals, state: dict[str, np.ndarray]) -> None:
        """Take up the seating of state, or a first one if it has none."""
        self.all = totals
        fresh = "t2" not in state

        def made(level: int, n: np.ndarray, *law: Callable) -> Tables:
            t, size = (np.ones(len(n), np.int64), np.zeros(0, np.int64)) if fresh else (_tables(n, state[f"t{level}"]), state[f"size{level}"])
            return Tables(rng, DISCOUNT[level], n, t, size, *law)

        self.low = made(2, self.cell_count, self._opening2, self._moved2, self._law2)
        self.n1 = self.customers(1, self.low.t)
        self.high = made(1, self.n1, self._opening1, self._moved1, self._law1)
        self.n0 = self.customers(0, self.high.t)
        self.top = made(0, self.n0, self._opening0, self._moved0, self._law0)
        if fresh:  # the totals count one table for each dish
            self.low.start()
            self.high.n = self.n1.copy()
            self.high.start()
            self.top.n = self.n0.copy()
            self.top.start()

    def parent(self, dish: np.ndarray) -> np.ndarray:
        """Probability of dishes in their class's restaurant."""
        c, n, w = self.dish_class[dish], self.n1[dish], self.dish_word[dish]
        t = np.minimum(self.high.t[dish], n)
        d, theta, a = DISCOUNT[1], STRENGTH[1], self.all
        return (n - d * t + (theta + d * a.class_t[c]) * a.root(self.n0[w], np.maximum(self.top.t[w], 1))) / (theta + a.class_n[c])

    def _opening2(self, cell: np.ndarray) -> np.ndarray:
        return (STRENGTH[2] + DISCOUNT[2] * self.all.context_t[self.cell_context[cell]]) * self.parent(self.cell_dish[cell])

    def _opening1(self, dish: np.ndarray) -> np.ndarray:
        w = self.dish_word[dish]
        return (STRENGTH[1] + DISCOUNT[1] * self.all.class_t[self.dish_class[dish]]) * self.all.root(self.n0[w], np.maximum(self.top.t[w], 1))

    def _opening0(self, word: np.ndarray) -> np.ndarray:
        return np.full(len(word), (STRENGTH[0] + DISCOUNT[0] * self.all.root_t) / (self.all.vocabulary + 1))

    def _law2(self, cell: np.ndarray) -> Law:
        dish, t, a = self.cell_dish[cell], self.low.t[cell], self.all
        c, w = self.dish_class[dish], self.dish_word[dish]
        rest = (STRENGTH[1] + DISCOUNT[1] * a.class_t[c]) * a.root(self.n0[w], np.maximum(self.top.t[w], 1))
        own = STRENGTH[2] + DISCOUNT[2] * (a.context_t[self.cell_context[cell]] - t)
        return Law(DISCOUNT[2], DISCOUNT[1], 1, own, self.n1[dish] - t, np.maximum(self.high.t[dish], 1), rest, STRENGTH[1] + a.class_n[c] - t)

    def _law1(self, dish: np.ndarray) -> Law:
        w, t, a = self.dish_word[dish], self.high.t[dish], self.all
        rest = np.full(len(dish), (STRENGTH[0] + DISCOUNT[0] * a.root_t) / (a.vocabulary + 1))
        own = STRENGTH[1] + DISCOUNT[1] * (a.class_t[self.dish_class[dish]] - t)
        return Law(DISCOUNT[1], DISCOUNT[0], 1, own, self.n0[w] - t, np.maximum(self.top.t[w], 1), rest, STRENGTH[0] + a.root_n - t)

    def _law0(self, word: np.ndarray) -> Law:
        none, a = np.zeros(len(word)), self.all
        return Law(DISCOUNT[0], 0.0, 0, STRENGTH[0] + DISCOUNT[0] * (a.root_t - self.top.t[word]), none, none, none + 1, none + a.vocabulary + 1)

    def _moved2(self, cell: np.ndarray, by: int) -> None:
        dish = self.cell_dish[cell]
        _add(self.all.context_t, self.cell_context[cell], by)
        _add(self.n1, dish, by)
        _add(self.all.class_n, self.dish_class[dish], by)

    def _moved1(self, dish: np.ndarray, by: int) -> None:
        _add(self.all.class_t, self.dish_class[dish], by)
        _add(self.n0, self.dish_word[dish], by)
        self.all.root_n += float(np.sum(np.broadcast_to(by, len(dish))))

    def _moved0(self, word: np.ndarray, by: int) -> None:
        self.all.root_t += float(np.sum(np.broadcast_to(by, len(word))))

    def run(self, sweeps: int) -> None:
        for _ in range(sweeps):
            self.low.sweep()
            self.high.bring(self.n1)
            self.high.sweep()
            self.top.bring(self.n0)
            for _ in range(ROOT_SWEEPS):
                self.top.sweep()

    def state(self) -> dict[str, np.ndarray]:
        """The seating: tables of dishes with more than one customer (r2: in rare contexts), and sizes of those of large dishes."""
        of, levels = len(self.low_count), ((2, self.low), (1, self.high), (0, self.top))
        out = {f"t{k}": s.t[s.n > 1].astype(U) for k, s in levels} | {f"size{k}": s.size.astype(U) for k, s in levels}
        return out | {"@2": self.low.t[:of][self.low_count > 1].astype(U), "@r": self.low.t[of:][self.rare_count > 1].astype(U)}


def seated(k: int, totals: Totals, classes: np.ndarray, buckets: int) -> Callable:
    """STATE rows, each with the REPLY rows of its rare contexts, to STATE rows with the next seating (and the numbers of tables
    of all seatings before), and their TOTALS and LINKS."""

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rows in by_part(batches):
            yield one(part, unpack(next(rows).data), _joined([unpack(r.data) for r in rows]))

    def one(part: int, x: dict, rare: dict) -> pd.DataFrame:
        x = {"rare_n": rare.pop("n", None), **x} if k == 1 else x | {f"rt@{k - 1}": rare["t"]}
        b = Bucket(x, classes)
        b.seat(np.random.default_rng((SEED, k, part)), totals.own(x["rare_n"], rare["t"]), x)
        b.run(SWEEPS + (BURN_IN if k == 1 else 0))
        now, of = b.state(), len(b.low_count)
        t2, r2 = now.pop("@2"), now.pop("@r")
        past = {c: v for c, v in x.items() if "@" in c} | {f"t2@{k}": t2, f"r2@{k}": r2, f"t1@{k}": now["t1"], f"t0@{k}": now["t0"]}
        return _frame([(part, STATE, k, pack(**b.static, **past, **(now if k < ROUNDS else {}))), b.totals(b.low.t[:of], b.high.t, b.top.t, part, None, b.low.t[of:]), *b.links(part, buckets, t=b.low.t[of:])])

    return rounds


class Predictive:
    """Averaged predictive probabilities of a bucket's words in any context."""

    def __init__(self, state: dict[str, np.ndarray], samples: list[Totals], classes: np.ndarray, last: np.ndarray | None = None):
        """last: tables of the rare contexts in the last sample, without which words after them cannot be judged."""
        b = self.b = Bucket(state, classes)
        self.classes, self.samples = classes, []
        order = np.r_[np.flatnonzero(b.frequent), np.flatnonzero(b.at > 0)]
        key = (b.word.astype(U) << WORD | b.context.astype(U) << CONTEXT | b.at.astype(U))[order]
        by_key = np.argsort(key)
        self.cell_key = key[by_key]
        self.cells, self.dishes, self.words = [], [], []
        for k, a in enumerate(samples, 1):
            rare_t = state.get(f"rt@{k}", last)
            a = a.own(*((state["rare_n"], rare_t) if rare_t is not None else (np.zeros(len(b.ids)), np.zeros(len(b.ids)))))
            self.samples.append(a)
            tables = lambda n, level: _tables(n, state[f"t{level}@{k}"])  # noqa: B023, E731
            t2 = np.r_[tables(b.low_count, 2), _tables(b.rare_count, state[f"r2@{k}"])]
            n1 = b.customers(1, t2)
            t1 = tables(n1, 1)
            n0 = b.customers(0, t1)
            word = a.root(n0.astype(float), tables(n0, 0).astype(float))
            dish = (n1 - DISCOUNT[1] * t1) / (STRENGTH[1] + a.class_n[b.dish_class]) + a.left_by(1, b.dish_class) * word[b.dish_word]
            own = (b.cell_count - DISCOUNT[2] * t2) / (STRENGTH[2] + a.context_n[b.cell_context])
            self.words.append(word)
            self.dishes.append(dish)
            self.cells.append((own + a.left_by(2, b.cell_context) * dish[b.cell_dish])[by_key])
        self.counts = np.bincount(b.word, b.count, minlength=len(b.words)).astype(np.int64)

    def probability(self, words: np.ndarray, context: np.ndarray, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of words (hashes) after contexts (rare: ids of the rare ones, 0 for none); and the words' training counts."""
        b = self.b
        word, known = _found(b.words, words)
        frequent = context < FREQUENT
        in_class = np.where(frequent, self.classes[np.minimum(context, FREQUENT - 1)], context.astype(np.int64) - FREQUENT)
        at, has = _found(b.ids, np.zeros(len(words), U) if rare is None else rare)
        at = np.where(has, at + 1, 0)
        own = np.where(frequent, context.astype(np.int64), FREQUENT - 1 + at)
        frequent = frequent | has
        cell, is_cell = _found(self.cell_key, word.astype(U) << WORD | context.astype(U) << CONTEXT | at.astype(U))
        dish, is_dish = _found(b.dish_key, word.astype(U) << U(12) | in_class.astype(U))
        is_cell, is_dish = is_cell & known & frequent, is_dish & known
        p = np.zeros(len(words))
        pick = lambda values, at, where: np.where(where, values[at], 0.0) if len(values) else np.zeros(len(at))
        for a, cells, dishes, word_p in zip(self.samples, self.cells, self.dishes, self.words, strict=True):
            root = np.where(known, pick(word_p, word, known), a.root(np.zeros(1), np.zeros(1)))
            up = np.where(is_dish, pick(dishes, dish, is_dish), a.left_by(1, in_class) * root)
            up = np.where(frequent, a.left_by(2, np.where(frequent, own, 0)) * up, up)
            p += np.where(is_cell, pick(cells, cell, is_cell), up)
        return p / len(self.samples), pick(self.counts, word, known)


def _tables(n: np.ndarray, t: np.ndarray) -> np.ndarray:
    tables = np.ones(len(n), np.int64)
    tables[n > 1] = t.astype(np.int64)
    return tables


def _found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


PARTIAL = "chunk long, kind int, data binary"


def judged(samples: list[Totals], classes: np.ndarray) -> Callable:
    """Rows of a bucket (its STATE, then OCCURRENCES) to the sums of its words over the documents of each batch; IDS rows are
    passed on. A bucket without STATE has no word of a training text."""
    tokens, vocabulary = samples[0].tokens, samples[0].vocabulary
    below = math.log10(tokens + 0.1 * (vocabulary + 1))
    nothing = {"words": np.zeros(0, U), "sizes": np.zeros(0, np.uint32), "contexts": np.zeros(0, np.uint16), "n": np.zeros(0, U), "rare_n": np.zeros(0, U)} | {f"r2@{k}": np.zeros(0, U) for k in range(1, len(samples) + 1)} | {f"t{level}@{k}": np.zeros(0, U) for level in range(3) for k in range(1, len(samples) + 1)}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in by_part(batches):
            model, state, replied, out, held = None, None, [], [], 0
            for r in rows:
                if r.kind == IDS:
                    out.append((r.no, IDS, r.data))
                    continue
                x = unpack(r.data)
                if r.kind == STATE:
                    state = x
                    continue
                if r.kind == REPLY:
                    replied.append(x)
                    continue
                model = model or Predictive(state or nothing, samples, classes, _joined(replied)["t"])
                p, count = model.probability(np.repeat(x["words"].cumsum(dtype=U), x["sizes"]), x["contexts"], spread(x))
                has = np.bincount(x["docs"]) > 0
                docs, at = np.flatnonzero(has).astype(np.uint32), (has.cumsum() - 1)[x["docs"]]
                times = x["n"]
                fixed = lambda v: np.rint(np.bincount(at, np.repeat(v, times)) * UNIT).astype(np.int64)  # noqa: B023, E731
                known = np.bincount(at, np.repeat(count > 0, times)).astype(np.uint32)
                out.append((r.no, OCCURRENCES, pack(docs=np.diff(docs, prepend=np.uint32(0)), known=known, base=fixed(below - np.log10(count + 0.1)), score=-fixed(np.log10(p)))))
                held += len(r.data)
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=["chunk", "kind", "data"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["chunk", "kind", "data"])

    return judge


SUMS = "id long, n_tokens long, n_known long, base_score double, score double"


def added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document of each batch from its sums over all buckets, which are added as they come."""
    ids: dict[int, list] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for r in b.itertuples():
            x = unpack(r.data)
            if r.kind == IDS:
                held = ids.setdefault(r.chunk, [x["ids"], np.zeros(len(x["ids"]), np.int64)])
                held[1] += x["n"]
                continue
            docs = x["docs"].cumsum(dtype=np.int64)
            s = sums.get(r.chunk, np.zeros((3, 0), np.int64))
            if docs[-1] >= s.shape[1]:
                s = np.concatenate([s, np.zeros((3, int(docs[-1]) + 1 - s.shape[1]), np.int64)], axis=1)
            for k, c in enumerate(("known", "base", "score")):
                s[k, docs] += x[c].astype(np.int64)
            sums[r.chunk] = s
    for chunk, (own, n) in ids.items():
        s = sums.pop(chunk)
        yield pd.DataFrame({"id": own, "n_tokens": n, "n_known": s[0], "base_score": -s[1] / UNIT, "score": -s[2] / UNIT})


class Model(NamedTuple):
    """A trained model: the frequent words and their classes, the buckets' last STATE rows with the tables of all samples, REPLY
    rows with the tables of rare contexts in the last, the totals of each sample, and the tokens of each bucket."""

    buckets: int
    frequent: np.ndarray
    classes: np.ndarray
    states: DataFrame
    rare: DataFrame
    samples: list[Totals]
    sizes: dict[int, float]


def _all_totals(made: DataFrame) -> dict[str, np.ndarray]:
    """The buckets' TOTALS rows added up: vectors of bounded lengths, whatever the data's size."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for raw in b["data"]:
                for k, v in unpack(raw).items():
                    total[k] = total.get(k, 0) + v.astype(np.int64)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"vector": k, "at": at, "value": v[at]})

    rows = made.where(F.col("kind") == TOTALS).select("data").mapInPandas(listed, "vector string, at int, value long").groupBy("vector", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {k: np.zeros(n) for k, n in (("context_t", FREQUENT), ("class_n", CLASSES), ("class_t", CLASSES), ("class_more", CLASSES), ("sums", 4), ("counts", FREQUENT))}
    for k, g in rows.groupby("vector"):
        out[k][g["at"].to_numpy()] = g["value"].to_numpy()
    return out


def train(rows: DataFrame, buckets: int) -> Model:
    """The model of rows (id, training, text); buckets must grow with the data."""
    frequent, classes = frequent_words(rows, buckets)
    made = materialise(placed(dealt(rows, buckets, frequent), buckets).mapInPandas(tidy(merged(classes, buckets)), ROWS), "py-counts")
    sums = _all_totals(made)
    context_n = sums["counts"]
    sizes = {r.part: float(r.no) for r in made.where(F.col("kind") == TOTALS).select("part", "no").collect()}
    samples: list[Totals] = []
    for k in range(1, ROUNDS + 2):
        root_n, root_t, vocabulary, tokens = sums["sums"]
        totals = Totals(context_n, sums["context_t"], sums["class_n"], sums["class_t"], float(root_n), float(root_t), int(vocabulary), int(tokens), sums["class_more"])
        if k > 1:
            samples.append(totals)
        if k > ROUNDS:
            break
        known = made.where(F.col("kind") == STATE).unionByName(replies(made, buckets))
        made = materialise(placed(known, buckets).mapInPandas(tidy(seated(k, totals, classes, buckets)), ROWS), "py-seats")
        sums = _all_totals(made)
    return Model(buckets, frequent, classes, made.where(F.col("kind") == STATE), replies(made, buckets), samples, sizes)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", training: str = "training", buckets: int | None = None) -> DataFrame:
    """One row per key: n_tokens (words and the end), n_known (of them seen in training), train_tokens (of the whole
    corpus), base_score (add-0.1 unigrams) and score (the model's), both log10 probabilities of the whole text, and
    perplexity, per token. docs needs an integer key, a text and the flag of training rows.

    Null or empty text: the end alone. Null flag: not training. Rows that repeat a key count as one document: their texts'
    scores add up. A null key is a key of its own. No training rows: every word is unknown and all words are alike. Empty
    table: empty result. Other columns are ignored."""
    low = -(1 << 62)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(training), F.lit(False)).alias("training"), F.col(text).alias("text"))
    buckets = buckets or 4 * max(8, input_partitions(rows))
    model = train(rows, buckets)
    # a bucket with many occurrences goes to several tasks
    mean = max(1.0, sum(model.sizes.values()) / buckets)
    offsets = np.r_[0, np.cumsum([max(1, round(model.sizes.get(k, 0.0) / mean)) for k in range(buckets)])]
    where = docs.sparkSession.createDataFrame([(k, int(offsets[k]), int(offsets[k + 1]) - 1) for k in range(buckets)], "part int, first int, last int")
    known = model.states.unionByName(model.rare).join(F.broadcast(where), "part").select(F.explode(F.sequence("first", "last")).alias("part"), "kind", "no", "data")
    found = placed(known.unionByName(dealt(rows, buckets, model.frequent, offsets)), int(offsets[-1])).mapInPandas(tidy(judged(model.samples, model.classes)), PARTIAL)
    out = found.repartition(buckets, "chunk").mapInPandas(added_up, SUMS).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select(F.when(F.col("id") != low, F.col("id")).alias(key), "n_tokens", "n_known", F.lit(model.samples[0].tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(10.0, -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1(spark, sf_dir):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("training")))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op1_pitman_yor": op1}
