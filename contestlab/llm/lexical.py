"""Ranked lexical search over a length-stratified index: documents with the same length normaliser form a stratum, postings
lie by term frequency within it, and bounds of whole strata tell which of them a query visits, and in which order."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlab.llm.common import TERM_BYTES, materialise, read, term_lists, tidy, translated

K = 50
#: Length part of the normaliser m = 100 - LENGTH_PART + (LENGTH_PART * n * N) div L, and its factor beside 1000 * tf.
LENGTH_PART, SATURATION = 50, 20
#: A segment of the index holds so many bytes of text or documents (one document at least); one task searches it at once.
SEGMENT_BYTES, SEGMENT_DOCS = 1 << 24, 1 << 16
#: Pairs of query and term that are sought together; more are taken in blocks.
QUERY_TERMS = 100_000

INDEX = "segment string, term string, n int, docs array<int>, tfs array<int>, ids array<bigint>, norms array<bigint>"


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: documents that have a term, and terms in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, term_lists(raw))) for raw in translated(b[0], TERM_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], names=["docs", "terms"])

    r = docs.select(text).mapInArrow(tidy(count), "docs long, terms long").agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    return r["n"] or 0, r["l"] or 0


class Segment:
    """Postings of the documents that a task has read since its last segment."""

    def __init__(self, normaliser: Callable[[int], int]):
        self.normaliser, self.number, self.bytes = normaliser, defaultdict(itertools.count().__next__), 0
        self.ids, self.norms, self.distinct, self.terms, self.tfs = [], [], [], [], []

    def add(self, key: int | None, raw: memoryview) -> None:
        seen: Counter = Counter()
        for part in term_lists(raw):
            seen.update(part)
        if seen:
            self.ids.append(key)
            self.norms.append(self.normaliser(sum(seen.values())))
            self.distinct.append(len(seen))
            self.terms.append(np.fromiter(map(self.number.__getitem__, seen), np.int32, len(seen)))
            self.tfs.append(np.fromiter(seen.values(), np.int32, len(seen)))
            self.bytes += len(raw)

    def rows(self, name: str) -> pa.RecordBatch:
        """A row that lists the documents by stratum and key, then a row for each term, in order: its documents by stratum, term
        frequency and number."""
        ids, norms = np.array([k if k is not None else 0 for k in self.ids], np.int64), np.array(self.norms, np.int64)
        null = np.array([k is None for k in self.ids])
        by = np.lexsort((ids, null, norms))
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        ids, null, norms = ids[by], null[by], norms[by]
        stratum = np.cumsum(np.diff(norms, prepend=norms[0]) != 0)
        names = sorted(self.number)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter(map(self.number.__getitem__, names), np.int32, len(names))] = np.arange(len(names), dtype=np.int32)
        doc, term, tf = np.repeat(place, self.distinct), rank[np.concatenate(self.terms)], np.concatenate(self.tfs)
        order = np.lexsort((doc, tf, stratum[doc], term))
        n = np.bincount(term, minlength=len(names))
        ends = pa.array(np.concatenate([[0, 0], np.cumsum(n)]), pa.int32())
        head = pa.array([0] + [len(ids)] * (len(names) + 1), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (len(names) + 1)), pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(names, pa.binary()).cast(pa.string())]), pa.array(np.concatenate([[len(ids)], n]), pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(doc[order])), pa.ListArray.from_arrays(ends, pa.array(tf[order])), pa.ListArray.from_arrays(head, pa.array(ids, mask=null)), pa.ListArray.from_arrays(head, pa.array(norms)),
        ], names=["segment", "term", "n", "docs", "tfs", "ids", "norms"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", size: tuple[int, int] | None = None) -> DataFrame:
    """The index of all documents and all their terms, written to the shared folder: segments of the documents that a task
    read together, each with its documents in strata of equal m and its postings. No posting is shuffled. `size` is N and L of
    corpus_size(). key must be integral; documents without terms are in no stratum."""
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    n_docs, n_terms = size or corpus_size(docs, "t")

    def normaliser(n: int) -> int:
        return 100 - LENGTH_PART + LENGTH_PART * n * n_docs // n_terms

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, now = TaskContext.get().partitionId(), itertools.count(), Segment(normaliser)
        for b in batches:
            for k, raw in zip(b[0].to_pylist(), translated(b[1], TERM_BYTES), strict=True):
                now.add(k, raw)
                if now.bytes >= SEGMENT_BYTES or len(now.ids) >= SEGMENT_DOCS:
                    yield now.rows(f"{part}-{next(made)}")
                    now = Segment(normaliser)
        if now.ids:
            yield now.rows(f"{part}-{next(made)}")

    return materialise(docs.mapInArrow(tidy(build), INDEX), "index")


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """query (the number of a row of queries), its key and its distinct terms, once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted({t for part in term_lists(raw) for t in part}) for raw in translated(b["t"], TERM_BYTES)]
            at = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            flat = pa.array([t for ts in terms for t in ts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b["query"].take(pa.array(at)), b["item"].take(pa.array(at)), flat], names=["query", "item", "term"])

    kind = queries.schema[key].dataType.simpleString()
    numbered = materialise(queries.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("item"), F.col(text).alias("t")), "queries")
    return materialise(numbered.mapInArrow(tidy(cut), f"query long, item {kind}, term string"), "query-terms")


class Searcher:
    """One segment with the postings of the sought terms; impacts are worked out once for each term frequency of a stratum."""

    def __init__(self, table: pa.Table):
        head = table.filter(pa.compute.is_null(table["term"])).slice(0, 1).combine_chunks()
        rest = table.filter(pa.compute.is_valid(table["term"])).combine_chunks()
        ids = head["ids"].combine_chunks().flatten()
        self.null, self.ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        norms = head["norms"].combine_chunks().flatten().to_numpy()
        first = np.flatnonzero(np.diff(norms, prepend=norms[0] - 1)) if len(norms) else np.zeros(0, np.int64)
        self.m, self.count = norms[first], len(first)
        stratum = np.repeat(np.arange(len(first)), np.diff([*first, len(norms)]))
        n = rest["n"].to_numpy()
        self.doc, tf = (rest[c].combine_chunks().flatten().to_numpy() for c in ("docs", "tfs"))
        self.at = {x: k for k, x in enumerate(rest["term"].to_pylist())}
        if not self.at:  # none of the terms is in this segment
            return
        s, term = stratum[self.doc], np.repeat(np.arange(len(n)), n)
        run = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
        t = tf[run].astype(np.int64)
        once = 1_000_000_000 * t // (1000 * t + SATURATION * self.m[s[run]])  # no term's weight yet
        self.impact = np.repeat(once, np.diff([*run, len(tf)]))
        # term frequencies rise within a stratum and impacts with them: the last run's is the stratum's largest
        cell = np.flatnonzero(np.diff(term * self.count + s, prepend=-1))
        self.start = np.zeros((len(n), self.count + 1), np.int64)
        lengths = np.zeros((len(n), self.count), np.int64)
        lengths[term[cell], s[cell]] = np.diff([*cell, len(tf)])
        self.start[:, 1:] = np.cumsum(lengths, axis=1)
        self.start += np.concatenate([[0], np.cumsum(n)[:-1]])[:, None]
        self.most = np.zeros((len(n), self.count), np.int64)
        ends = np.append(cell[1:], len(tf)) - 1
        self.most[term[cell], s[cell]] = self.impact[ends]

    def top(self, terms: list[tuple[str, int]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the segment) and scores of the k best for terms with their weights, of those that reach `least`:
        strata are visited by falling bound, more at a time, until no bound reaches the k-th score."""
        found = [(self.at[t], w) for t, w in terms if t in self.at and w > 0]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not found:
            return docs, scores
        rows, weights = np.array([t for t, _ in found]), np.array([w for _, w in found], np.int64)
        bound = (self.most[rows] * weights[:, None]).sum(axis=0)
        order = np.argsort(-bound, kind="stable")
        i, step = 0, 4
        while i < len(order) and bound[order[i]] >= least:
            visit = order[i : i + step]
            visit = visit[bound[visit] >= least]
            i, step = i + step, step * 2
            a, b = self.start[rows[:, None], visit[None, :]].ravel(), self.start[rows[:, None], visit[None, :] + 1].ravel()
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            d, back = np.unique(self.doc[at], return_inverse=True)
            got = np.zeros(len(d), np.int64)
            np.add.at(got, back, self.impact[at] * np.repeat(np.repeat(weights, len(visit)), n))
            good = got >= least
            docs, scores = np.concatenate([docs, d[good]]), np.concatenate([scores, got[good]])
            if len(docs) > k:
                keep = np.lexsort((self.ids[docs], self.null[docs], -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                least = max(least, int(scores.min()))
        return docs, scores


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sought(index: DataFrame, terms: list[tuple], n_docs: int, k: int) -> DataFrame:
    """query, rank, doc, score for a block of queries: (query, term) pairs."""
    spark = index.sparkSession
    names = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for _, t in terms})], "term string"))  # at most QUERY_TERMS rows
    postings = index.join(names, "term", "left_semi")
    df = {r["term"]: r["df"] for r in postings.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    by_query: dict[int, list] = defaultdict(list)
    for q, t in terms:
        if t in weight:
            by_query[q].append((t, weight[t]))
    by_query = dict(by_query)

    def search(least: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
        def one(table: pa.Table) -> pa.Table:
            s, out = Searcher(table), []
            for q, wanted in by_query.items():
                docs, scores = s.top(wanted, k, max(1, least.get(q, 1)))
                out.append((np.full(len(docs), q, np.int64), docs, scores))
            q, docs, scores = (np.concatenate([o[j] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for j in range(3))
            return pa.table({"query": q, "doc": pa.array(s.ids[docs], mask=s.null[docs]), "score": scores})

        return one

    part = index.where("term is null").unionByName(postings).select("segment", "term", "n", "docs", "tfs", "ids", "norms")
    hits = "query long, doc long, score long"
    first = index.where("term is null").agg(F.max_by("segment", "n")).first()[0]
    # the k-th score of one segment is no higher than that of all: the others need not offer what is below it
    lead = part.where(F.col("segment") == first).groupBy("segment").applyInArrow(search({}), hits)
    least = {r["query"]: r["s"] for r in lead.groupBy("query").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") == k).collect()}
    return _best(part.groupBy("segment").applyInArrow(search(least), hits), k)


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", k: int = K, index: DataFrame | None = None, block: int = QUERY_TERMS) -> DataFrame:
    """query_key, rank, key and score of the k best documents with a score above 0 for each row of queries.

    A query's terms count once. All documents are searched: in each segment a query adds up impacts (weight and saturated
    term frequency over the document's normaliser) stratum by stratum in the order of the strata's bounds, and stops where no bound
    reaches its k-th score, so that what it skips can't be among the best. Arithmetic is in integers but for the logarithm.

    Null or wordless texts are found by nothing, and such queries find nothing. Equal scores go by ascending key, nulls last;
    repeated rows, of documents or queries, are rows of their own. A document or query may be of any length. No documents or no
    queries: empty result. Other columns are not looked at. Queries are taken in blocks, each against the whole index."""
    spark = docs.sparkSession
    kind = queries.schema[query_key].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{query_key}` {kind}, rank int, `{key}` long, score long")
    size = corpus_size(docs, text)
    terms = query_terms(queries, query_key, query_text)
    pairs = terms.count()
    if not size[0] or not pairs:
        return empty
    index = build_index(docs, key, text, size) if index is None else index
    blocks, out = -(-pairs // block), empty
    for i in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        asked = [(r["query"], r["term"]) for r in mine.select("query", "term").collect()]
        if asked:
            found = _sought(index, asked, size[0], k).join(mine.select("query", "item").distinct(), "query")
            out = out.unionByName(found.select(F.col("item").alias(query_key), "rank", F.col("doc").alias(key), "score"))
    return out


def op13(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""with d as materialized (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
q as materialized (select i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) x from (select row_number() over () i, * from benchmark)),
c as (select count(*) n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
p as materialized (select r, x, count(*) tf from (select r, unnest(w) x from d) where x in (select x from q) group by r, x),
t as (select x, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint w from p, c group by x, n_docs),
m as (select r, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms m from d, c where len(w) > 0),
s as (select i, item_id, r, doc_id, sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score from q join p using (x) join t using (x) join m using (r) group by i, item_id, r, doc_id),
k as (select item_id, row_number() over (partition by i order by score desc, doc_id nulls last)::int rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50"""

QUERIES = {"op13_lexical_search": op13}
ORACLES = {"op13_lexical_search": SQL}
