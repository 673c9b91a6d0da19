"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import materialise, read, words

#: Buckets of seeded order within a size tier: the grain of a selection, and the bound of what one task holds.
BUCKETS = 1024
#: Distinct membership patterns that the driver's flow problem may have.
MAX_PATTERNS = 100_000
#: Patterns up to which the table of cuts (at most 64 rows each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_PATTERNS = 2_000
SHARE, CAP, SEED = 1.5, 2, 17


def cycled_weights(sources: Sequence[str | None]) -> dict[str | None, float]:
    """Weights 3, 1, 2, repeating, for the sources by code point with null last."""
    ranked = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float((3, 1, 2)[i % 3]) for i, s in enumerate(ranked)}


def quotas(sizes: dict, weights: dict, share: float = SHARE, cap: float = CAP) -> dict:
    """Each source's target: share * all sizes by weight; no target is above cap * its source's size, and what is over
    is shared out again by weight among the others until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > cap * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / weight for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def route(patterns: dict[tuple, int], targets: dict, repeats: int = CAP) -> dict[tuple, float]:
    """Min-cost flow: capacity of each pattern (a tuple of sources, with the tokens of its documents) to source quotas,
    where the k-th copy of a token costs k - 1. As costs stand on the arcs into patterns alone, the cheapest flow is
    found by augmenting with first copies only, then with second copies as well, and so on. Returns tokens by pattern."""
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0.0) for p in patterns}
    need = dict(targets)
    members: dict = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    for copies in range(1, repeats + 1):
        room = {p: copies * n - sum(flow[p].values()) for p, n in patterns.items()}
        while True:
            came: dict = {p: None for p in patterns if room[p] > 1e-6}
            todo, found, end = deque(came), False, None  # a source may be None
            while todo and not found:
                p = todo.popleft()
                for s in p:
                    if ("s", s) in came:
                        continue
                    came["s", s] = p
                    if need.get(s, 0.0) > 1e-6:
                        found, end = True, s
                        break
                    for q in members[s]:
                        if q not in came and flow[q][s] > 1e-6:
                            came[q] = ("s", s)
                            todo.append(q)
            if not found:
                break
            path, node = [], ("s", end)
            while node is not None:
                path.append(node)
                node = came[node]
            most = min([need[end], room[path[-1]], *(flow[path[i - 1]][path[i][1]] for i in range(2, len(path), 2))])
            for i in range(0, len(path), 2):
                s, p = path[i][1], path[i + 1]
                flow[p][s] += most
                if i + 2 < len(path):
                    flow[p][path[i + 2][1]] -= most
            need[end] -= most
            room[path[-1]] -= most
    return {p: sum(f.values()) for p, f in flow.items()}


def _cuts(table: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each pattern and size tier the bucket below which documents are taken once more than the others. Tiers go
    from large to small documents, and what a tier misses or takes too much is made up by the next."""

    def choose(b: pd.DataFrame) -> pd.DataFrame:
        rows, carry, share = [], 0.0, shares[b["pattern"].iloc[0]]
        for tier, t in sorted(b.groupby("tier"), reverse=True):
            t = t.sort_values("bucket")
            quota = share * t["size"].sum() + carry
            ends = [0, *t["size"].cumsum()]
            k = min(range(len(ends)), key=lambda i: (abs(ends[i] - quota), i))
            rows.append((b["pattern"].iloc[0], tier, int(t["bucket"].iloc[k]) if k < len(t) else BUCKETS))
            carry = quota - ends[k]
        return pd.DataFrame(rows, columns=["pattern", "tier", "cut"])

    return table.groupBy("pattern").applyInPandas(choose, "pattern string, tier int, cut int")


def mix(docs: DataFrame, size: Column, sources: Column, key: Sequence[str] = ("doc_id",), weights: Callable = cycled_weights, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs with size, source_size (of its first source), target (its first source's), repeats and taken = repeats *
    size. `sources` is the array of the sources that a document belongs to; a null element is a source of its own.

    Sizes are summed by membership pattern and source, the flow gives each pattern's tokens, and documents are taken
    whole in an order seeded by key, so reruns agree. No document is taken more than cap times. Repeated rows and ties
    in the order are taken alike. Empty texts have size 0 and take 0 words; repeats is 0 for them. An empty table gives
    an empty result. Columns of docs that bear a computed name are replaced."""
    own = ["size", "source_size", "target", "repeats", "taken"]
    order = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.lit(BUCKETS)).cast("int")
    sized = docs.select("*", F.explode(F.array(F.struct(size.cast("long").alias("size"), F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"}).alias("pattern"), F.to_json(F.slice(sources, 1, 1)).alias("first"), order.alias("bucket")))).alias("__m"))
    tier = F.when(F.col("__m.size") > 0, F.floor(F.log2(F.col("__m.size").cast("double"))).cast("int"))
    sized = sized.withColumn("__tier", tier)
    table = materialise(sized.groupBy(F.col("__m.pattern").alias("pattern"), F.col("__m.first").alias("first"), F.col("__tier").alias("tier"), F.col("__m.bucket").alias("bucket")).agg(F.sum("__m.size").alias("size")), "mix")
    found = table.groupBy("pattern", "first").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns, by_source = {}, {}
    for r in found:
        p = tuple(json.loads(r["pattern"]))
        patterns[p] = patterns.get(p, 0) + r["n"]
    for p, n in patterns.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    targets = quotas(by_source, weights(list(by_source)), share, cap)
    flow = route(patterns, targets, cap)
    keys = {r["pattern"]: tuple(json.loads(r["pattern"])) for r in found}
    base = {k: int(flow[p] // patterns[p]) if patterns[p] else 0 for k, p in keys.items()}
    shares = {k: (flow[p] / patterns[p] - base[k]) if patterns[p] else 0.0 for k, p in keys.items()}
    spark = docs.sparkSession
    cuts = _cuts(table.where(F.col("tier").isNotNull()).groupBy("pattern", "tier", "bucket").agg(F.sum("size").alias("size")), shares)
    pattern_rows = spark.createDataFrame([(k, b) for k, b in base.items()], "pattern string, base int")
    source_rows = spark.createDataFrame([(json.dumps([s], ensure_ascii=False, separators=(",", ":")), int(by_source[s]), float(targets[s])) for s in by_source], "first string, source_size long, target double")
    cuts = pattern_rows.join(cuts, "pattern")
    if len(found) <= BROADCAST_PATTERNS:
        cuts, source_rows = F.broadcast(cuts), F.broadcast(source_rows)
    rest = sized.drop(*own).withColumns({"pattern": F.col("__m.pattern"), "first": F.col("__m.first"), "tier": F.col("__tier")}) if not {"pattern", "first", "tier", "base", "cut"} & set(docs.columns) else None
    if rest is None:  # names that the joins use: set the others aside
        aside = {c: f"__own_{c}" for c in ("pattern", "first", "tier", "base", "cut") if c in docs.columns}
        return mix(docs.withColumnsRenamed(aside), size, sources, key, weights, share, cap, seed).withColumnsRenamed({v: k for k, v in aside.items()})
    out = rest.join(cuts, ["pattern", "tier"], "left").join(source_rows, "first", "left")
    repeats = F.when(F.col("__m.size") > 0, F.coalesce(F.col("base") + (F.col("__m.bucket") < F.col("cut")).cast("int"), F.lit(0))).otherwise(0)
    return out.withColumns({"size": F.col("__m.size"), "repeats": repeats, "taken": F.col("__m.size") * repeats}).drop("pattern", "first", "tier", "base", "cut", "__m", "__tier")


def documents_mix(docs: DataFrame) -> DataFrame:
    """mix() for the columns of documents: a document's only source is `source`, its size the words of its text."""
    return mix(docs, F.size(words(F.col("text"))), F.array("source"))


def op4(spark, sf_dir):
    counted = materialise(read(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).alias("n_words")), "op4")
    return mix(counted, F.col("n_words"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_source_mix": op4}
