"""N-gram Jaccard join by multiple-global-order filtering.

Each document is the set of its distinct word shingles. Equal sets are one class. Two sets that reach the threshold share a
token among the first of each under ANY global token order, so a candidate must share prefix tokens under several orders.
Every order here begins with the tokens that no other set holds: they fill the prefix of most sets, which then can have
no partner at all and leave before any pair is made; nor can tokens of one set alone count towards an overlap, so
candidates are verified exactly on the shared tokens and the sets' sizes.

Only one bucket's tokens, packed into few bytes each, meet in a task; no list of a token's sets is paired with itself.
First each list is linked to the set nearest to its core; then, lists whose sets lie in several components pair the sets
outside of the largest component with the rest, so that no link is lost that could join two components. All links then lie
inside of components: to count them, blocks of a component's sets meet, and every pair of two blocks is verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import LOWER_BYTES, Listing, by_listing, free_name, input_partitions, materialise, planes, read, salted_join, tidy, unplanes

#: Tokens that a task gathers before it deals them out.
CHUNK = 1_200_000
#: Prefix tokens before a place that are kept with it, to tell that a pair was made at one of them.
EARLIER = 4
#: Sets and tokens of one block of a component, and pairs of sets that hold a token from which on they are counted by
#: matrix product.
BLOCK_SETS, BLOCK_TOKENS, DENSE = 512, 400_000, 1024
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOW = -(1 << 62)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt)) * M1
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(27))


class Hasher:
    """64-bit hashes of words, worked out once for each distinct word of a task while they are few."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        if len(self.known) > 150_000:
            self.known.clear()
        got = list(map(self.known.get, tokens))
        if None in got:
            for w in {t for t, k in zip(tokens, got, strict=True) if k is None}:
                self.known[w] = xxhash.xxh3_64_intdigest(w)
            got = list(map(self.known.get, tokens))
        return np.array(got, np.uint64)

    def shingles(self, text: str | None, width: int) -> np.ndarray:
        """Sorted distinct hashes of the text's `width`-word shingles; of fewer words the whole sequence as one."""
        w = self.words(text)
        if not len(w):
            return w
        if len(w) < width:
            h = np.array([len(w)], np.uint64)
            for x in w:
                h = mixed(h ^ x, 1)
            return h
        h = mixed(w[: len(w) - width + 1], 2)
        for k in range(1, width):
            h = mixed(h ^ w[k : len(w) - width + 1 + k], 2)
        return np.unique(h)


def starts_of(buckets: int) -> np.ndarray:
    """The first token of each bucket: tokens are dealt out by their size, evenly, as they are hashes."""
    return np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)


PARTS = "part int, kind int, ids binary, sids binary, sizes binary, counts binary, tokens binary, sets binary"
NAMES = [f.split()[0] for f in PARTS.split(", ")]


def _row(part: int, kind: int, **x: np.ndarray) -> tuple:
    return (part, kind, *[planes(x[n]) if n in x else b"" for n in NAMES[2:]])


def _dealt(buckets: int, width: int):
    """Documents to rows of kind 0 (ids, their sets' hashes and sizes) and kind 1 (one bucket's tokens of a chunk of sets,
    sorted, as differences; `sets` is the place in the row's table of set hashes)."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, ids, sids, sizes, sets, held = Hasher(), [], [], [], {}, 0

        def out() -> pd.DataFrame:
            rows = [_row(sids[0] % buckets, 0, ids=np.array(ids, np.int64), sids=np.array(sids, np.uint64), sizes=np.array(sizes, np.uint32))]
            if sets:
                own, lengths = np.array(list(sets), np.uint64), np.array([len(x) for x in sets.values()])
                token = np.concatenate(list(sets.values()))
                order = np.argsort(token, kind="stable")
                token, owner = token[order], np.repeat(np.arange(len(own), dtype=np.uint32), lengths)[order]
                cuts = np.searchsorted(token, starts_of(buckets))
                for k in range(buckets):
                    a, z = cuts[k], cuts[k + 1] if k + 1 < buckets else len(token)
                    if z > a:
                        here = np.unique(owner[a:z])
                        at = np.searchsorted(here, owner[a:z]).astype(np.uint32)
                        rows.append(_row(k, 1, sids=own[here], sizes=lengths[here].astype(np.uint32), tokens=np.diff(token[a:z], prepend=np.uint64(0)), sets=at))
            return pd.DataFrame(rows, columns=NAMES)

        for b in batches:
            for i, text in zip(b["id"], b["text"], strict=True):
                s = hasher.shingles(text, width)
                sid = xxhash.xxh3_64_intdigest(s.tobytes())
                ids.append(i)
                sids.append(sid)
                sizes.append(len(s))
                if len(s) and sid not in sets:
                    sets[sid] = s
                    held += len(s)
                if held > CHUNK or len(ids) >= 100_000:
                    yield out()
                    ids, sids, sizes, sets, held = [], [], [], {}, 0
        if ids:
            yield out()

    return deal


def _shared(groups: int, buckets: int):
    """Rows of one bucket to rows by set: its tokens that at least two sets hold, and how many do (`ids`)."""

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            plain = b["kind"] == 0
            if plain.any():
                yield b[plain]
            for r in b[~plain].itertuples():
                held.setdefault(r.part, []).append((r.sids, r.sizes, r.tokens, r.sets))
        for bucket in list(held):
            token, sid, size = [], [], []
            for sids, sizes, tokens, sets in held.pop(bucket):
                at = unplanes(sets, np.uint32)
                token.append(unplanes(tokens, np.uint64).cumsum(dtype=np.uint64))
                sid.append(unplanes(sids, np.uint64)[at])
                size.append(unplanes(sizes, np.uint32)[at])
            token, sid, size = np.concatenate(token), np.concatenate(sid), np.concatenate(size)
            order = np.argsort(token)
            same = np.diff(token[order]) == 0
            order = order[np.r_[False, same] | np.r_[same, False]]
            token, sid, size = token[order], sid[order], size[order]
            order = np.lexsort((sid, token))
            token, sid, size = token[order], sid[order], size[order]
            new = np.r_[True, (np.diff(token) != 0) | (np.diff(sid) != 0)][: len(token)]
            token, sid, size = token[new], sid[new], size[new]
            runs = np.flatnonzero(np.r_[True, np.diff(token) != 0][: len(token)])
            df = np.repeat(np.diff(np.r_[runs, len(token)]), np.diff(np.r_[runs, len(token)]))
            keep = df > 1
            token, sid, size, df = token[keep], sid[keep], size[keep], df[keep].astype(np.uint32)
            order = np.lexsort((token, sid, sid % np.uint64(groups)))
            token, sid, size, df = token[order], sid[order], size[order], df[order]
            first = np.flatnonzero(np.r_[True, np.diff(sid) != 0][: len(sid)])
            own, n, count = sid[first], size[first], np.diff(np.r_[first, len(sid)]).astype(np.uint32)
            cuts = np.searchsorted(own % np.uint64(groups), np.arange(groups + 1).astype(np.uint64))
            ends = np.r_[0, count.cumsum()]
            rows = []
            for g in range(groups):
                a, z = cuts[g], cuts[g + 1]
                if z > a:
                    p, q = ends[a], ends[z]
                    rows.append(_row(g, 1, sids=own[a:z], sizes=n[a:z], counts=count[a:z], tokens=token[p:q], ids=df[p:q]))
            yield pd.DataFrame(rows, columns=NAMES)

    return shared


SETS = "kind int, id long, sid long, n long, s long, tokens array<long>, first array<long>, second array<long>, third array<long>"


def _survivors(num: int, den: int):
    """Rows by set to one row per document (kind 0), and one per set that can have a partner (kind 1): the tokens that it
    shares with any other set, and those in its prefix under three global orders: rarest first; powers of two of the
    number of sets, then by hash; by another hash alone."""

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for b in batches:
            for r in b.itertuples():
                if r.kind == 0:
                    sid = unplanes(r.sids, np.uint64).view(np.int64)
                    yield pd.DataFrame({"kind": 0, "id": unplanes(r.ids, np.int64), "sid": sid, "n": unplanes(r.sizes, np.uint32).astype(np.int64), "s": 0} | {c: [None] * len(sid) for c in ("tokens", "first", "second", "third")})
                else:
                    count = unplanes(r.counts, np.uint32)
                    parts.append((np.repeat(unplanes(r.sids, np.uint64), count), np.repeat(unplanes(r.sizes, np.uint32), count), unplanes(r.tokens, np.uint64), unplanes(r.ids, np.uint32)))
        if not parts:
            return
        sid, size, token, df = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        order = np.lexsort((token, df, sid))
        sid, size, token, df = sid[order], size[order].astype(np.int64), token[order], df[order]
        starts = np.flatnonzero(np.r_[True, np.diff(sid) != 0])
        ends = np.r_[starts[1:], len(sid)]
        rows = []
        for a, z in zip(starts, ends, strict=True):
            n, s = int(size[a]), int(z - a)
            least = -(-num * n // den)  # tokens that a partner must share
            if s < least:
                continue
            t, k = token[a:z], s - least + 1
            by_power = np.lexsort((mixed(t, 3), np.log2(df[a:z]).astype(np.int64)))[:k]
            rows.append((1, None, int(sid[a : a + 1].view(np.int64)[0]), n, s, np.sort(t).astype(np.int64), t[:k].astype(np.int64), t[by_power].astype(np.int64), t[np.argsort(mixed(t, 5))[:k]].astype(np.int64)))
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=["kind", "id", "sid", "n", "s", "tokens", "first", "second", "third"]).astype({"id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "id", "sid", "n", "s", "tokens", "first", "second", "third"]).astype({"id": "Int64"})

    return survivors


def _possible(na: Column, sa: Column, nb: Column, sb: Column, num: int, den: int) -> Column:
    """Sizes and numbers of shared tokens allow the threshold."""
    most = F.least(sa, sb)
    return (most * den >= (na + nb - most) * num) & (F.least(na, nb) * den >= F.greatest(na, nb) * num)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of the pairs that share prefix tokens under all three orders and reach the threshold. Prefixes are looked at
    first; only the pairs that pass meet their sets' tokens."""
    for order in ("second", "third"):
        x = sets.select(F.col("sid").alias("a"), F.col(order).alias("pa"))
        y = sets.select(F.col("sid").alias("b"), F.col(order).alias("pb"))
        pairs = pairs.join(x, "a").join(y, "b").where(F.arrays_overlap("pa", "pb")).select("a", "b")
    x = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", shared.alias("shared"))
    return both.where((F.col("shared") * den) >= (F.col("na") + F.col("nb") - F.col("shared")) * num).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of edges (a, b). Each round a node takes the smallest
    label about it and then its label's label; rounds grow with the logarithm of a component's width."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialise(lower.join(roots, "label", "left").select("node", F.least("label", "root").alias("label"), "old"), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of tokens that each of x shares with each of y (arrays of distinct tokens)."""
    n, m = len(x), len(y)
    ox, oy = np.repeat(np.arange(n), [len(t) for t in x]), np.repeat(np.arange(m), [len(t) for t in y])
    names, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    tx, ty = at[: len(ox)], at[len(ox) :]
    dx, dy = np.bincount(tx, minlength=len(names)), np.bincount(ty, minlength=len(names))
    dense = np.flatnonzero(dx * dy >= DENSE)
    out = np.zeros((n, m), np.int64)
    column = np.full(len(names), -1)
    for k in range(0, len(dense), 4096):
        column[:] = -1
        column[dense[k : k + 4096]] = np.arange(len(dense[k : k + 4096]))
        a, b = np.zeros((n, 4096), np.float32), np.zeros((m, 4096), np.float32)
        for matrix, owner, token in ((a, ox, tx), (b, oy, ty)):
            here = column[token] >= 0
            matrix[owner[here], column[token[here]]] = 1
        out += (a @ b.T).astype(np.int64)
    rare = (dx * dy > 0) & (dx * dy < DENSE)
    order = np.argsort(ty, kind="stable")
    first = np.r_[0, dy.cumsum()]
    ox, tx = ox[rare[tx]], tx[rare[tx]]
    times = dy[tx]
    place = np.repeat(first[tx] - np.r_[0, times.cumsum()][:-1], times) + np.arange(times.sum())
    return out + np.bincount(np.repeat(ox, times) * m + oy[order[place]], minlength=n * m).reshape(n, m)


def _linked(num: int, den: int):
    """Rows sorted by (label, i, j) to sid, links: documents of the other sets that each set links with in this pair of
    blocks."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        where = None

        def out() -> pd.DataFrame:
            i, j = where[1:]
            x, y = [r for r in held if r.block == i], [r for r in held if r.block == j]
            if not x or not y:
                return pd.DataFrame({"sid": [], "links": []}, dtype=np.int64)
            nx, ny = np.array([r.n for r in x])[:, None], np.array([r.n for r in y])[None, :]
            shared = overlaps([r.tokens for r in x], [r.tokens for r in y])
            link = shared * den >= (nx + ny - shared) * num
            if i == j:
                np.fill_diagonal(link, False)
                y = []
            to_x = link @ np.array([r.docs for r in (y or x)])
            to_y = np.array([r.docs for r in x]) @ link if y else []
            return pd.DataFrame({"sid": [r.sid for r in x + y], "links": np.r_[to_x, to_y].astype(np.int64)})

        for b in batches:
            for r in b.itertuples():
                if (r.label, r.i, r.j) != where:
                    if held:
                        yield out()
                    held, where = [], (r.label, r.i, r.j)
                held.append(r)
        if held:
            yield out()

    return linked


def link_counts(sets: DataFrame, labels: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """sid, links: documents with other sets that each set in a component of several sets links with. A component's sets are
    dealt into blocks, and every two blocks meet in one place, so that only sets are sent about, not pairs."""
    docs = members.where("n > 0").groupBy("sid").agg(F.count("*").alias("docs"))
    own = sets.select("sid", "s").join(labels, F.col("sid") == F.col("node")).select("sid", "s", "label")
    parts = own.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("s") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = materialise(salted_join(own, parts, "label", "sid").join(docs, "sid").select("sid", "label", "docs", "blocks", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block")), "jaccard-dealt")
    rows = sets.select("sid", "n", "tokens").join(dealt, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sid", "n", "tokens", "docs", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInPandas(tidy(_linked(num, den)), "sid long, links long")
    return materialise(found.groupBy("sid").agg(F.sum("links").alias("links")), "jaccard-links")


#: Rows of a key (sets on a token's list, documents of a set) from which on they are dealt over several tasks.
MANY = 256


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, spread: str, hot: Listing) -> DataFrame:
    """The inner join of rows with what is known of each key; the rows of keys that `hot` lists are dealt out by spread."""
    (many, few), (of_many, of_few) = hot.split(rows, key), hot.split(per_key, key)
    return few.join(of_few, key).unionByName(salted_join(many, of_many, key, spread))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, buckets: int | None = None, links: bool = False) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach, the document itself included) of every row; with
    `links` also n_links, the number of other documents (rows) that it links with.
    Two documents link when den * intersection >= num * union of their sets of distinct `width`-word shingles; a text of
    fewer words is one shingle; an empty or null one links with nothing.

    Rows that repeat a key: each gives a row. A null key: null component of its own unless linked. Empty table: empty
    result. Other columns are ignored. Sets are told apart by 64-bit hashes."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("id"), F.col(text).alias("text"))
    buckets = buckets or 2 * max(8, input_partitions(rows))
    dealt = rows.mapInPandas(tidy(_dealt(buckets, width)), PARTS).repartitionById(buckets, "part")
    by_set = dealt.mapInPandas(tidy(_shared(buckets, buckets)), PARTS).repartitionById(buckets, "part")
    found = materialise(by_set.mapInPandas(tidy(_survivors(num, den)), SETS), "jaccard-sets")
    members, sets = found.where("kind = 0").select("id", "sid", "n"), found.where("kind = 1")
    small = sets.select("sid", "n", "s", "first")
    # with each place in a prefix: the set's tokens from there on in the order, and the few prefix tokens before it
    placed = small.select("sid", "n", "s", "first", F.posexplode("first").alias("at", "token"))
    before = F.slice("first", F.greatest(F.lit(1), F.col("at") - EARLIER + 1), F.least(F.col("at"), F.lit(EARLIER)))
    lists = materialise(placed.select("sid", "n", "s", "token", (F.col("s") - F.col("at")).alias("rest"), before.alias("before")), "jaccard-lists")

    core = lists.groupBy("token").agg(F.min(F.struct((1 - F.col("s") / F.col("n")).alias("alone"), "sid", "n", "s")).alias("c"), F.count("*").alias("m")).where("m > 1")
    core = materialise(core, "jaccard-core")
    long_lists = Listing(core.where(F.col("m") > MANY), "token")
    stars = spread_join(lists, core, "token", "sid", long_lists).where((F.col("c.sid") != F.col("sid")) & _possible(F.col("c.n"), F.col("c.s"), F.col("n"), F.col("s"), num, den))
    stars = stars.select(F.least("c.sid", "sid").alias("a"), F.greatest("c.sid", "sid").alias("b")).distinct()
    edges = materialise(verified(stars, sets, num, den), "jaccard-edges")
    labels = components(edges)

    labelled = lists.join(labels, lists["sid"] == labels["node"], "left").select("token", "sid", "n", "s", "rest", "before", F.coalesce("label", "sid").alias("label"))
    of_lists = labelled.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").select("token", "largest")
    apart = materialise(spread_join(labelled, of_lists, "token", "sid", long_lists), "jaccard-apart")
    out = apart.where("label <> largest").select("token", F.col("sid").alias("x"), F.col("n").alias("xn"), F.col("rest").alias("xs"), F.col("before").alias("xb"), F.col("label").alias("xl"))
    # a pair is made at the first token that it shares: what both hold from there on must allow the threshold, and places
    # where they share a token just before are not the first
    cross = out.join(apart, "token").where((F.col("xl") != F.col("label")) & _possible(F.col("xn"), F.col("xs"), F.col("n"), F.col("rest"), num, den) & ~F.arrays_overlap("xb", "before"))
    cross = cross.select(F.least("x", "sid").alias("a"), F.greatest("x", "sid").alias("b")).distinct()
    more = materialise(verified(cross, sets, num, den), "jaccard-more")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))

    of_sets = members.where("n > 0").groupBy("sid").agg(F.min("id").alias("low"), F.count("*").alias("docs"))
    classes = materialise(of_sets.join(labels, of_sets["sid"] == labels["node"], "left").select("sid", "low", "docs", "label"), "jaccard-low")
    linked = classes.where("label is not null")
    lowest = linked.groupBy("label").agg(F.min("low").alias("component"))
    alone = classes.where("label is null").select("sid", "docs", F.col("low").alias("component"))
    classes = salted_join(linked, lowest, "label", "sid").select("sid", "docs", "component").unionByName(alone)
    hot = Listing(of_sets.where(F.col("docs") > MANY), "sid")
    if links:
        found = link_counts(sets, labels, members, num, den)
        classes = classes.join(found, "sid", "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    classes = materialise(classes.drop("docs"), "jaccard-classes")
    real = lambda c: F.when(F.col(c) != LOW, F.col(c))
    columns = [real("id").alias(key), F.col("n").alias("n_shingles"), real("component").alias("component_id"), *([F.col("n_links")] if links else [])]
    out = spread_join(members.where("n > 0"), classes, "sid", "id", hot).select(*columns)
    none = members.where("n = 0").withColumns({"component": F.col("id"), "n_links": F.lit(0).cast("long")})
    return out.unionByName(none.select(*columns))


def without_marked(own: DataFrame, marks: DataFrame, row: str, once: str) -> DataFrame:
    """own without the rows that marks lists, of those with a true `once` one stays. A filter of bounded size tells rows
    that are surely not listed: these pass where they are read, and only the others are shuffled to be looked up."""
    hits, rest = by_listing(own, marks, row)
    if hits is None:
        return own
    hits = hits.join(marks, row, "left").where(F.coalesce(once, F.lit(True)))
    number = once + "_no"
    hits = hits.withColumn(number, F.when(F.col(once).isNull(), F.monotonically_increasing_id())).dropDuplicates([row, number])
    return rest.unionByName(hits.drop(once, number))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: the one with the smallest key (a null key is the largest; then the smallest hash
    of key and text); of rows equal in both, one. A text without shingles has no copies: each such row stays.

    A row is known by the 64-bit hash of its key and text, so null keys and keys that repeat are rows like others. Texts of
    rows that stay are not shuffled, but for the few that the filter of rows to drop cannot tell apart. Empty table: empty
    result. All columns of docs stay, whatever their names."""
    row = free_name(docs, "__row")
    own = docs.withColumn(row, F.xxhash64(key, text))
    classes = materialise(near_classes(own.select(F.col(row).alias("__row"), F.col(text).alias("__text")), "__row", "__text", width, num, den).groupBy("__row", "component_id").agg(F.max("n_shingles").alias("__n"), F.count("*").alias("__m")), "jaccard-rows").where("__n > 0")
    keys = own.select(F.col(row).alias("__row"), F.col(key).alias("__key")).distinct()
    first = F.min(F.struct(F.col("__key").isNull().alias("null"), "__key", "__row", "__m"))
    best = materialise(classes.join(keys, "__row").groupBy("component_id").agg(first.alias("f")).select("f.__row", "f.__m"), "jaccard-best")
    gone = classes.join(best, "__row", "left_anti").select("__row", F.lit(False).alias("__once"))
    marks = materialise(gone.unionByName(best.where("__m > 1").select("__row", F.lit(True).alias("__once"))), "jaccard-marks")
    once = free_name(docs, "__once")
    return without_marked(own, marks.select(F.col("__row").alias(row), F.col("__once").alias(once)), row, once).select(docs.columns)


def op3(spark, sf_dir):
    return near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, num=85, den=100, links=True)


QUERIES = {"op3_jaccard_join": op3}
