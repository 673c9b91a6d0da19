"""Exact dedup, ranked search and importance resampling on small fixtures against brute force: nulls, empty and long texts,
ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contestlab.llm import exact, lexical, resampling
from contestlab.llm.common import TERM_BYTES, term_lists, translated

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(n=150, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Éa", "straße", "x-y", "ß1", "日本"]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    for k in range(0, n, 5):  # copies, some of them in other case
        out.append((n + k, out[k][1].upper() if k % 2 else out[k][1].replace("w", "W")))
    out += [(None, out[0][1]), (None, None), (None, ""), (900, None), (901, ""), (902, ""), (7, out[7][1]), (7, out[7][1]), (7, "another text"), (903, " \n\t\x0b"), (904, "É"), (905, "é"), (906, "W1 , w1;W1"), (907, "the long tale " * 40_000)]
    return out


# terms


def test_terms_of_bytes():
    texts = ["Ab c_d-e 1x[y`z{~\x7f", "É日本 ünï\x00x", "", None, "@A@", "a" * 50 + " b " * 30]
    found = [[t.decode() for part in term_lists(raw, 7) for t in part] for raw in translated(pa.array(texts).slice(0), TERM_BYTES)]
    assert found == [TERM.findall(lower(t)) for t in texts]
    assert [bytes(t) for t in translated(pa.array(texts).slice(4, 1), TERM_BYTES)] == [b" a "]


# exact dedup


@pytest.mark.parametrize("n,below", [(1, 1), (1, 1 << 40), (300, 300), (1000, 1 << 20), (5000, 1 << 62)])
def test_golomb_round_trip(n, below):
    rng = np.random.default_rng(n)
    values = np.arange(n, dtype=np.uint64) if n == below else np.unique(rng.integers(0, below, n, dtype=np.uint64))
    b, code = exact.golomb(values, below)
    assert (exact.ungolomb(len(values), b, code) == values).all()
    if below > 100 * n:  # within two and a half bits of the gaps' logarithm
        assert 8 * len(code) <= len(values) * (math.log2(below / len(values)) + 2.5) + 16
    assert exact.golomb(values[:0], below) == (0, b"") and len(exact.ungolomb(0, 0, b"")) == 0


def brute_groups(data):
    groups = defaultdict(list)
    for k, t in data:
        groups[lower(t)].append(k)
    out = Counter()
    for t, keys in groups.items():
        top = max(keys, key=lambda k: (k is not None, k or 0))
        first = True
        for k in keys:
            stays = k == top and first
            first = first and not stays
            out[k, top, len(keys), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_groups(spark):
    df = spark.createDataFrame([(k, t, 1, "x", b"y") for k, t in rows()], "doc_id long, text string, row int, digest string, bytes binary").repartition(5)
    assert Counter(map(tuple, exact.exact_groups(df).collect())) == brute_groups(rows())
    assert exact.exact_groups(df.limit(0)).collect() == []
    assert [tuple(r)[:4] for r in exact.exact_groups(spark.createDataFrame([(4, "only")], "doc_id long, text string")).collect()] == [(4, 4, 1, True)]


def test_equal_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    short = lambda raw: hashlib.sha256(raw).digest()[:1] * 8  # noqa: E731  256 digests in all
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df, digest=short).collect())
    want = Counter()
    for k, n in brute_groups(rows()).items():
        want[k[:4]] += n
    assert got == want


def test_large_group_and_largest_rows(spark):
    data = [(i, "Same Text" if i % 3 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame([(k, t, f"s{k}") for k, t in data], "doc_id long, text string, source string").repartition(6)
    assert Counter(map(tuple, exact.exact_groups(df).collect())) == brute_groups(data)
    stay = exact.keep_largest(df).collect()
    assert sorted(r.doc_id for r in stay) == sorted(k for k, top, _, kept, _ in brute_groups(data) if kept)
    assert all(r.source == f"s{r.doc_id}" for r in stay) and df.columns == exact.keep_largest(df).columns


# ranked search


def brute_search(data, queries, k=50):
    docs = [(key, Counter(TERM.findall(lower(t)))) for key, t in data]
    docs = [(key, c) for key, c in docs if c]
    n, total, out = len(docs), sum(sum(c.values()) for _, c in docs), []
    for item, text in queries:
        score = Counter()
        for t in set(TERM.findall(lower(text))):
            df = sum(t in c for _, c in docs)
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for i, (_, c) in enumerate(docs):
                if c[t]:
                    score[i] += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * sum(c.values()) * n // total)))
        best = sorted(((-s, docs[i][0] is None, docs[i][0] or 0) for i, s in score.items() if s > 0))[:k]
        out += [(item, r + 1, None if null else key, -s) for r, (s, null, key) in enumerate(best)]
    return Counter(out)


def test_search(spark, monkeypatch):
    data, asked = rows(), [(1, "W1 w2, w3"), (2, "日本 straße w9 w9"), (3, None), (4, "nothing known"), (None, "w4"), (1, "another TALE é"), (6, " ".join(f"w{k}" for k in range(60)))]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in data], "doc_id long, text string, n int, segment string").repartition(3)
    q = spark.createDataFrame([(k, t, 0) for k, t in asked], "item_id long, text string, query int")
    want = brute_search(data, asked)
    assert Counter(map(tuple, lexical.search(df, q).collect())) == want
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 40)  # many segments, queries in blocks, ties at the cut
    assert Counter(map(tuple, lexical.search(df, q, block=20).collect())) == want
    assert Counter(map(tuple, lexical.search(df, q, k=3).collect())) == brute_search(data, asked, 3)
    assert lexical.search(df.limit(0), q).collect() == [] and lexical.search(df, q.limit(0)).collect() == []


def test_bounds_skip_strata_and_lose_nothing(spark):
    data = [(i, "rare " * (i % 3) + "common " * (1 + i % 40)) for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    index = lexical.build_index(df)
    assert index.where("term is not null").select("term").distinct().count() == 2
    table = index.where("segment = '0-0'").toArrow()
    s = lexical.Searcher(table)
    read, old = [], np.unique
    try:
        lexical.np.unique = lambda a, **kw: (read.append(len(a)), old(a, **kw))[1]
        docs, scores = s.top([("rare", 900), ("common", 1)], 50)
    finally:
        lexical.np.unique = old
    assert len(docs) == 50 and s.count > 20
    assert sum(read) < 0.6 * len(s.doc)  # strata whose bounds are too low are not visited
    all_docs, all_scores = s.top([("rare", 900), ("common", 1)], len(s.doc))
    assert sorted(scores) == sorted(sorted(all_scores)[-50:])
    postings = index.where("term = 'rare'").first()
    norms = index.where("term is null").first()["norms"]
    runs = [(norms[d], t) for d, t in zip(postings["docs"], postings["tfs"], strict=True)]
    assert runs == sorted(runs)  # by stratum, then by term frequency


# importance resampling


def brute_resample(data, target, percent=10, grams=1, buckets=10_000):
    def runs(t):
        w = [x.encode() for x in TERM.findall(lower(t))]
        return [b" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)], len(w)

    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in runs(t)[0])
    s, t = count(x for _, x in data), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, fit = [], []
    for i, (k, x) in enumerate(data):
        f, n = runs(x)
        w = sum(gain(zlib.crc32(g) % buckets) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(f), w, score, None])
        if n >= 20:
            fit.append((-score, k is None, k or 0, len(f), i))
    for r, (*_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100]):
        out[i][4] = r + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("percent,grams", [(10, 1), (100, 1), (60, 3)])
def test_resample(spark, percent, grams):
    data, target = rows(), ["w1 w2 w3 w4", None, "straße 日本 w1"]
    df = spark.createDataFrame([(k, t, 5, 6, 7) for k, t in data], "doc_id long, text string, rank int, block int, place int").repartition(4)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert Counter(map(tuple, resampling.resample(df, bench, percent=percent, grams=grams).collect())) == brute_resample(data, target, percent, grams)


def test_resample_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(empty, empty).collect() == []
    short = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(short, short).collect()] == [None, None]
    far = [(-(1 << 63), "w " * 30), ((1 << 63) - 1, "w " * 30), (0, "w " * 30), (None, "w " * 30)] + [(i, "w " * 20) for i in range(1, 40)]
    df = spark.createDataFrame(far, "doc_id long, text string")
    assert Counter(map(tuple, resampling.resample(df, df, percent=50).collect())) == brute_resample(far, [t for _, t in far], 50)


def test_radix_sort_is_stable_over_blocks_and_hot_keys(spark):
    rng = random.Random(5)
    data = [(rng.choice([0, 0, 0, 5, 4095, 4096, 1 << 40]), rng.randrange(1 << 20), i) for i in range(5000)]
    df = spark.createDataFrame(data, "a long, b long, i long")
    got = sorted(resampling.radix_sorted(df, [("a", 41), ("b", 20)], digit=9, block=300).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(5000))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _ in data) and {r.i for r in got} == set(range(5000))
