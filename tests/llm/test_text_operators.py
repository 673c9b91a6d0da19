"""Language ID, quality rules, the Jaccard join, mixing, packing and language-model scoring on small fixtures: brute force,
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contestlab.llm import jaccard, language, mixing, packing, pitman_yor, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def some_docs(n=120, seed=0):
    rng = random.Random(seed)
    vocab = {"en": "the of and to in that was with this from".split(), "de": "der die und das nicht ist ein sich mit auf".split(), "fr": "le la les des une est dans que pour avec".split()}
    own = random.Random(99)
    rows, made = [], {k: [own.choice(v)[:2] + "".join(own.choice("aeiounrst") for _ in range(5)) for _ in range(200)] for k, v in vocab.items()}
    for i in range(n):
        lang = rng.choice(list(vocab))
        t = " ".join(rng.choice(vocab[lang] if rng.random() < 0.5 else made[lang]) for _ in range(rng.randrange(5, 90)))
        if i % 4 == 3:  # near copies
            w = rows[i - 1][1].split()
            w[rng.randrange(len(w))] = "edit"
            t, lang = " ".join(w), rows[i - 1][2]
        rows.append((i, t, lang, f"src{i % 5}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \n\t ", "en", "src1", 4), (n + 3, "ok", "en", None, 2), (n + 4, rows[0][1], rows[0][2], "src0", 0), (n + 5, "123 456 !!", "en", "src2", 10), (n + 6, "the long tale " * 9000, "en", "src3", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS)


# quality rules


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    pos = {j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(pos)


def test_quality_counts(spark):
    texts = ["a b c a b c a", "x y", "", None, "a\na\n\n a\na", "# * $ ok <b>", "un deux trois quatre un deux trois", "A b C " * 3000, "é ü\x0bñ\x85z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.measured(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id]), r.doc_id


def test_quality_em_finds_the_bad():
    rng = random.Random(1)
    counts, truth = Counter(), []
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple(-1 if rng.random() < 0.2 else int(rng.random() < (0.97 if good else 0.4)) for _ in quality.RULES)
        counts[votes] += 1
        truth.append((good, votes))
    share, rates = quality.estimate(counts.items())
    assert abs(share - 0.8) < 0.05 and all(p > q for p, q in rates)
    assert np.mean([(quality.posterior(v, share, rates) >= 0.5) == g for g, v in truth]) > 0.95


def test_quality_keeps_rows_and_columns(spark, docs):
    df = docs.withColumnRenamed("n_chars", "n_words").unionByName(docs.withColumnRenamed("n_chars", "n_words").limit(3))
    out = quality.score_quality(df)
    assert out.count() == df.count() and {"text", "source", "kept", "quality"} <= set(out.columns)
    assert quality.score_quality(docs.limit(0)).count() == 0


# language ID


def test_language_held_out(spark):
    train = spark.createDataFrame(some_docs(400, 1), DOCS)
    model = language.fit(train)
    rows = [r for r in some_docs(200, 2) if r[1] and len(r[1].split()) >= 5 and any(c.isalpha() for c in r[1])]
    got, score, rejected = model.predict([r[1] for r in rows])
    assert np.mean([g == r[2] for g, r in zip(got, rows)]) > 0.97 and (score <= 1).all()
    assert model.predict([None, "", "12 !"])[0] == ["und"] * 3 and model.predict([None, "", "12 !"])[2].all()


def test_language_same_in_any_batch(spark, docs):
    model = language.fit(docs)
    out = {r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in language.identify(docs.withColumnRenamed("n_chars", "lang_score"), model).collect()}
    for i, t, *_ in some_docs():
        p, s, _ = model.predict([t])
        assert out[i] == (p[0], round(float(s[0]), 9))
    assert language.identify(docs.limit(0), model).count() == 0
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_subwords_stay_in_words():
    a, b = language.subwords([" ab cd "])[0], np.concatenate([language.subwords([" ab "])[0], language.subwords([" cd "])[0]])
    assert Counter(a.tolist()) == Counter(b.tolist())


# Jaccard join


def brute_classes(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def chains(n=90, seed=3):
    """Groups in which each copy differs a little from the one before, so that only neighbours link."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        for _ in range(n // 6):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
    common = " ".join(rng.choice(words) for _ in range(60))
    rows += [(len(rows) + k, common + " " + " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 50])))) for k in range(25)]
    return rows


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_against_all_pairs(spark, width, num):
    rows = chains() + [(i + 1000, t) for i, t, *_ in some_docs(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_classes(df, width=width, num=num, buckets=6).collect()}
    assert got == brute_classes(rows, width, num, 100)


@pytest.mark.parametrize(("width", "num", "block"), [(4, 85, 512), (5, 80, 4), (1, 50, 7)])
def test_jaccard_counts_all_links(spark, width, num, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = chains() + [(i + 1000, t) for i, t, *_ in some_docs(40)]
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    want = {i: sum(j != k and bool(a) and len(a & b) * 100 >= len(a | b) * num for k, b in enumerate(sets)) for j, ((i, _), a) in enumerate(zip(rows, sets, strict=True))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.near_classes(df, width=width, num=num, buckets=6, links=True).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 5
    assert jaccard.near_classes(df.limit(0), links=True).count() == 0


def test_overlaps_by_product_and_by_index(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(n)] for n in (30, 17))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    for least in (1, 80, 10**9):
        monkeypatch.setattr(jaccard, "DENSE", least)
        assert jaccard.overlaps(x, y).tolist() == want


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (3, "A b c d e"), (3, "a b c d e"), (9, ""), (8, None), (7, "a b"), (2, "a b"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_classes(df.selectExpr("*", "'x' as sid"), width=4).collect())
    assert got == sorted([("5", 2, 3), ("3", 2, 3), ("3", 2, 3), ("9", 0, 9), ("8", 0, 8), ("7", 1, 2), ("2", 1, 2), ("None", 2, None)])
    assert jaccard.near_classes(df.limit(0)).count() == 0
    kept = jaccard.keep_one(df.where("doc_id is not null"), width=4)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8, 9]


def test_keep_one_goes_by_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, far = long + " end", " ".join(f"v{k}" for k in range(60))
    rows = [(None, "one clean text of its own"), (None, "another clean text here now"), (None, ""), (None, None), (None, None), (4, "some text that is four"), (4, "quite another one with four"), (4, "some text that is four"), (1, long), (9, near), (9, far), (None, far + " x")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(r for k, r in enumerate(rows) if k not in (7, 9, 11))
    assert got[0].asDict().keys() == {"doc_id", "text"}


# mixing


def test_quotas_and_route():
    q = mixing.quotas({"a": 100, "b": 100, None: 50}, mixing.cycled_weights(["b", None, "a"]))
    assert mixing.cycled_weights(["b", None, "a"]) == {"a": 3, "b": 1, None: 2}
    assert q["a"] == 187.5 or q["a"] <= 200
    assert abs(sum(q.values()) - 375) < 1e-9 and all(q[s] <= 2 * n + 1e-9 for s, n in {"a": 100, "b": 100, None: 50}.items())
    # sources that overlap: the shared documents make up for the source that has none of its own
    flow = mixing.route({("a",): 100, ("a", "b"): 50}, {"a": 90, "b": 60})
    assert abs(sum(flow.values()) - 150) < 1e-6 and flow["a", "b"] <= 100 + 1e-6
    assert abs(flow["a",] - 90) < 11 and mixing.route({("a",): 0}, {"a": 0.0}) == {("a",): 0}


def test_route_is_cheapest():
    rng = random.Random(5)
    for _ in range(30):
        sources = ["a", "b", "c"][: rng.randrange(1, 4)]
        patterns = {}
        for _ in range(rng.randrange(1, 5)):
            patterns[tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1))))] = rng.randrange(1, 6)
        targets = {s: rng.randrange(0, 9) for s in sources}
        flow = mixing.route(patterns, targets)
        # brute force over whole tokens: most flow first, then fewest second copies
        best = None
        options = [[(p, take) for take in range(2 * n + 1)] for p, n in patterns.items()]

        def feasible(takes, patterns=patterns, targets=targets):
            need = dict(targets)
            todo = sorted(takes.items(), key=lambda x: len(x[0]))

            def go(i):
                if i == len(todo):
                    return True
                p, n = todo[i]

                def split(k, left):
                    if k == len(p) - 1:
                        if need[p[k]] < left:
                            return False
                        need[p[k]] -= left
                        ok = go(i + 1)
                        need[p[k]] += left
                        return ok
                    for x in range(min(left, need[p[k]]) + 1):
                        need[p[k]] -= x
                        ok = split(k + 1, left - x)
                        need[p[k]] += x
                        if ok:
                            return True
                    return False

                return split(0, n)

            return go(0)

        import itertools

        for combo in itertools.product(*options):
            takes = dict(combo)
            total, cost = sum(takes.values()), sum(max(0, takes[p] - n) for p, n in patterns.items())
            if (best is None or (total, -cost) > best) and feasible(takes):
                best = (total, -cost)
        got = (round(sum(flow.values())), -round(sum(max(0.0, flow[p] - n) for p, n in patterns.items())))
        assert got == best, (patterns, targets, flow)


def test_mix_meets_targets(spark, docs):
    df = docs.withColumnRenamed("n_chars", "pattern").unionByName(docs.withColumnRenamed("n_chars", "pattern").limit(4))
    out = mixing.documents_mix(df)
    rows = out.collect()
    assert len(rows) == df.count() and "pattern" in out.columns
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    for s in size:
        assert size[s] == next(r.source_size for r in rows if r.source == s)
        largest = max(r["size"] for r in rows if r.source == s)
        assert abs(taken[s] - target[s]) <= largest
    again = {(r.doc_id, r.taken) for r in mixing.documents_mix(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.documents_mix(docs.limit(0)).count() == 0


# packing


def test_chunk_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    whole = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "a", "é", "́", ".", "B,", "don't", "|", "<", "日本", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += [t or "" for _, t, *_ in some_docs(30)] + ["A b. Σας ΣΑΣ. éa, x\x1cy z\x85w <|endoftext|> don't 123 İstanbul ẞ ok,. a.. b,, c.\n", "日本語 テスト。 ok", "a　b c\xa0d", "Ünï.", "x,\ty."]
    for t, ids in zip(texts, packing.ChunkTokenizer(path).ids(texts), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_sum_of_squares_places():
    rng = random.Random(7)
    lengths = np.array([rng.randrange(1, 41) for _ in range(600)])
    bins, offsets = packing.sum_of_squares(lengths, 40)
    by = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        by[b].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40
    assert len(by) <= math.ceil(lengths.sum() / 40) * 1.06 + 1


def test_sum_of_squares_is_the_rule():
    """Each placement by trying all gaps with room, a new bin only where there is none."""
    rng = random.Random(8)
    lengths, cap = [rng.randrange(1, 13) for _ in range(200)], 12
    counts, ways = [0] * (cap + 1), []
    for s in sorted(lengths, reverse=True):
        best = None
        for g in [g for g in range(s, cap) if counts[g]] or [cap]:
            c = list(counts)
            if g < cap:
                c[g] -= 1
            if 0 < g - s < cap:
                c[g - s] += 1
            key = (sum(x * x for x in c[1:cap]), g)
            if best is None or key < best[0]:
                best = (key, c, g)
        counts = best[1]
        ways.append(best[2])
    order = np.argsort(-np.array(lengths), kind="stable")
    _, offsets = packing.sum_of_squares(np.array(lengths), cap)
    assert [cap - int(o) for o in offsets[order]] == ways


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_few_sequences_as_best_fit(seed):
    """Lengths spread as documents are: within one sequence of best-fit decreasing and of the bound."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6, 1.1, 6000).astype(int) + 1)
    gaps, best = [], 0  # best-fit decreasing
    for s in sorted(lengths.tolist(), reverse=True):
        k = bisect.bisect_left(gaps, s)
        best += k == len(gaps)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 2048) - s)
    used = int(packing.sum_of_squares(lengths, 2048)[0].max()) + 1
    assert used <= best + 1 and used <= -(-int(lengths.sum()) // 2048) + 1


def test_pack_documents(spark, docs, monkeypatch):
    df = docs.unionByName(docs.limit(5))
    out = packing.packed_documents(df).toPandas()
    assert set(out.doc_id) == {r[0] for r in some_docs()}
    g = out.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all() and out.groupby("sequence_id").length.sum().max() <= 2048
    assert (out[out.doc_id == 120].length == 1).all()
    long = out[out.doc_id == 126].sort_values("piece")
    assert (long.length[:-1] == 2048).all() and (long.start == long.piece * 2048).all()
    monkeypatch.setattr(packing, "SHARD", 20)  # several shards, and their loose sequences packed again
    many = packing.packed_documents(df).toPandas()
    assert len(many) == len(out) and many.groupby("sequence_id").length.sum().max() <= 2048
    g = many.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all()
    assert packing.packed_documents(docs.limit(0)).count() == 0
    ids = packing.pieces(df.select("doc_id", "text"), packing.public_tokenizer()).toPandas()
    assert all(zlib.crc32(bytes(x)) == c for x, c in zip(ids.ids, ids.ids_crc32))


# Pitman-Yor


def test_scores_and_base(spark, docs):
    df = docs.selectExpr("doc_id", "text", "doc_id % 3 <> 0 as training", "source as score")
    got = {r.doc_id: r for r in pitman_yor.score(df, buckets=5).collect()}
    counts = Counter()
    for i, t, *_ in some_docs():
        if i % 3:
            counts.update([*WORD.findall(lower(t)), "\0end"])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in some_docs():
        tokens = [*WORD.findall(lower(t)), "\0end"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6
    held = [r for i, r in got.items() if i % 3 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_tables(spark, docs):
    df = docs.selectExpr("doc_id", "text", "cast(null as boolean) as training")
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in pitman_yor.score(df, buckets=3).collect())
    assert pitman_yor.score(df.limit(0), buckets=3).count() == 0
    twice = spark.createDataFrame([(1, "a b", True), (1, "a", True), (None, None, True)], "doc_id long, text string, training boolean")
    assert {r.doc_id: r.n_tokens for r in pitman_yor.score(twice, buckets=2).collect()} == {1: 5, None: 1}
