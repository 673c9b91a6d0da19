"""The sampler against one that moves a customer at a time, and the sums of the probabilities that the product uses."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.llm import pitman_yor as P


def corpus(seed=0, n=300, held=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(250)]
    follow = {w: [rng.choice(words) for _ in range(6)] for w in words}
    rows = []
    for i in range(n + held):
        w = rng.choice(words)
        out = [w]
        for _ in range(rng.randrange(5, 40)):
            w = rng.choice(follow[w]) if rng.random() < 0.7 else words[int(250 * rng.random() ** 3)]
            out.append(w)
        rows.append((i, i < n, " ".join(out)))
    return rows


def plain_scores(rows, sweeps=8, samples=3, seed=1):
    """log10 probabilities of the held-out texts by plain Gibbs sampling, one customer at a time."""
    rng, d, theta = random.Random(seed), P.DISCOUNT, P.STRENGTH
    seats, n, t, tokens, vocabulary = defaultdict(lambda: defaultdict(list)), defaultdict(int), defaultdict(int), [], set()
    parent = lambda x: None if x == "root" else "root" if x[0] == 1 else (1, P.class_of(x[1]))
    after = lambda u: (1, P.class_of(u)) if u == P.START else (2, u)
    level = lambda x: 0 if x == "root" else x[0]

    def prob(x, w):
        if x is None:
            return 1 / (len(vocabulary) + 1)
        k, own = level(x), seats[x].get(w, ())
        return (sum(own) - d[k] * len(own) + (theta[k] + d[k] * t[x]) * prob(parent(x), w)) / (theta[k] + n[x])

    def sit(x, w):
        if x is None:
            return
        k, own = level(x), seats[x][w]
        new, old = (theta[k] + d[k] * t[x]) * prob(parent(x), w), sum(own) - d[k] * len(own)
        n[x] += 1
        if rng.random() * (new + old) < new:
            own.append(1)
            t[x] += 1
            sit(parent(x), w)
        else:
            own[rng.choices(range(len(own)), [s - d[k] for s in own])[0]] += 1

    def leave(x, w):
        if x is None:
            return
        own = seats[x][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        n[x] -= 1
        if not own[k]:
            own.pop(k)
            t[x] -= 1
            leave(parent(x), w)

    for _, training, text in rows:
        u = P.START
        for w in P.tokens_of(text) if training else ():
            tokens.append((u, w))
            vocabulary.add(w)
            u = w
    for u, w in tokens:
        sit(after(u), w)
    found = []
    for sweep in range(sweeps):
        for u, w in tokens:
            leave(after(u), w)
            sit(after(u), w)
        if sweep >= sweeps - samples:
            one = []
            for _, training, text in rows:
                u = P.START
                for w in () if training else P.tokens_of(text):
                    x = after(u)
                    while not n[x]:
                        x = parent(x)
                    one.append(prob(x, w))
                    u = w
            found.append(one)
    return float(np.log10(np.mean(found, axis=0)).sum())


def test_perplexity_as_with_one_customer_at_a_time(spark):
    rows = corpus()
    out = P.score(spark.createDataFrame(rows, "doc_id long, training boolean, text string"), buckets=3).collect()
    held = [r for r in out if r.doc_id >= 300]
    tokens = sum(r.n_tokens for r in held)
    got, want, base = (10 ** (-x / tokens) for x in (sum(r.score for r in held), plain_scores(rows), sum(r.base_score for r in held)))
    assert abs(got / want - 1) < 0.02 and got < 0.5 * base


def test_probabilities_add_up(spark):
    """Of all words and one unknown, after frequent contexts and classes, by the seatings and totals that score() reads."""
    rng = random.Random(3)
    rare = [f"r{k}" for k in range(70_000)]
    rows = corpus(n=60, held=5) + [(1000 + k, True, " ".join(rare[k : k + 700] + rng.sample(rare, 30))) for k in range(0, 70_000, 700)]
    model = P.train(spark.createDataFrame(rows, "id long, training boolean, text string"), 1)
    state = P.unpack(bytes(model.states.first().data))
    predictive = P.Predictive(state, model.samples, model.classes)
    b = predictive.b
    assert len(model.samples) == P.ROUNDS and len(model.frequent) == P.FREQUENT < len(b.words)
    words = np.r_[b.words, np.uint64(1)]  # one that is in no text
    assert 1 not in b.words
    contexts = [*rng.sample(range(P.FREQUENT), 12), *np.unique(b.context[~b.frequent])[:6], P.FREQUENT + P.CLASSES - 1, *np.bincount(b.low_context).argsort()[-4:]]
    for c in contexts:
        p, counts = predictive.probability(words, np.full(len(words), c, np.uint16))
        assert abs(p.sum() - 1) < 1e-9 and counts[-1] == 0 and (p > 0).all()
    # the seating lives on, and totals are those of the seating
    assert (state["t2@1"] != state["t2@2"]).any()
    for k, a in enumerate(model.samples, 1):
        t2 = P._tables(b.low_count, state[f"t2@{k}"])
        assert (t2 <= b.low_count).all() and (np.bincount(b.low_context, t2, minlength=P.FREQUENT) == a.context_t).all()
        assert (np.bincount(b.dish_class, b.customers(1, t2), minlength=P.CLASSES) == a.class_n).all()
        assert (np.bincount(b.low_context, b.low_count, minlength=P.FREQUENT) == a.context_n).all()


def test_the_first_seating_sits_everyone():
    rng, live = np.random.default_rng(2), np.zeros(3000)
    wanted = np.r_[rng.integers(1, 9, 2990), 10**6, 5000, 300, 200, 100, 50, 40, 30, 20, 10]
    s = P.Seats(rng, 0.8, np.zeros(0, int), np.zeros(3000, int), lambda i: np.full(len(i), 0.7), lambda i, by: np.add.at(live, i, by), alone(0.8, 1.0, 0.7))
    s.start(wanted)
    assert (s.n == wanted).all() and (live == s.t).all() and (s.size > 0).all() and len(s.size) == s.t.sum()
    assert (np.bincount(np.repeat(np.arange(3000), s.t), s.size) == wanted).all()
    s.sweep()
    s.bring(wanted + rng.integers(-1, 2, 3000) * (wanted > 1))
    assert (np.bincount(np.repeat(np.arange(3000), s.t), s.size) == s.n).all() and (live == s.t).all()


def alone(d, theta, p):
    """The law of dishes that are alone in their restaurants: weights (theta + d * i) * p of a new table."""
    return lambda i: P.Law(d, 0.0, 0, np.full(len(i), theta), np.zeros(len(i)), np.zeros(len(i)), np.full(len(i), p), np.ones(len(i)))


def law_of_tables(n, d, theta, p):
    """Probabilities of 0..n tables of n customers of one dish: S(n, t) times the weights of the openings."""
    t, w = np.arange(n + 1), np.zeros(n + 1)
    w[0] = 1
    for k in range(n):
        w = w * np.maximum(k - d * t, 0) + np.r_[0, (w * (theta + d * t) * p)[:-1]]
        w /= w.sum()
    return w


def dishes(n, count, d, theta, p, tables, seed=3):
    """Seats of dishes alone in their restaurants, with n customers at so many tables, nearly all at the first."""
    live = np.full(count, float(tables))
    size = np.tile(np.r_[n - tables + 1, np.ones(tables - 1, int)], count)
    return P.Seats(np.random.default_rng(seed), d, size, np.full(count, tables), lambda i: (theta + d * live[i]) * p, lambda i, by: np.add.at(live, i, by), alone(d, theta, p)), live


@pytest.mark.parametrize(("n", "first"), [(3, 3), (5, 1), (6, 1), (12, 12), (40, 1)])
def test_gibbs_keeps_the_processs_law(n, first):
    """One dish alone in a restaurant: how often there are so many tables after sweeps against the law worked out exactly."""
    d, theta, p = 0.5, 1.0, 0.4
    s, live = dishes(n, 4000, d, theta, p, first)
    for _ in range(60):
        s.sweep()
    assert abs(np.bincount(s.t, minlength=n + 1) / 4000 - law_of_tables(n, d, theta, p)).sum() < 0.08
    assert (live == s.t).all() and (s.n == n).all() and len(s.size) == s.t.sum()
    if n == 12:  # and the tables' sizes: how many hold one customer, by plain seating one at a time with the same law
        q, _ = dishes(n, 4000, d, theta, p, first, 9)
        every = np.arange(4000)
        for _ in range(40 * n):
            q.leave(every)
            q.sit(every)
        one = [np.bincount(x.size, minlength=n + 1) / 4000 for x in (s, q)]
        assert abs(one[0] - one[1]).max() < 0.08, one


@pytest.mark.parametrize("first", [1, 10_000])
def test_a_large_dish_forgets_its_start(first):
    """10,000 customers at one table, or each alone: after a few sweeps the number of tables follows the exact law."""
    n, d, theta, p = 10_000, 0.8, 2.0, 0.3
    s, live = dishes(n, 200, d, theta, p, first)
    for _ in range(8):
        s.sweep()
    law = law_of_tables(n, d, theta, p)
    mean = (law * np.arange(n + 1)).sum()
    sd = np.sqrt((law * (np.arange(n + 1) - mean) ** 2).sum())
    assert abs(s.t.mean() - mean) < 4 * sd / np.sqrt(200) and 0.8 < s.t.std() / sd < 1.25, (s.t.mean(), mean, s.t.std(), sd)
    assert (live == s.t).all() and (np.bincount(np.repeat(np.arange(200), s.t), s.size) == n).all()
    before = s.t.copy()
    s.sweep()
    assert (s.t != before).mean() > 0.2


def test_many_come_and_leave_by_the_law_of_one_at_a_time():
    """Tables and their sizes after 48 customers have come, and after 50 have left, against the moves of one customer."""
    d, theta, p, every = 0.5, 1.0, 0.4, np.arange(6000)
    (s, live), (q, _) = dishes(12, 6000, d, theta, p, 4), dishes(12, 6000, d, theta, p, 4, 9)
    for goal in (60, 10):
        s.bring(np.full(6000, goal))
        for _ in range(abs(goal - int(q.n[0]))):
            (q.sit if goal > q.n[0] else q.leave)(every)
        t, sizes = ([np.bincount(x, minlength=70) / 6000 for x in v] for v in ((s.t, q.t), (s.size, q.size)))
        assert abs(t[0] - t[1]).sum() < 0.1 and abs(sizes[0] - sizes[1]).max() < 0.06, (goal, t, sizes)
        assert (live == s.t).all() and (np.bincount(np.repeat(every, s.t), s.size) == goal).all() and (s.n == goal).all()
    s.bring(np.where(every % 2, 0, 40))
    assert (s.t[1::2] == 0).all() and (s.n == np.where(every % 2, 0, 40)).all() and (live == s.t).all()
    s.bring(np.full(6000, 40))
    assert (np.bincount(np.repeat(every, s.t), s.size) == 40).all() and (live == s.t).all()


def test_log_gamma():
    x = np.r_[0.01, 0.2, 1.0, 2.5, 7.0, 40.0, 1e6]
    assert np.allclose(P.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_laws_are_the_weights_of_opening():
    """What a block of customers would meet first is what one customer meets."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 40).astype(np.uint32)
    contexts = np.concatenate([np.sort(rng.choice(60, k, replace=False)) for k in sizes]).astype(np.uint16)
    state = {"words": np.diff(np.sort(rng.integers(0, 1 << 60, 40)).astype(np.uint64), prepend=np.uint64(0)), "sizes": sizes, "contexts": contexts, "n": rng.integers(1, 50, len(contexts)).astype(np.uint64)}
    classes = rng.integers(0, 5, P.FREQUENT)
    b = P.Bucket(state, classes)
    x = P.unpack(b.totals(np.ones(len(b.low_count), int), np.ones(len(b.dish_class), int), np.ones(40, int), 0)[3])
    vectors = [x[k].astype(float) for k in ("context_t", "class_n", "class_t")]
    totals = P.Totals(np.bincount(b.low_context, b.low_count, minlength=P.FREQUENT), *vectors, float(x["sums"][0]), float(x["sums"][1]), 40, int(b.count.sum()))
    b.seat(rng, totals, state)
    b.run(2)
    for seats in (b.low, b.high, b.top):
        every = np.arange(len(seats.t))
        assert np.allclose(seats.law(every).at(every, seats.t), seats.opening(every), rtol=1e-9)
    assert (b.high.n == b.n1).all() and (b.top.n == b.n0).all()


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, _, t in corpus(n=20, held=0)] + [(50, None), (51, "")]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d/documents.parquet"))
    out = P.op1(spark, str(tmp_path / "d"))
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == 22
    held = spark.range(60).where(F.crc32(F.col("id").cast("string")) % 10 == 0).toPandas().id.tolist()
    assert sorted(r.doc_id for r in out.where("held_out").collect()) == [i for i in held if i < 20 or i in (50, 51)]


def tables(n, count, d, theta, p, first, seed=3):
    """As dishes(), by numbers of tables alone."""
    live = np.full(count, float(first))
    s = P.Tables(np.random.default_rng(seed), d, np.full(count, n), np.full(count, first), np.zeros(0, int), lambda i: (theta + d * live[i]) * p, lambda i, by: np.add.at(live, i, by), alone(d, theta, p))
    return s, live


@pytest.mark.parametrize("n", [2, 3, 5, 12, 40, P.SMALL])
def test_one_sweep_draws_small_dishes_by_their_law(n):
    """The first sweep already follows the exact law, wherever it starts from."""
    d, theta, p = 0.5, 1.0, 0.4
    s, live = tables(n, 20_000, d, theta, p, n)
    s.sweep()
    assert abs(np.bincount(s.t, minlength=n + 1) / 20_000 - law_of_tables(n, d, theta, p)).sum() < 0.06
    assert (live == s.t).all() and not len(s.size)


def test_small_dishes_grow_and_shrink_by_the_law_of_one_customer():
    """Also past SMALL, where tables get sizes, and back, where they lose them."""
    d, theta, p, every = 0.5, 1.0, 0.4, np.arange(6000)
    (s, live), (q, _) = tables(12, 6000, d, theta, p, 4), dishes(12, 6000, d, theta, p, 1, 9)
    for _ in range(60):  # until the sizes follow the law, too
        q.sweep()
    s.n, s.t = q.n.copy(), q.t.copy()
    live[:] = s.t
    for goal in (20, 7, P.SMALL + 6, 300, 9, 0, 3):
        s.bring(np.full(6000, goal))
        while (by := goal - int(q.n[0])) != 0:
            (q.sit if by > 0 else q.leave)(every)
        t = [np.bincount(x.t, minlength=301) / 6000 for x in (s, q)]
        assert abs(t[0] - t[1]).sum() < 0.13, goal
        assert (live == s.t).all() and (s.n == goal).all() and len(s.size) == (s.t.sum() if goal > P.SMALL else 0)
        if goal > P.SMALL:
            sizes = [np.bincount(x.size, minlength=400) / 6000 for x in (s, q)]
            assert abs(sizes[0] - sizes[1]).max() < 0.11, goal  # three standard errors of some 2.5 tables of one customer


def test_rare_contexts_have_restaurants_of_their_own(spark):
    """Words beyond the FREQUENT most frequent, which share a class: what follows one does not count for another."""
    words, rng = [f"w{k}" for k in range(P.FREQUENT + 50)], random.Random(4)
    rows = [(k, True, " ".join(words[k : k + 700] * 4)) for k in range(0, len(words), 700)]
    for k in range(40):  # contexts that end alike, three times each
        rows += [(10_000 + 3 * k + j, True, f"filler{k}xyz w{7 * k} w{rng.randrange(1000)}") for j in range(3)]
    held = [(20_000 + k, False, t) for k, t in enumerate(("filler1xyz w7", "filler2xyz w7", "filler99xyz w7", "w9 filler1xyz"))]
    df = spark.createDataFrame(rows + held, "doc_id long, training boolean, text string").repartition(4)
    got = {r.doc_id: r.score for r in P.score(df, buckets=3).collect()}
    assert got[20_000] > got[20_001] + 0.5
    model = P.train(df.withColumnRenamed("doc_id", "id"), 1)
    state, rare = P.unpack(bytes(model.states.first().data)), P.unpack(bytes(model.rare.first().data))
    predictive = P.Predictive(state, model.samples, model.classes, rare["t"])
    b, n = predictive.b, state["rare_n"]
    assert model.samples[0].class_more.sum() > 0 and n.sum() == b.rare_count.sum() and (n < 20).all()
    own = P.U(P.word_hash(b"filler1xyz") >> 16)
    assert n[np.searchsorted(b.ids, own)] == 3 and 0 == n[np.searchsorted(b.ids, P.U(P.word_hash(b"filler99xyz") >> 16))]
    for k, t in ((1, state["rt@1"]), (2, rare["t"])):
        tables = P._tables(b.rare_count, state[f"r2@{k}"])
        assert (np.bincount(b.rare_at, tables, minlength=len(n)) == t).all() and (tables <= b.rare_count).all()
        assert (np.bincount(b.dish_class[b.cell_dish[len(b.low_count) :]], tables, minlength=P.CLASSES) == model.samples[k - 1].class_more).all()
    words = np.r_[b.words, P.U(1)]
    context = np.full(len(words), P.FREQUENT + P.class_of(b"filler1xyz"), np.uint16)
    for i in (own, P.U(P.word_hash(b"filler2xyz") >> 16), P.U(P.word_hash(b"filler99xyz") >> 16)):
        p, _ = predictive.probability(words, context, np.full(len(words), i, P.U))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
