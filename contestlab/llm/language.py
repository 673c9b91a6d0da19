"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by stochastic
gradient descent in numpy, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.llm.common import read

#: Hash buckets of subwords, embedding width, subword lengths in characters.
BUCKETS, WIDTH, ORDERS = 4096, 16, (2, 3, 4)
#: Bound of the labelled rows that training reads, over all languages; each language has an equal part of it.
TRAIN_ROWS = 4000
#: Every so many-th sampled row is held back from training to calibrate the temperature and the rejection.
CALIBRATE = 4
#: Share of the calibration rows, rightly predicted, that rejection may cost at most.
REJECT_SHARE = 0.001
EPOCHS, RATE, BATCH, SEED = 30, 4.0, 32, 5
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")
#: Odd multipliers of the rolling hash, fixed so that models and predictions agree.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def normal(text: str) -> str:
    """Lower case, with one space for each run of characters that are no letters; empty if there is no letter."""
    t = OTHER.sub(" ", text.lower()).strip()
    return f" {t} " if t else ""


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of each subword of normalised texts, and the index of its text; none reaches across two words."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    within = points != 10
    gap = points == 32
    buckets, owners = [], []
    h = points * MIX[0]
    for n in range(2, max(ORDERS) + 1):
        # a subword may start or end with a space, but has none inside
        within = within[:-1] & (points[n - 1 :] != 10)
        if n > 2:
            within = within & ~gap[n - 2 : len(gap) - 1]
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MIX[n - 1] + points[n - 1 :]
        if n in ORDERS:
            x = h[within]
            buckets.append(((x ^ (x >> np.uint32(16))) * MIX[1] >> np.uint32(20)).astype(np.int32) % BUCKETS)
            owners.append(owner[: len(within)][within])
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(t: str) -> bool:
    return any(c.isalpha() for c in t)


@dataclass
class Model:
    """weights: log-odds of a language by bucket, embeddings and softmax multiplied out (bounded by BUCKETS rows)."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        b, o = subwords(texts)
        n = np.bincount(o, minlength=len(texts))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(o, self.weights[b, k], minlength=len(texts))
        return out / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and rejection of each text; `und`, 0 and rejected without a letter or a model."""
        clean = [normal(t or "") for t in texts]
        known = np.array([bool(c) and (c.isascii() or has_letter(c)) for c in clean], bool)
        if not self.langs or not len(clean):
            return [UNKNOWN] * len(clean), np.zeros(len(clean)), np.ones(len(clean), bool)
        p = softmax(self.logits(clean) / self.temperature)
        best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score, ~known | (score < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(counts: np.ndarray, labels: np.ndarray, langs: list[str]) -> Model:
    """counts: rows x BUCKETS subword counts (normalised in place); labels: index of the language."""
    rng = np.random.default_rng(SEED)
    x = counts.astype(np.float32, copy=False)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    held = np.arange(len(x)) % CALIBRATE == CALIBRATE - 1 if len(x) >= 20 * CALIBRATE else np.zeros(len(x), bool)
    own = np.flatnonzero(~held)
    e, w, b = rng.normal(0, 0.1, (x.shape[1], WIDTH)).astype(np.float32), np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    y = np.eye(len(langs), dtype=np.float32)[labels]
    steps, step = max(1, EPOCHS * -(-len(own) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for s in range(0, len(own), BATCH):
            i = own[s : s + BATCH]
            hidden = x[i] @ e
            g = (softmax(hidden @ w + b) - y[i]).astype(np.float32) / len(i)
            rate = np.float32(RATE * (1 - step / steps))
            back = x[i].T @ (g @ w.T)
            w -= rate * (hidden.T @ g)
            b -= rate * np.float32(0.1) * g.sum(0)
            e -= rate * np.float32(x.shape[1] ** 0.5) * back
            step += 1
    model = Model(langs, (e @ w).astype(np.float64), b.astype(np.float64))
    if held.any():
        z, truth = x[held] @ model.weights + model.bias, labels[held]
        temperatures = np.geomspace(0.05, 20, 60)
        losses = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(losses))])
        p = softmax(z / model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == truth])
        if len(right):
            # never above 1 / 2: a text for which one language is likelier than all others together is not rejected
            model.threshold = min(0.5, float(right[int(REJECT_SHARE * len(right))]))
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Learn from a sample of at most about `rows` rows of docs with text and language, spread evenly over languages and
    chosen by a hash of key. Whole texts are read; tasks count their subwords, so the driver gets BUCKETS counts a row."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.lit(0.0)
    for name in langs:
        most = F.when(F.col(lang) == name, min(1.0, rows / len(langs) / sizes[name])).otherwise(most)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                c = np.bincount(subwords([normal(t)])[0], minlength=BUCKETS)
                at = np.flatnonzero(c)
                out.append((at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pd.DataFrame({"k": b["k"], "l": b["l"], "at": [x[0] for x in out], "c": [x[1] for x in out]})

    sample = usable.where(chance < most).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    got = sorted(sample.mapInPandas(count, "k string, l string, at binary, c binary").collect(), key=lambda r: (r["l"], r["k"] or "", bytes(r["at"])))
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["c"], "<u4")
    return train(counts, np.array([langs.index(r["l"]) for r in got], np.int64), langs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_rejected (unsure beyond the calibrated threshold, or nothing to
    go by). Null, empty or letterless text: `und`, 0, rejected. Texts are read whole; repeated rows are judged alike.
    An empty table gives an empty result. Columns of docs that bear one of these names are replaced."""
    rest = docs.drop("lang_pred", "lang_score", "lang_rejected")

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            parts = [model.predict(list(t.iloc[s : s + 256])) for s in range(0, len(t), 256)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "lang_score": [x for p in parts for x in p[1]], "lang_rejected": [x for p in parts for x in p[2]]})

    return rest.withColumn("__l", judge(F.col(text))).select("*", "__l.*").drop("__l")


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False)))


def held_out(key: Column, n: int, rest: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % n == rest, F.lit(False))


def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.drop("lang"), fit(training_part(docs)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op6_language_id": op6}
