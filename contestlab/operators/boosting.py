"""Boosted trees for many models at once: folds, slices and the model of all rows grow level by level together, each level one
pass over a compact table of binned features that adds up gradient histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.operators.ranks import exact_quantiles
from contestlab.sources.tables import settled

#: Models that may grow together; what the driver holds is this times the nodes of a tree.
MOST_MODELS = 4096
#: Bins of a feature by its quantiles; bin 0 is for missing values, which go to the left.
BINS = 32
#: Shrinkage of a tree, L2 strength of leaf values, rows that a side of a split has at least.
RATE, LEAF_STRENGTH, LEAST_ROWS = 0.1, 1.0, 20


@dataclass
class Trees:
    """Trees by model: arrays [tree][model, node]; the children of node k are 2k + 1 and 2k + 2. A feature of -1 ends there."""

    names: list[str]
    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    rows: np.ndarray
    positives: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Rows by features: 0 for missing, else 1 and the number of edges below the value."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, x in enumerate(columns):
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[k], x, "left"))
        return out

    def walk(self, t: int, bins: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
        """The node of tree t where each (row, model) ends."""
        node, feature, cut = np.zeros(len(row), np.int64), self.feature[t], self.cut[t]
        while True:
            f = feature[model, node]
            if not (go := f >= 0).any():
                return node
            right = bins[row, f] > cut[model, node]
            node = np.where(go, 2 * node + 1 + right, node)

    def scores(self, bins: np.ndarray, row: np.ndarray, model: np.ndarray, trees: int | None = None) -> np.ndarray:
        s = self.base[model].copy()
        for t in range(len(self.feature) if trees is None else trees):
            s += self.value[t][model, self.walk(t, bins, row, model)]
        return s

    def probabilities(self, df: DataFrame, wanted: Column, name: str = "p") -> DataFrame:
        """df with an array of the probabilities by the wanted models (an array of names); null for names that have no model."""
        number = {n: k for k, n in enumerate(self.names)}
        own = df.columns
        held = df.withColumns({"__x": F.array(*[F.col(c).cast("double") for c in self.features]), "__w": wanted})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b["__x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(self.features))
                sizes = b["__w"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                named = b["__w"].flatten().dictionary_encode()
                row = np.repeat(np.arange(b.num_rows), sizes)
                own_model = np.array([*[number.get(n, -1) for n in named.dictionary.to_pylist()], -1], np.int64)
                model = own_model[named.indices.fill_null(len(own_model) - 1).to_numpy(zero_copy_only=False)]
                known = model >= 0
                p = np.full(len(row), np.nan)
                p[known] = 1 / (1 + np.exp(-self.scores(self.bins(list(x.T)), row[known], model[known])))
                ends = np.cumsum([0, *sizes])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p, mask=~known))
                yield pa.RecordBatch.from_arrays([*[b[c] for c in own], lists], names=[*own, name])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return held.mapInArrow(score, f"{schema}, `{name}` array<double>")

    def importance(self) -> list[tuple[str, str, float, int]]:
        """(model, feature, gain, splits), summed over trees."""
        out = []
        for m, name in enumerate(self.names):
            for k, f in enumerate(self.features):
                hit = [self.feature[t][m] == k for t in range(len(self.feature))]
                out.append((name, f, float(sum(self.gain[t][m][h].sum() for t, h in enumerate(hit))), int(sum(h.sum() for h in hit))))
        return out


def _best_splits(strength: float, least_rows: int):
    """For each model and node the split with the largest gain among the bins of all features, and the sums of its sides."""

    def best(h: pd.DataFrame) -> pd.DataFrame:
        out = None
        for f, one in h.sort_values(["feature", "bin"]).groupby("feature"):
            g, w, n = (one[c].cumsum().to_numpy() for c in ("g", "h", "n"))
            all_g, all_w, all_n = g[-1], w[-1], n[-1]
            gain = g**2 / (w + strength) + (all_g - g) ** 2 / (all_w - w + strength) - all_g**2 / (all_w + strength)
            gain = np.where((n >= least_rows) & (all_n - n >= least_rows), gain, -np.inf)[:-1]
            if out is None:
                out = [-1, 0, 0.0, all_g, all_w, 0.0, 0.0]
            if len(gain) and gain.max() > max(out[2], 1e-12):
                k = int(gain.argmax())
                out = [int(f), int(one["bin"].iloc[k]), float(gain[k]), g[k], w[k], all_g - g[k], all_w - w[k]]
        key = h.iloc[0]
        return pd.DataFrame([[int(key["model"]), int(key["node"]), *out]], columns=["model", "node", "feature", "cut", "gain", "g_left", "h_left", "g_right", "h_right"])

    return best


def grow(df: DataFrame, features: Sequence[str], label: str, members: Column, iterations: int = 10, depth: int = 4, rate: float = RATE, strength: float = LEAF_STRENGTH, least_rows: int = LEAST_ROWS, bins: int = BINS) -> Trees:
    """Trees of every model that `members` (an array of names for each row: the models that learn from it) names.

    Features are cut into bins at exact quantiles, and the rows, and their table of bins, labels and models with rows of equal bins
    and models as one, are written once. For each level of a
    tree a task walks its rows down the trees so far and adds up gradients by model, node, feature and bin; Spark sums
    these and picks the best splits, of which the driver gets one for each model and node. So the number of passes is trees
    times levels, for one model as for all, and no state is kept by row. Rows with a null label are left out; null and NaN
    features are missing values."""
    learning = settled(df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), members.alias("models"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]))
    one = lambda k: F.struct(F.lit(k).alias("k"), F.nanvl(F.col(f"x{k}"), F.lit(None).cast("double")).alias("v"))
    long = learning.select(F.explode(F.array(*[one(k) for k in range(len(features))])).alias("x")).select("x.*")
    probs = [i / bins for i in range(1, bins)]
    cuts = {r["k"]: np.unique(r["quantiles"]) for r in exact_quantiles(long, ["k"], "v", probs).collect()}
    stats = learning.select("y", F.explode("models").alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).orderBy("model").limit(MOST_MODELS + 1).collect()
    if len(stats) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    n, k = np.array([r["n"] for r in stats], float), np.array([r["k"] for r in stats], float)
    share = np.clip(k / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    trees = Trees([r["model"] for r in stats], list(features), [cuts.get(i, np.zeros(0)) for i in range(len(features))], np.log(share / (1 - share)), n, k)
    if not stats:
        return trees
    number = {name: m for m, name in enumerate(trees.names)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            binned = trees.bins([b[f"x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            ids = [[number[x] for x in ms or ()] for ms in b["models"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array([r.tobytes() for r in binned], pa.binary()), pa.array(ids, pa.list_(pa.int32()))], names=["y", "bins", "models"])

    packed = learning.where(F.size("models") > 0).mapInArrow(pack, "y double, bins binary, models array<int>")
    # rows of equal bins and models walk the same way: one row with their number and the sum of their labels
    held = settled(packed.groupBy("bins", "models").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("y").alias("y")))
    nodes, width = 2 ** (depth + 1) - 1, bins + 1
    for t in range(iterations):
        trees.feature.append(np.full((len(stats), nodes), -1, np.int64))
        trees.cut.append(np.zeros((len(stats), nodes), np.int64))
        trees.value.append(np.zeros((len(stats), nodes)))
        trees.gain.append(np.zeros((len(stats), nodes)))
        for level in range(depth):
            splits = _level(held, trees, t, level, width, strength, least_rows)
            for r in splits:
                m, node = r["model"], r["node"]
                if r["feature"] < 0:
                    trees.value[t][m, node] = -rate * r["g_left"] / (r["h_left"] + strength)
                    continue
                trees.feature[t][m, node], trees.cut[t][m, node], trees.gain[t][m, node] = r["feature"], r["cut"], r["gain"]
                trees.value[t][m, 2 * node + 1] = -rate * r["g_left"] / (r["h_left"] + strength)
                trees.value[t][m, 2 * node + 2] = -rate * r["g_right"] / (r["h_right"] + strength)
            if not any(r["feature"] >= 0 for r in splits):
                break
    return trees


def _level(held: DataFrame, trees: Trees, t: int, level: int, width: int, strength: float, least_rows: int) -> list:
    """The splits of all nodes of one level of tree t."""
    count, first = len(trees.features), 2**level - 1

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            bins = np.frombuffer(b"".join(b["bins"].to_pylist()), np.uint8).reshape(b.num_rows, count)
            lists = b["models"]
            model, ends = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(b.num_rows), ends)
            node = trees.walk(t, bins, row, model)
            here = node >= first  # others have ended above
            row, model, node = row[here], model[here], node[here]
            p = 1 / (1 + np.exp(-trees.scores(bins, row, model, t)))
            m, y = b["m"].to_numpy()[row], b["y"].to_numpy()[row]
            g, h = m * p - y, m * p * (1 - p)
            place = (model * (first + 1) + node - first) * count
            keys = ((place[:, None] + np.arange(count)) * width + bins[row]).ravel()
            u, at = np.unique(keys, return_inverse=True)
            part = np.stack([np.bincount(at, np.repeat(x, count)) for x in (g, h, m)], axis=1)
            for key, s in zip(u.tolist(), part, strict=True):
                sums[key] = sums[key] + s if key in sums else s
        keys, s = np.array([*sums], np.int64), np.array([*sums.values()]).reshape(len(sums), 3)
        node, f = keys // width // count, keys // width % count
        yield pa.RecordBatch.from_arrays([pa.array(node // (first + 1)), pa.array(node % (first + 1) + first), pa.array(f), pa.array(keys % width), *[pa.array(s[:, i].copy()) for i in range(3)]], names=["model", "node", "feature", "bin", "g", "h", "n"])

    table = held.mapInArrow(histograms, "model long, node long, feature long, bin long, g double, h double, n double")
    table = table.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    best = table.groupBy("model", "node").applyInPandas(_best_splits(strength, least_rows), "model long, node long, feature long, cut long, gain double, g_left double, h_left double, g_right double, h_right double")
    return best.collect()
