"""Logistic regressions side by side: all designs are fitted by the same passes over a compact table, each pass one aggregate
of gradients and outer products."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.sources.tables import settled


@dataclass(frozen=True)
class Fit:
    """rows: those that have the label and all columns of the design; coef is None where these hold one class only."""

    rows: int
    positives: int
    intercept: float | None
    coef: dict[str, float] | None


def standardised(df: DataFrame, columns: Sequence[str], where: Mapping[str, Column] | None = None) -> DataFrame:
    """df with {c}_z: distance from the mean in population deviations, over the rows where the column has a value and, if given,
    where[c] holds; 0 where the deviation is 0. One aggregate serves all columns."""
    value = {c: F.when((where or {}).get(c, F.lit(True)), F.col(c).try_cast("double")) for c in columns}
    row = df.agg(*[f for c in columns for f in (F.avg(value[c]).alias(f"m_{c}"), F.stddev_pop(value[c]).alias(f"s_{c}"))]).first()

    def z(c: str) -> Column:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        return (value[c] - m) / s if s else value[c] * 0.0

    return df.withColumns({f"{c}_z": z(c) for c in columns})


def logistic_fits(df: DataFrame, label: str, designs: Mapping[str, Sequence[str]], strength: float = 1.0, rounds: int = 50, tolerance: float = 1e-11) -> dict[str, Fit]:
    """Coefficients of each design (its columns and an intercept) with an L2 penalty of `strength` / 2 on the columns alone.

    Newton's method: a pass sends designs * columns^2 sums, whatever the number of rows, and all designs that still move are
    in it; a step that makes a design worse is halved. Rows with a null or NaN in a design don't count for it."""
    columns = list(dict.fromkeys(c for d in designs.values() for c in d))
    held = settled(df.select(F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
    at = {d: [columns.index(c) for c in cs] for d, cs in designs.items()}
    beta = {d: np.zeros(len(cs) + 1) for d, cs in designs.items()}
    last: dict[str, tuple] = {}  # the best point so far: loss, coefficients
    out: dict[str, Fit] = {}

    def totals(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {d: np.zeros(3 + len(b) + len(b) ** 2) for d, b in points.items()}
            for batch in batches:
                m = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])
                for d, b in points.items():
                    x = m[:, [0, *[k + 1 for k in at[d]]]]
                    x = x[~np.isnan(x).any(axis=1)]
                    y = x[:, 0].copy()
                    x[:, 0] = 1.0
                    eta = x @ b
                    p = 1 / (1 + np.exp(-eta))
                    sums[d] += np.concatenate([[len(y), y.sum(), (np.logaddexp(0, eta) - y * eta).sum()], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            names = [d for d, s in sums.items() for _ in s]
            places = [k for s in sums.values() for k in range(len(s))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(np.concatenate([*sums.values()]))], names=["design", "place", "value"])

        rows = held.mapInArrow(add, "design string, place int, value double").groupBy("design", "place").agg(F.sum("value").alias("value")).collect()
        found = {d: np.zeros(3 + len(b) + len(b) ** 2) for d, b in points.items()}
        for r in rows:
            found[r["design"]][r["place"]] = r["value"]
        return found

    moving = dict(beta)
    for _ in range(rounds):
        found = totals(moving)
        after = {}
        for d, b in moving.items():
            s, k = found[d], len(b)
            n, pos, ridge = int(s[0]), int(s[1]), np.r_[0.0, np.full(k - 1, strength)]
            if not 0 < pos < n:
                out[d] = Fit(n, pos, None, None)
                continue
            loss = s[2] + strength * (b[1:] ** 2).sum() / 2
            if d in last and loss > last[d][0] + 1e-9 * abs(last[d][0]):
                after[d] = (b + last[d][1]) / 2
                continue
            step = np.linalg.solve(s[3 + k :].reshape(k, k) + np.diag(ridge), s[3 : 3 + k] - ridge * b)
            last[d], new = (loss, b), b + step
            out[d] = Fit(n, pos, float(new[0]), dict(zip(designs[d], new[1:].tolist(), strict=True)))
            if np.abs(step).max() > tolerance:
                after[d] = new
        moving = after
        if not moving:
            break
    return out


def fitted(df: DataFrame, label: str, fits: Mapping[str, Fit], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of df and design that covers it: design, the columns to keep, y and p."""
    def p(f: Fit) -> Column:
        eta = sum((F.lit(b) * F.col(c).cast("double") for c, b in f.coef.items()), F.lit(f.intercept))
        return F.when(~F.isnan(eta), 1 / (1 + F.exp(-eta)))

    each = [F.struct(F.lit(d).alias("design"), p(f).alias("p")) for d, f in fits.items() if f.coef is not None]
    if not each:
        return df.select(F.lit(None).cast("string").alias("design"), *keep, F.col(label).alias("y"), F.lit(None).cast("double").alias("p")).limit(0)
    return df.select(*keep, F.col(label).alias("y"), F.explode(F.array(*each)).alias("__d")).select("__d.design", *keep, "y", "__d.p").where("p is not null and y is not null")
