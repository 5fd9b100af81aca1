"""Additive models of many folds, feature sets and settings from one aggregation.

A ridge regression needs its rows only through products of columns. One pass sums these for each training side (the complement of a fold, or all rows) and number of
bins, over all features; every feature set and ridge is then a part of a matrix and a small solve on the driver. Sizes there follow from features and bins, not from rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The name of the side that leaves no fold out.
ALL = "all rows"
_BLOCK = 4096


def side_cuts(rows: DataFrame, features: list[str], fold: str, sides: list[str], bins: list[int]) -> dict[tuple[str, int], dict[str, list[float]]]:
    """For each training side and number of bins, each feature's quantile cuts by the rows of that side alone, in one aggregation. Sides are folds left out, or ALL."""
    shares = {b: [k / b for k in range(1, b)] for b in bins}
    long = rows.unpivot([fold], features, "feature_name", "value").where("value is not null and not isnan(value)")
    of_sides = long.withColumn("side", F.explode(F.filter(F.array(*[F.lit(s) for s in sides]), lambda s: s != F.col(fold))))
    found = of_sides.groupBy("side", "feature_name").agg(*[F.percentile_approx("value", F.array(*map(F.lit, q)), 1000).alias(f"b{b}") for b, q in shares.items()]).collect()
    cuts: dict = {(s, b): {f: [] for f in features} for s in sides for b in bins}
    for r in found:
        for b in bins:
            cuts[r.side, b][r.feature_name] = sorted(set(r[f"b{b}"] or []))
    return cuts


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Columns of values as bins: 0 for a missing one, else 1 plus the number of cuts at or below it."""
    out = np.zeros(values.shape, np.int64)
    for k, c in enumerate(cuts):
        known = ~np.isnan(values[:, k])
        out[known, k] = 1 + np.searchsorted(np.array(c, float), values[known, k], "right")
    return out


@dataclass(frozen=True)
class Side:
    """Sums of products of a side's columns: one for each bin of each feature, then 1, then the label."""

    cuts: dict[str, list[float]]
    starts: dict[str, int]
    products: np.ndarray

    def support(self, feature: str) -> int:
        """Rows in which the feature is known."""
        at = self.starts[feature]
        return int(self.products[-2, -2] - self.products[at, at])

    def fit(self, features: list[str], ridge: float) -> tuple[dict[str, np.ndarray], float]:
        """(terms by bin of each feature, intercept) of the ridge regression on these features, its penalty on columns scaled to a deviation of 1.

        Bins that no row of the side fills have a term of 0; so has all where the label does not vary.
        """
        columns = [self.starts[f] + k for f in features for k in range(len(self.cuts[f]) + 2)]
        n, p = self.products[-2, -2], self.products
        mean, of_label = p[columns, -2] / n, p[-1, -2] / n
        spread = p[columns, columns] / n - mean**2
        label_spread = max(p[-1, -1] / n - of_label**2, 0.0)
        used = np.flatnonzero(spread > 1e-12)
        weights = np.zeros(len(columns))
        if len(used) and label_spread > 0:
            at = np.array(columns)[used]
            products = p[np.ix_(at, at)] / n - np.outer(mean[used], mean[used])
            products[np.diag_indices(len(at))] += ridge / np.sqrt(label_spread) * spread[used]
            weights[used] = np.linalg.lstsq(products, p[at, -1] / n - mean[used] * of_label, rcond=None)[0]
        ends = np.cumsum([0, *[len(self.cuts[f]) + 2 for f in features]])
        return {f: weights[a:b] for f, a, b in zip(features, ends, ends[1:], strict=False)}, float(of_label - weights @ mean)


def _starts(cuts: dict[str, list[float]]) -> tuple[dict[str, int], int]:
    ends = np.cumsum([0, *[len(c) + 2 for c in cuts.values()]]).tolist()
    return dict(zip(cuts, ends, strict=False)), ends[-1]


def side_sums(rows: DataFrame, features: list[str], label: str, fold: str, cuts: dict[tuple[str, int], dict[str, list[float]]]) -> dict[tuple[str, int], Side]:
    """The products of every side and number of bins in cuts, in one pass over rows with a label: tasks multiply blocks, and sums of like cells meet in a shuffle."""
    keys = list(cuts)
    layout = [_starts(cuts[k]) for k in keys]

    def multiplied(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((width + 2, width + 2)) for _, width in layout]
        for batch in frames:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                of_fold = np.array(part.column(0).to_pylist())
                y = part.column(1).to_numpy(zero_copy_only=False)
                values = np.column_stack([part.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))])
                for k, (side, _) in enumerate(keys):
                    mine = of_fold != side
                    places = binned(values[mine], list(cuts[keys[k]].values())) + np.array(list(layout[k][0].values()))
                    z = np.zeros((len(places), layout[k][1] + 2))
                    np.put_along_axis(z, places, 1.0, axis=1)
                    z[:, -2], z[:, -1] = 1.0, y[mine]
                    sums[k] += z.T @ z
        for k, s in enumerate(sums):
            i, j = np.nonzero(np.triu(s))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["k", "i", "j", "v"])

    told = rows.where(F.col(label).isNotNull()).select(F.col(fold).cast("string"), F.col(label).cast("double"), *[F.col(f).cast("double") for f in features])
    cells = told.mapInArrow(multiplied, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, key in enumerate(keys):
        mine, width = cells[cells.k == k], layout[k][1]
        products = np.zeros((width + 2, width + 2))
        products[mine.i, mine.j] = mine.v
        out[key] = Side(cuts[key], layout[k][0], products + np.triu(products, 1).T)
    return out


def scored(rows: DataFrame, key: str, features: list[str], label: str, fold: str, sides: dict[tuple[str, int], Side], fitted: list[tuple[str, int, str, dict, float]]) -> DataFrame:
    """(key, fold, model, label, predicted): each row by every fitted model (side, bins, name, terms, intercept) whose side is the row's fold, in one pass."""
    models = [(side, b, name, sides[side, b].cuts, terms, intercept) for side, b, name, terms, intercept in fitted]

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[features].to_numpy(float)
            for side, _, name, cuts, terms, intercept in models:
                mine = (frame[fold] == side).to_numpy()
                if mine.any():
                    places = binned(values[np.ix_(mine, [features.index(f) for f in terms])], [cuts[f] for f in terms])
                    score = intercept + sum((t[places[:, k]] for k, t in enumerate(terms.values())), np.zeros(mine.sum()))
                    yield pd.DataFrame({key: frame[key][mine], fold: side, "model": name, label: frame[label][mine], "predicted": score})

    kind = rows.schema[key].dataType.simpleString()
    told = rows.select(key, F.col(fold).cast("string").alias(fold), F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features])
    return told.mapInPandas(predicted, f"`{key}` {kind}, `{fold}` string, model string, `{label}` double, predicted double")
