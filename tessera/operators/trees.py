"""Trees on binned features: gradient boosting, with samples of rows and columns and an L2 penalty, and bagged forests.

Trees are grown from a bounded sample of the labelled rows, with sums per bin,
node and feature: boosting's on the driver, one after the other, a forest's by
the executors, side by side. They score pairs in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64


def sample(labeled: DataFrame, features: tuple[str, ...], weight: str, key: tuple[str, ...], seed: int, fit_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the labelled rows; of more than fit_rows rows a sample by a hash of the key."""
    n = labeled.count()
    draw = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    if n > fit_rows:
        labeled = labeled.filter(F.pmod(draw, F.lit(n)) < fit_rows)
    got = labeled.select(draw.alias("_draw"), F.col("label").cast("int").alias("_y"), F.col(weight).alias("_w"), *features).toPandas()
    got = got.sort_values(["_draw", "_y", *features], kind="stable")
    return np.nan_to_num(got[list(features)].to_numpy(dtype=float)), got["_y"].to_numpy(dtype=float), got["_w"].to_numpy(dtype=float)


def bin_edges(x: np.ndarray) -> list[list[float]]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).tolist() if len(x) else [] for j in range(x.shape[1])]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(c), x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), dtype=np.int64)


@dataclass
class Boosting:
    """What grows the trees. fit_rows bounds the sample; a smaller table is used whole."""

    rounds: int = 600
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    penalty: float = 1.0
    least_weight: float = 1.0
    seed: int = 42
    fit_rows: int = 200_000

    def fit(self, labeled: DataFrame, features: tuple[str, ...], weight: str, key: tuple[str, ...] = ("src_id", "cand_id")) -> Trees:
        """labeled: features, label 0 or 1, weight."""
        return self.grow(*sample(labeled, features, weight, key, self.seed, self.fit_rows))

    def grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        r = np.random.default_rng(self.seed)
        n, width = x.shape
        cuts = bin_edges(x)
        bins = binned(x, cuts)
        trees = Trees(cuts)
        margin = np.zeros(n)
        for _ in range(self.rounds if n else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            used = r.random(n) < self.rows
            g, h = np.where(used, g, 0.0), np.where(used, h, 0.0)
            columns = np.sort(r.permutation(width)[: max(1, round(self.columns * width))])
            margin += trees.add(*self._tree(bins, g, h, columns), bins)
        return trees

    def _tree(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, value) of the nodes of a full binary tree; feature -1 is a leaf. Rows of a bin up to the node's go left."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        node = np.zeros(len(g), dtype=np.int64)
        for level in range(self.depth + 1):
            first, count = 2**level - 1, 2**level
            at = node - first
            here = (at >= 0) & (at < count)
            if not here.any():
                break
            a, gh, hh = at[here], g[here], h[here]
            sum_g, sum_h = np.bincount(a, gh, minlength=count), np.bincount(a, hh, minlength=count)
            value[first : first + count] = -self.rate * sum_g / (sum_h + self.penalty)
            if level == self.depth:
                break
            best, best_feature, best_cut = np.full(count, 1e-9), np.full(count, -1), np.zeros(count, dtype=np.int64)
            whole = sum_g**2 / (sum_h + self.penalty)
            for j in columns:
                cell = a * BINS + bins[here, j]
                left_g = np.cumsum(np.bincount(cell, gh, minlength=count * BINS).reshape(count, BINS), axis=1)
                left_h = np.cumsum(np.bincount(cell, hh, minlength=count * BINS).reshape(count, BINS), axis=1)
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - whole[:, None]
                gain[(left_h < self.least_weight) | (right_h < self.least_weight)] = -1.0
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], best_feature[better], best_cut[better] = top[better], j, k[better]
            feature[first : first + count], cut[first : first + count] = best_feature, best_cut
            rows = np.flatnonzero(here)
            rest = feature[node[rows]] < 0
            node[rows[rest]] = size  # at rest in a leaf
            rows = rows[~rest]
            right = bins[rows, feature[node[rows]]] > cut[node[rows]]
            node[rows] = 2 * node[rows] + 1 + right
        return feature, cut, value


@dataclass
class Trees:
    cuts: list[list[float]]
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, bins: np.ndarray) -> np.ndarray:
        self.nodes.append((feature, cut, value))
        return self._margin(self.nodes[-1], bins)

    @staticmethod
    def _margin(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows := rows[feature[node[rows]] >= 0]):
            right = bins[rows, feature[node[rows]]] > cut[node[rows]]
            node[rows] = 2 * node[rows] + 1 + right
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        margin = np.zeros(len(x))
        for tree in self.nodes:
            margin += self._margin(tree, bins)
        return 1 / (1 + np.exp(-margin))

    def score(self, features: tuple[str, ...]) -> Column:
        """The probability of label 1 as a column."""
        return scored(self, features)


def scored(model, features: tuple[str, ...]) -> Column:
    @F.pandas_udf("double")
    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.probability(np.nan_to_num(x.to_numpy(dtype=float))))

    return probability(F.struct(*[F.col(f).cast("double") for f in features]))


@dataclass
class Forest:
    """Bagged trees by Gini impurity, each grown by one task from the sample, which is broadcast: fit_rows bounds it."""

    trees: int = 400
    depth: int = 30
    columns: int | None = None  # at each node; the root of their number if None
    seed: int = 42
    fit_rows: int = 50_000

    def fit(self, labeled: DataFrame, features: tuple[str, ...], weight: str, key: tuple[str, ...] = ("src_id", "cand_id")) -> GrownForest:
        spark = labeled.sparkSession
        x, y, w = sample(labeled, features, weight, key, self.seed, self.fit_rows)
        cuts = bin_edges(x)
        held = spark.sparkContext.broadcast((binned(x, cuts).astype(np.int8), y, w))

        def run(batches):
            for batch in batches:
                yield pd.DataFrame([{"tree": t, **{n: a.tobytes() for n, a in zip(_PARTS, self.grow(*held.value, int(t)), strict=True)}} for t in batch["id"]])

        tasks = max(1, min(self.trees, spark.sparkContext.defaultParallelism))
        grown = spark.range(0, self.trees, 1, tasks).mapInPandas(run, "tree long, " + ", ".join(f"{n} binary" for n in _PARTS)).orderBy("tree").collect()
        return GrownForest(cuts, [tuple(np.frombuffer(r[n], dtype=d) for n, d in _PARTS.items()) for r in grown])

    def grow(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int) -> tuple[np.ndarray, ...]:
        """(feature, cut, left, value) of the nodes; feature -1 is a leaf, the right child follows the left one. Level by level, all nodes of a level at once."""
        r = np.random.default_rng([self.seed, tree])
        n, width = bins.shape
        columns = self.columns or max(1, int(width**0.5))
        w = w * np.bincount(r.integers(0, n, n), minlength=n) if n else w
        rows = np.flatnonzero(w > 0)
        at = np.zeros(len(rows), dtype=np.int64)
        feature, cut, left, value = [], [], [], []
        made, count = 0, 1  # nodes of earlier levels and of this one
        for level in range(self.depth + 1):
            whole, ones = np.bincount(at, w[rows], minlength=count), np.bincount(at, (w * y)[rows], minlength=count)
            p = np.divide(ones, whole, out=np.zeros(count), where=whole > 0)
            value.append(p)
            best, best_feature, best_cut = np.full(count, 1e-12), np.full(count, -1), np.zeros(count, dtype=np.int64)
            if level < self.depth:
                drawn = np.argsort(r.random((count, width)), axis=1)[:, :columns]
                allowed = np.zeros((count, width), dtype=bool)
                allowed[np.arange(count)[:, None], drawn] = True
                impure = (p > 0) & (p < 1)
                for j in range(width):
                    cell = at * BINS + bins[rows, j]
                    lw = np.cumsum(np.bincount(cell, w[rows], minlength=count * BINS).reshape(count, BINS), axis=1)
                    lo = np.cumsum(np.bincount(cell, (w * y)[rows], minlength=count * BINS).reshape(count, BINS), axis=1)
                    rw, ro = whole[:, None] - lw, ones[:, None] - lo
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = lo**2 / lw + ro**2 / rw - (ones**2 / whole)[:, None]
                    gain[(lw <= 1e-9) | (rw <= 1e-9) | ~np.isfinite(gain)] = -1.0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(count), k]
                    better = (top > best) & allowed[:, j] & impure
                    best[better], best_feature[better], best_cut[better] = top[better], j, k[better]
            splits = best_feature >= 0
            child = np.cumsum(splits) * 2 - 2
            feature.append(best_feature)
            cut.append(best_cut)
            left.append(np.where(splits, made + count + child, 0))
            on = splits[at]
            rows, at = rows[on], at[on]
            if not len(rows):
                break
            at = child[at] + (bins[rows, best_feature[at]] > best_cut[at])
            made, count = made + count, 2 * int(splits.sum())
        return tuple(np.concatenate(a).astype(d) for a, d in zip((feature, cut, left, value), _PARTS.values(), strict=True))


_PARTS = {"feature": np.int8, "cut": np.int8, "left": np.int32, "value": np.float32}


@dataclass
class GrownForest:
    cuts: list[list[float]]
    trees: list[tuple[np.ndarray, ...]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' shares of label 1."""
        bins = binned(x, self.cuts)
        out = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            rows = np.arange(len(x))
            while len(rows := rows[feature[node[rows]] >= 0]):
                here = node[rows]
                node[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
            out += value[node]
        return out / max(1, len(self.trees))

    def score(self, features: tuple[str, ...]) -> Column:
        return scored(self, features)
