"""The listwise ranker: boosted trees on gradients of NDCG, and their exact Shapley contributions.

Rows are packed once into blocks of whole openings: bins of the features, gains of the labels, weights. Every
level of a tree is one pass over the blocks: a task scores its rows with the trees so far, takes for every
pair of an opening with different labels the logistic gradient weighted by what swapping the two would change in
NDCG, and adds gradients up by node, feature and bin. Spark sums these histograms; the driver sees only
them (nodes x features x bins) and picks the splits. No row comes to the driver, and none is left out.

Contributions are path-dependent Shapley values: a feature that is not known is averaged over both ways by
the rows that went them in training. For one leaf, the value of a set of known features is a product over the
features on its path, each either met or not by the row, so that a leaf has at most 2 ** depth cases; their
values are worked out once a model, and a row looks its case up.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.features import FEATURES
from matchloom.operators.ranker import gain
from matchloom.sources.tables import written

BINS, DEPTH, TREES, RATE, L2 = 64, 4, 40, 0.15, 1.0
LEAST_ROWS, LEAST_HESSIAN = 10, 1e-3
#: Pairs count when the better placed of the two is among the first TRUNCATION of its opening.
TRUNCATION = 30
BLOCK_ROWS = 20_000


@dataclass
class Tree:
    """Nodes in level order (children of i: 2i + 1 and 2i + 2): feature number (-1: a leaf or none), threshold, value, rows."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature) + 1))):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.threshold[at]))
        return at

    def paths(self) -> Iterator[tuple[int, dict[int, tuple[float, float, float]]]]:
        """Each leaf with, for every feature on its path, (above, up to, share of the rows that go this way where it is not known)."""

        def walk(node: int, held: dict[int, tuple[float, float, float]]) -> Iterator[tuple[int, dict[int, tuple[float, float, float]]]]:
            f = int(self.feature[node])
            if f < 0:
                yield node, held
                return
            low, high, share = held.get(f, (-math.inf, math.inf, 1.0))
            cut = float(self.threshold[node])
            for child, (a, b) in ((2 * node + 1, (low, min(high, cut))), (2 * node + 2, (max(low, cut), high))):
                yield from walk(child, held | {f: (a, b, share * float(self.cover[child] / self.cover[node]))})

        yield from walk(0, {})


@dataclass
class TreeRanker:
    """A sum of trees over the columns `features`, in their order; rows' cells that are no numbers count as 0."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((t.value[t.leaf_of(x)] for t in self.trees), np.zeros(len(x)))

    @property
    def base(self) -> float:
        """The score of a row of which nothing is known."""
        return float(sum(t.value[leaf] * math.prod(share for _, _, share in held.values()) for t in self.trees for leaf, held in t.paths()))

    def cases(self) -> list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """For every leaf: its path's features, their bounds, and the contributions in each case (bit j: feature j's bounds are met)."""
        out = []
        for t in self.trees:
            for leaf, held in t.paths():
                names, shares = list(held), np.array([h[2] for h in held.values()])
                m = len(names)
                table = np.zeros((1 << m, m))
                for case, met in enumerate(itertools.product((0, 1), repeat=m)):
                    met = np.array(met[::-1])
                    for j in range(m):
                        rest = np.array([1.0])  # by how many of the other features are known
                        for i in range(m):
                            if i != j:
                                rest = np.r_[rest * shares[i], 0] + np.r_[0, rest * met[i]]
                        weights = [math.factorial(n) * math.factorial(m - n - 1) / math.factorial(m) for n in range(m)]
                        table[case, j] = t.value[leaf] * (met[j] - shares[j]) * (rest @ weights)
                out.append((names, np.array([h[0] for h in held.values()]), np.array([h[1] for h in held.values()]), table))
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of every row and feature; with the base they add up to the score."""
        out = np.zeros(x.shape)
        for names, low, high, table in self.cases():
            met = (x[:, names] > low) & (x[:, names] <= high)
            out[:, names] += table[met @ (1 << np.arange(len(names)))]
        return out

    def values(self) -> Column:
        return numbers(self.features)

    def score(self) -> Column:
        model = self

        def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array(model.predict(_matrix(column, len(model.features))))

        return F.arrow_udf(scored, "double")(self.values())

    def impacts(self) -> Column:
        """array<double> of contributions in the order of the features."""
        model = self

        def explained(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                made = model.contributions(_matrix(column, len(model.features)))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

        return F.arrow_udf(explained, "array<double>")(self.values())


def numbers(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in columns])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every column but the last bin: quantiles, without repeats."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    values = rows.select(numbers(columns).alias("x"))
    found = values.agg(*[F.percentile_approx(F.col("x")[i], at, 10_000).alias(f"q{i}") for i in range(len(columns))]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def group_blocks(rows: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """Whole openings in blocks of about BLOCK_ROWS rows, written: sizes (rows of each opening), bins, gains, weights, as bytes."""
    own = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    slim = rows.where("job_id is not null and final_label is not null").select(F.col("job_id").cast("string").alias("job"), "retrieval_rank", "resume_id", numbers(columns).alias("x"), F.coalesce(gain(F.col("final_label")), F.lit(0.0)).alias("gain"), own.alias("weight"))
    ordered = slim.repartition("job").sortWithinPartitions("job", "retrieval_rank", "resume_id").select("job", "x", "gain", "weight")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs: list[str] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block(until: int) -> pa.RecordBatch:
            """The first rows, up to the end of an opening; the others are held on."""
            bins, gains, weights = (np.concatenate(p) for p in zip(*parts, strict=True))
            names = np.array(jobs[:until], object)
            sizes = np.diff(np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, until]).astype(np.int64)
            cells = [pa.array([a.tobytes()], pa.binary()) for a in (sizes, bins[:until], gains[:until], weights[:until])]
            del jobs[:until]
            parts[:] = [(bins[until:], gains[until:], weights[until:])]
            return pa.RecordBatch.from_arrays(cells, ["sizes", "bins", "gains", "weights"])

        for batch in batches:
            x = _matrix(batch.column(1), len(edges))
            bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            parts.append((bins, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)))
            jobs += batch.column(0).to_pylist()
            if len(jobs) >= BLOCK_ROWS:
                last = len(jobs) - next((i for i, j in enumerate(reversed(jobs)) if j != jobs[-1]), len(jobs))
                if last:
                    yield block(last)
        if jobs:
            yield block(len(jobs))

    return written(ordered.mapInArrow(packed, "sizes binary, bins binary, gains binary, weights binary"), "group-blocks")


def swap_gradients(scores: np.ndarray, gains: np.ndarray, truncation: int = TRUNCATION) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of one opening's rows: pairs with different gains, weighted by the change of NDCG."""
    g, h = np.zeros(len(scores)), np.zeros(len(scores))
    discount = 1 / np.log2(np.arange(len(scores)) + 2)
    best = float(np.sort(gains)[::-1] @ discount)
    if best <= 0:
        return g, h
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], gains[order]
    top = min(truncation, len(s))
    apart = y[:top, None] - y[None]
    later = np.arange(len(s))[None] > np.arange(top)[:, None]
    change = np.abs(apart) * np.abs(discount[:top, None] - discount[None]) * later / best
    wrong = 1 / (1 + np.exp(np.clip(np.sign(apart) * (s[:top, None] - s[None]), -50, 50)))
    pull, bend = np.sign(apart) * wrong * change, wrong * (1 - wrong) * change
    g[order] = -np.r_[pull.sum(1), np.zeros(len(s) - top)] + pull.sum(0)
    h[order] = np.r_[bend.sum(1), np.zeros(len(s) - top)] + bend.sum(0)
    return g, h


def level_histograms(blocks: DataFrame, columns: int, trees: list[Tree], growing: Tree | None, nodes: list[int], truncation: int) -> dict[tuple[int, int], np.ndarray]:
    """(gradient, curvature, rows) by bin for every node of a level and feature. Trees here split at bins, not values."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(nodes), columns, 256, 3))
        place = {n: i for i, n in enumerate(nodes)}
        for batch in batches:
            for row in batch.to_pylist():
                sizes, gains, weights = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["gains"]), np.frombuffer(row["weights"])
                bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, columns)
                scores = sum((t.value[t.leaf_of(bins)] for t in trees), np.zeros(len(bins)))
                edges = np.r_[0, np.cumsum(sizes)]
                made = [swap_gradients(scores[a:b], gains[a:b], truncation) for a, b in itertools.pairwise(edges)]
                values = np.stack([np.concatenate([m[0] for m in made]) * weights, np.concatenate([m[1] for m in made]) * weights, np.ones(len(bins))])
                at = growing.leaf_of(bins) if growing else np.zeros(len(bins), np.int64)
                for node in np.unique(at):
                    if int(node) in place:
                        own = at == node
                        for f in range(columns):
                            for c in range(3):
                                sums[place[int(node)], f, :, c] += np.bincount(bins[own, f], values[c, own], 256)
        n, f, b = np.nonzero(sums[..., 2])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int32)[n]), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(sums[n, f, b, c]) for c in range(3)]], ["node", "feature", "bin", "g", "h", "rows"])

    found = blocks.mapInArrow(counted, "node int, feature int, bin int, g double, h double, rows double").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "rows")])
    out = {(n, f): np.zeros((256, 3)) for n in nodes for f in range(columns)}
    for r in found.collect():
        out[r["node"], r["feature"]][r["bin"]] = (r["g"], r["h"], r["rows"])
    return out


def best_split(histograms: list[np.ndarray], l2: float, least_rows: int) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, bin, left sums, right sums) of a node's best split, ties to the first feature and bin; None if none gains."""
    best = None
    for f, sums in enumerate(histograms):
        left = np.cumsum(sums, axis=0)
        right = left[-1] - left
        fits = (left[:, 2] >= least_rows) & (right[:, 2] >= least_rows) & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN)
        score = np.where(fits, left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - left[-1, 0] ** 2 / (left[-1, 1] + l2), 0.0)
        b = int(np.argmax(np.round(score, 9)))
        if score[b] > 1e-9 and (best is None or score[b] > best[0] + 1e-9):
            best = (float(score[b]), f, b, left[b], right[b])
    return best


def grown_tree(blocks: DataFrame, columns: int, trees: list[Tree], depth: int, rate: float, l2: float, least_rows: int, truncation: int) -> Tree:
    """One more tree, level by level; thresholds are bins."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(size))
    nodes = [0]
    for level in range(depth):
        histograms = level_histograms(blocks, columns, trees, tree if level else None, nodes, truncation)
        following = []
        for node in nodes:
            own = [histograms[node, f] for f in range(columns)]
            if not level:
                g, h, tree.cover[0] = own[0].sum(0)
                tree.value[0] = -rate * g / (h + l2)
            split = best_split(own, l2, least_rows)
            if split:
                _, tree.feature[node], tree.threshold[node], *sides = split
                for child, (g, h, rows) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                    tree.value[child], tree.cover[child] = -rate * g / (h + l2), rows
                    following.append(child)
        nodes = following
        if not nodes:
            break
    return tree


def fit_trees(
    rows: DataFrame, columns: list[str] = FEATURES, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, bins: int = BINS,
    least_rows: int = LEAST_ROWS, truncation: int = TRUNCATION, edges: list[np.ndarray] | None = None,
) -> TreeRanker:
    """Fit on labelled pairs: job_id, resume_id, retrieval_rank, final_label, the feature columns, and perhaps row weights (weight).

    Rows without a job or label are left out; openings with one label add nothing. Stops early when no split gains.
    """
    if bins > 256 or depth > 8:
        raise ValueError("at most 256 bins and 8 levels")
    edges = bin_edges(rows, columns, bins) if edges is None else edges
    blocks = group_blocks(rows, columns, edges)
    made: list[Tree] = []
    for _ in range(trees):
        tree = grown_tree(blocks, len(columns), made, depth, rate, l2, least_rows, truncation)
        if tree.feature[0] < 0:
            break
        made.append(tree)

    def by_value(t: Tree) -> Tree:
        """The tree with values for bins: a bin's rows are at most its upper edge; the last bin has none, and is never split off."""
        cuts = [edges[f][int(b)] if f >= 0 else 0.0 for f, b in zip(t.feature, t.threshold, strict=True)]
        return Tree(t.feature, np.array(cuts), t.value, t.cover)

    return TreeRanker(list(columns), [by_value(t) for t in made])
