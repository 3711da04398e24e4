"""Boosted trees for two classes, fitted on rows kept as bin numbers.

The algorithm is that of Spark ML's ``GBTClassifier`` (log loss, the first tree whole, the
others times ``step``, variance splits at some 31 cuts a feature, the cuts from Spark's
sample of some 10,000 rows); every row is used for every tree. Spark ML keeps a row of
30 features as some 600 bytes and reads it again row by row for each level. Here a row is a
byte a feature, written once to the checkpoint folder; each level of each tree is one map over
blocks of rows that counts rows and adds up residuals per node, feature and bin. A level
gathers these sums, never rows. The residuals follow from the trees before, so that nothing is
written again. Sums depend on how rows are dealt to partitions only in the last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.session import write_once

# Bins of a feature (one or two more if the sample is larger than expected), and rows that the cuts between
# them are chosen from: as in Spark ML's trees.
BINS = 32
SAMPLE_ROWS = 10_000
# Rows added up at once: their bin numbers and residuals stay in a core's cache.
CHUNK = 32_768
# Bytes of rows that a worker gets at once, and bytes that are read at once from the written rows.
BATCH_BYTES = 4 << 20
GROUP_BYTES = 8 << 20


@dataclass
class Tree:
    """A regression tree, level by level: per node the feature (-1: no split) and the last bin that
    goes left. Rows of a node without a split go left; ``values`` are those of the last level's children."""
    features: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray | None = None

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row is in after the levels so far; ``x``: a line of bin numbers per feature."""
        at = np.zeros(x.shape[1], np.min_scalar_type(2 ** len(self.features) - 1))
        for feats, last in zip(self.features, self.bins):
            right = np.zeros(x.shape[1], bool)
            for node, (f, b) in enumerate(zip(feats, last)):
                if f >= 0:
                    right |= (at == node) & (x[f] > b)
            at <<= 1
            at |= right
        return at


def weights(trees: int, step: float) -> list[float]:
    return [1.0 if i == 0 else step for i in range(trees)]


def residuals(x: np.ndarray, y: np.ndarray, trees: list[Tree], step: float) -> np.ndarray:
    """What the next tree is fitted on: the label as -1 or 1, then minus the gradient of the log loss."""
    sign = 2.0 * y - 1.0
    if not trees:
        return sign
    margin = np.zeros(len(y))
    for tree, w in zip(trees, weights(len(trees), step)):
        margin += (tree.values * w)[tree.nodes(x)]
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


class Sums:
    """Rows and residuals per node, and per node, feature and bin. Two features are counted at
    once, by both their bins; ``flat`` adds up over the other feature's bins."""

    def __init__(self, nodes: int, features: int, bins: int):
        self.nodes, self.features, self.bins = nodes, features, bins
        self.pairs = [[np.zeros(nodes * bins * bins), np.zeros(nodes * bins * bins)] for _ in range(0, features, 2)]
        self.whole = [np.zeros(nodes), np.zeros(nodes)]

    def add(self, x: np.ndarray, node: np.ndarray, r: np.ndarray) -> None:
        node = node.astype(np.intp)
        self.whole[0] += np.bincount(node, minlength=self.nodes)
        self.whole[1] += np.bincount(node, r, self.nodes)
        base = node * (self.bins * self.bins)
        for i, (count, total) in enumerate(self.pairs):
            both = x[2 * i].astype(np.uint16) * self.bins
            if 2 * i + 1 < self.features:
                both += x[2 * i + 1]
            key = base + both
            count += np.bincount(key, minlength=len(count))
            total += np.bincount(key, r, len(total))

    def flat(self) -> np.ndarray:
        out = np.zeros((2, self.nodes, self.features, self.bins))
        for i, pair in enumerate(self.pairs):
            for k, sums in enumerate(pair):
                both = sums.reshape(self.nodes, self.bins, self.bins)
                out[k, :, 2 * i] = both.sum(axis=2)
                if 2 * i + 1 < self.features:
                    out[k, :, 2 * i + 1] = both.sum(axis=1)
        return np.concatenate([out.ravel(), *self.whole])


def _level_sums(rows: DataFrame, parts: int, cuts: list[np.ndarray], trees: list[Tree], tree: Tree, step: float, fan_in: int = 64):
    """Rows and residuals per node, feature and bin of the tree's next level; then per node. ``parts``: the partitions of ``rows``."""
    nodes, features, bins = 2 ** len(tree.features), len(cuts), max(map(len, cuts), default=0) + 1

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, n = Sums(nodes, features, bins), [], 0

        def take() -> None:
            whole = np.concatenate(held, axis=1)
            for at in range(0, whole.shape[1], CHUNK):
                x, y = whole[:-1, at:at + CHUNK], whole[-1, at:at + CHUNK]
                sums.add(x, tree.nodes(x), residuals(x, y, trees, step))

        for batch in batches:
            for block in batch.column(0):
                held.append(np.frombuffer(block.as_buffer(), np.uint8).reshape(features + 1, -1))
                n += held[-1].shape[1]
                if n >= CHUNK:
                    take()
                    held, n = [], 0
        if held:
            take()
        yield pa.RecordBatch.from_arrays([pa.array([sums.flat().tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column(0):
                s = np.frombuffer(s.as_buffer())
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.mapInArrow(of_partition, "sums binary")
    while parts > fan_in:      # add up in a tree, so that the driver gets few sums
        parts = -(-parts // fan_in)
        sums = sums.repartition(parts).mapInArrow(added, "sums binary")
    flat = np.sum([np.frombuffer(r.sums) for r in sums.collect()], axis=0)
    whole, each = flat[-2 * nodes:].reshape(2, nodes), flat[:-2 * nodes].reshape(2, nodes, features, bins)
    return each[0], each[1], whole[0], whole[1]


def best_split(count: np.ndarray, total: np.ndarray, cuts: list[np.ndarray]):
    """The split of a node with the greatest fall of the variance, the first of equal ones: (feature, bin, left's rows
    and sum, right's rows and sum); None if nothing falls. ``count`` and ``total``: a line of bins per feature."""
    best, gain = None, 0.0
    for f, c in enumerate(cuts):
        n, s = np.cumsum(count[f]), np.cumsum(total[f])
        nl, sl, nr, sr = n[:len(c)], s[:len(c)], n[-1] - n[:len(c)], s[-1] - s[:len(c)]
        with np.errstate(invalid="ignore", divide="ignore"):
            g = np.where((nl >= 1) & (nr >= 1), sl * sl / nl + sr * sr / nr - s[-1] * s[-1] / n[-1], -1.0)
        b = int(np.argmax(g))
        if g[b] > gain:
            best, gain = (f, b, nl[b], sl[b], nr[b], sr[b]), g[b]
    return best


def fit_tree(rows: DataFrame, parts: int, cuts: list[np.ndarray], trees: list[Tree], max_depth: int, step: float) -> Tree:
    tree, values = Tree(), {}
    alive = {0}
    while alive:
        level = len(tree.features)
        count, total, n, s = _level_sums(rows, parts, cuts, trees, tree, step)
        feats, last, following = np.full(2 ** level, -1), np.zeros(2 ** level, int), set()
        for node in alive:
            values[level, node] = s[node] / n[node]
            if level < max_depth and (found := best_split(count[node], total[node], cuts)):
                feats[node], last[node], nl, sl, nr, sr = found
                values[level + 1, 2 * node], values[level + 1, 2 * node + 1] = sl / nl, sr / nr
                following |= {2 * node, 2 * node + 1}
        if following:
            tree.features.append(feats)
            tree.bins.append(last)
        alive = following if level + 1 < max_depth else set()
    depth = len(tree.features)
    tree.values = np.zeros(2 ** depth)
    for (level, node), v in sorted(values.items()):     # a node without children: its rows went left from there
        tree.values[node << (depth - level)] = v
    return tree


def find_cuts(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Spark ML's cuts of one feature: halves between the sample's values if few, else between those nearest to equal
    shares. Spark counts the zeros as what lacks to the ``expected`` size of the sample."""
    kept = values[values != 0.0]
    found, counts = np.unique(kept, return_counts=True)
    counts = counts.astype(float)
    if not len(kept):
        return np.empty(0)
    if expected - len(kept) > np.finfo(float).eps * len(kept) * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, expected - len(kept))
    halves = (found[:-1] + found[1:]) / 2.0
    if len(halves) <= most:
        return halves
    share = expected / (most + 1)
    cuts, before, target = [], counts[0], share
    for half, c in zip(halves, counts[1:]):
        if abs(before - target) < abs(before + c - target):
            cuts.append(half)
            target += share
        before += c
    return np.array(cuts)


def sampled(df: DataFrame, rows: int, seed: int) -> np.ndarray:
    """The sample that Spark ML's trees take of ``df``'s ``rows`` rows, a line per row."""
    spark = df.sparkSession
    if rows > SAMPLE_ROWS:
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        some = df._jdf.rdd().sample(False, SAMPLE_ROWS / rows, seed)
        df = DataFrame(spark._jsparkSession.createDataFrame(some, df._jdf.schema()), spark)
    return np.array([list(r) for r in df.collect()], float)


def _blocks(df: DataFrame, cuts: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Blocks of rows: per feature a line of bin numbers (how many cuts lie below the scaled value) and, from ``df``'s
    last column, one of labels."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *values, y = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                lines = [np.searchsorted(c, (v - m) * s) for v, c, m, s in zip(values, cuts, mean, scale)]
                yield pa.RecordBatch.from_arrays([pa.array([np.array([*lines, y], np.uint8).tobytes()], pa.binary())], names=["block"])

    return df.mapInArrow(of_batches, "block binary")


@dataclass
class BoostedTrees:
    """Fitted trees; ``used``: the places of the features with cuts among all features."""
    trees: list[Tree]
    cuts: list[np.ndarray]
    used: list[int]
    mean: np.ndarray
    scale: np.ndarray
    step: float

    def _value(self, z: list[Column], tree: Tree, weight: float, level: int = 0, node: int = 0) -> Column:
        if level == len(tree.features):
            return F.lit(float(tree.values[node] * weight))
        f = int(tree.features[level][node])
        left = self._value(z, tree, weight, level + 1, 2 * node)
        if f < 0:
            return left
        right = self._value(z, tree, weight, level + 1, 2 * node + 1)
        return F.when(z[f] <= F.lit(float(self.cuts[f][tree.bins[level][node]])), left).otherwise(right)

    def predict(self, df: DataFrame, values: list[Column], out: str) -> DataFrame:
        """``df`` with 1.0 where the trees' weighted sum is positive, else 0.0."""
        z = {f"_z{i}": (values[i] - F.lit(float(self.mean[i]))) * F.lit(float(self.scale[i])) for i in self.used}
        each = [self._value([F.col(c) for c in z], t, w) for t, w in zip(self.trees, weights(len(self.trees), self.step))]
        return df.withColumns(z).withColumn(out, F.when(sum(each[1:], each[0]) > 0, 1.0).otherwise(0.0)).drop(*z)


def fit_boosted(df: DataFrame, values: list[Column], y: str, mean: np.ndarray, std: np.ndarray, max_iter: int,
                max_depth: int, step: float = 0.1, seed: int = 7) -> BoostedTrees:
    """Boosted trees on ``(values - mean) / std`` for the labels 0.0 and 1.0 in column ``y``."""
    if not (np.isfinite(mean).all() and np.isfinite(std).all()):
        raise ValueError("trees need features without nulls and without non-finite values")
    scale = np.array([1.0 / s if s else 0.0 for s in std])
    x = df.select(*[v.alias(f"f{i}") for i, v in enumerate(values)], F.col(y).alias("y"))
    n = df.count()
    if not n:
        raise ValueError("trees need rows")
    found = {}
    if varied := np.flatnonzero(scale).tolist():
        z = (sampled(x.select(*[f"f{i}" for i in varied]), n, seed) - mean[varied]) * scale[varied]
        expected = SAMPLE_ROWS / n * n if n > SAMPLE_ROWS else float(n)
        found = {i: find_cuts(z[:, k], expected, min(BINS, n) - 1) for k, i in enumerate(varied)}
    used = [i for i, c in found.items() if len(c)]
    cuts = [found[i] for i in used]
    rows = write_once(_blocks(x.select(*[f"f{i}" for i in used], "y"), cuts, mean[used], scale[used]), "tree-rows",
                      **{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 8})
    parts = rows.rdd.getNumPartitions()
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    trees: list[Tree] = []
    try:
        conf.set(key, str(BATCH_BYTES))
        for _ in range(max_iter):
            trees.append(fit_tree(rows, parts, cuts, trees, max_depth, step))
    finally:
        conf.set(key, before)
    return BoostedTrees(trees, cuts, used, mean, scale, step)
