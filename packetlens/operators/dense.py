"""M2 as a dense network: an autoencoder's reconstruction error, and its training.

The network has the documented layers (30-128-64-32-8-32-64-128-30, ReLU between
them); the input is standardised by the benign rows' mean and deviation. Scoring is
one map over Arrow batches: a batch becomes a matrix, each layer one matrix product.
The weights (some 30,000 numbers, whatever the data) go to every task.

Training is data-parallel: each step maps over the written training rows, adds up the
gradient of the mean squared error per partition, adds partitions up in a tree, and moves the
weights on the driver (Adam). A step gathers one gradient a branch, never rows, and a
step's result depends on how rows are dealt to partitions only in the last digits.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators.models import fit_standardiser
from packetlens.schemas import fcol
from packetlens.session import write_once

HIDDEN = (128, 64, 32, 8, 32, 64, 128)
# Rows multiplied at once: a layer's outputs (half a megabyte) stay in a core's cache.
BLOCK = 512
Layers = list[tuple[np.ndarray, np.ndarray]]


def forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """The input and every layer's output."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w
        z += b
        out.append(np.maximum(z, 0.0, out=z) if i + 1 < len(layers) else z)
    return out


def blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[at:at + BLOCK] for at in range(0, len(x), BLOCK))


def gradient(x: np.ndarray, layers: Layers) -> tuple[float, Layers]:
    """Summed squared error over the rows, and its gradient."""
    outs = forward(x, layers)
    back = 2.0 * (outs[-1] - x)
    grads: Layers = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((outs[i].T @ back, back.sum(axis=0)))
        if i:
            back = back @ layers[i][0].T
            back *= outs[i] > 0
    return float(((outs[-1] - x) ** 2).sum()), grads[::-1]


def initial_layers(n: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 7) -> Layers:
    rng = np.random.default_rng(seed)
    sizes = [n, *hidden, n]
    return [(rng.normal(0.0, math.sqrt(2.0 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at:at + w.size].reshape(w.shape), flat[at + w.size:at + w.size + b.size]))
        at += w.size + b.size
    return out


@dataclass
class DenseAutoencoder:
    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    layers: Layers

    def inputs(self, df: DataFrame):
        """The standardised features as one array column; a constant feature is 0."""
        cols = [(F.col(fcol(c)).cast("double") - F.lit(float(m))) / F.lit(float(s)) if s > 0 else F.lit(0.0)
                for c, m, s in zip(self.features, self.mean, self.std)]
        return F.array(*cols)

    def errors(self, df: DataFrame, out: str = "dl_error") -> DataFrame:
        """M2: mean squared reconstruction error of each row (also on streams); null
        where a feature is null or not finite."""
        layers = self.layers

        @F.pandas_udf("double")
        def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                x = np.array([np.asarray(v, np.float64) for v in s]).reshape(len(s), -1) if len(s) else np.empty((0, 1))
                with np.errstate(invalid="ignore", over="ignore"):
                    e = np.concatenate([((forward(part, layers)[-1] - part) ** 2).mean(axis=1) for part in blocks(x)] or [np.empty(0)])
                yield pd.Series(np.where(np.isfinite(e), e, np.nan)).astype("float64")

        e = error(self.inputs(df))
        return df.withColumn(out, F.when(F.isnan(e), F.lit(None).cast("double")).otherwise(e))

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"features": self.features, "mean": self.mean.tolist(), "std": self.std.tolist(),
                "layers": [[w.tolist(), b.tolist()] for w, b in self.layers]}
        spark.createDataFrame([(json.dumps(meta),)], "model string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "dense"))


def load_dense(spark: SparkSession, path: str) -> DenseAutoencoder:
    m = json.loads(spark.read.parquet(os.path.join(path, "dense")).first()[0])
    return DenseAutoencoder(m["features"], np.array(m["mean"]), np.array(m["std"]), [(np.array(w), np.array(b)) for w, b in m["layers"]])


def _gradients(rows: DataFrame, layers: Layers, fan_in: int = 32) -> tuple[float, Layers, int]:
    """Loss, gradient and rows over a frame of one array column ``x``."""
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, np.zeros(sum(w.size + b.size for w, b in layers))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n += batch.num_rows
                for some in blocks(x):
                    part, g = gradient(some, layers)
                    loss += part
                    total += _flat(g)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["loss", "n", "g"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, None
        for batch in batches:
            for a, b, g in zip(*(c.to_pylist() for c in batch.columns)):
                g = np.frombuffer(g)
                loss, n, total = loss + a, n + b, g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["loss", "n", "g"])

    schema = "loss double, n long, g binary"
    parts, left = rows.mapInArrow(of_partition, schema), rows.rdd.getNumPartitions()
    while left > fan_in:      # add up in a tree, so that the driver gets few gradients
        left = -(-left // fan_in)
        parts = parts.repartition(left).mapInArrow(added, schema)
    got = parts.collect()
    total = np.sum([np.frombuffer(r.g) for r in got], axis=0)
    return sum(r.loss for r in got), _shaped(total, layers), sum(r.n for r in got)


def fit_dense(df: DataFrame, features: list[str], benign: str | None = None, hidden: tuple[int, ...] = HIDDEN,
              steps: int = 60, rate: float = 0.003, seed: int = 7) -> DenseAutoencoder:
    """M2 + M11: the autoencoder fitted on the benign rows with finite features."""
    from packetlens.operators.models import finite_only
    train = finite_only(df.where(F.col(benign)) if benign else df, features)
    stats = fit_standardiser(train, features)
    mean = np.array([stats[c][0] or 0.0 for c in features])
    std = np.array([stats[c][1] or 0.0 for c in features])
    model = DenseAutoencoder(list(features), mean, std, initial_layers(len(features), hidden, seed))
    rows = write_once(train.select(model.inputs(train).alias("x")), "dense-train")
    m = v = np.zeros(_flat(model.layers).size)
    for step in range(1, steps + 1):
        _, g, n = _gradients(rows, model.layers)
        if n == 0:
            raise ValueError("the anomaly model needs benign rows with finite features")
        g = _flat(g) / (n * len(features))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        model.layers = _shaped(_flat(model.layers) - rate * move, model.layers)
    return model
