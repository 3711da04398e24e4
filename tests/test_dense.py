"""The dense autoencoder against a numpy twin, and its training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators.dense import DenseAutoencoder, _gradients, fit_dense, forward, gradient, initial_layers, load_dense
from packetlens.operators.models import fit_anomaly
from packetlens.session import scratch_path


@pytest.fixture(scope="module")
def curved(spark):
    """Six columns on a curved sheet of two dimensions; attacks lie off it."""
    rng = np.random.default_rng(2)
    u, v = rng.uniform(-2, 2, (2, 1500))
    x = np.column_stack([u, v, u * v, np.abs(u), np.maximum(v, 0) * 2, u - v])
    x[1200:] += rng.normal(0, 1.5, (300, 6))
    rows = [(i, *map(float, r), i < 1200) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, c double, d double, e double, f double, benign boolean").repartition(7)


NAMES = ["a", "b.c", "c", "d", "e", "f"]


def test_errors_equal_numpy(spark, curved):
    layers = initial_layers(6, (16, 3, 16))
    model = DenseAutoencoder(NAMES, np.arange(6) * 0.1, np.array([1, 2, 0.5, 1, 0, 3.0]), layers)
    got = {r.id: r.dl_error for r in model.errors(curved).collect()}
    for r in curved.collect():
        x = np.array([0.0 if s == 0 else (r[n] - m) / s for n, m, s in zip(NAMES, model.mean, model.std)])
        assert got[r.id] == pytest.approx(((forward(x, layers)[-1] - x) ** 2).mean(), rel=1e-9)
    model.save(spark, path := scratch_path(spark, "dense"))
    again = {r.id: r.dl_error for r in load_dense(spark, path).errors(curved).collect()}
    assert again == got
    odd = curved.limit(1).withColumn("a", F.lit(float("inf"))).unionByName(curved.limit(1).withColumn("a", F.lit(None).cast("double")))
    assert [r.dl_error for r in model.errors(odd).collect()] == [None, None]
    assert model.errors(curved.limit(0)).count() == 0


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    x, layers = rng.normal(size=(20, 4)), initial_layers(4, (8, 2, 8))
    loss, g = gradient(x, layers)
    for i, j in ((0, 3), (2, 1), (3, 5)):
        layers[i][0].flat[j] += 1e-6
        assert (gradient(x, layers)[0] - loss) / 1e-6 == pytest.approx(g[i][0].flat[j], rel=1e-3, abs=1e-4)
        layers[i][0].flat[j] -= 1e-6


def test_gradients_add_up_in_a_tree(spark):
    x = np.random.default_rng(1).normal(size=(500, 3))
    layers = initial_layers(3, (5, 2, 5))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(9)
    loss, g, n = _gradients(rows, layers, fan_in=2)
    want, wg = gradient(x, layers)
    assert n == 500 and loss == pytest.approx(want)
    assert all(np.allclose(a, b) for p, q in zip(g, wg) for a, b in zip(p, q))


def test_training_learns_the_curve(spark, curved):
    few, more = (fit_dense(curved, NAMES, "benign", (32, 2, 32), steps=k, rate=0.01) for k in (1, 80))
    def mean(model, benign):
        return model.errors(curved.where(F.col("benign") == benign)).agg(F.avg("dl_error")).first()[0]
    assert mean(more, True) < 0.5 * mean(few, True)
    linear = fit_anomaly(curved, NAMES, k=2, benign="benign")
    assert mean(more, False) / mean(more, True) > 0.8 * mean(linear, False) / mean(linear, True)
    with pytest.raises(ValueError):
        fit_dense(curved.limit(0), NAMES, "benign", steps=1)
