"""Boosted trees on bin numbers against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.sql import functions as F

from packetlens.operators import boost
from packetlens.operators import models as M

NAMES = ["a", "b", "c", "d"]


def flows(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)) * [1, 10, 3, 0], 1)
    x[:, 2] = np.where(rng.random(n) < 0.6, 0.0, x[:, 2])
    attack = (x[:, 0] * x[:, 1] + rng.normal(size=n) > 0) | (x[:, 2] > 4)
    rows = [(i, *map(float, r), "DDoS" if t else "BENIGN") for i, (r, t) in enumerate(zip(x, attack))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind string")


def by_spark_ml(df, max_iter, max_depth):
    index = StringIndexer(inputCol="kind", outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    model = Pipeline(stages=[index, StandardScaler(inputCol=M.VEC, outputCol="_z", withMean=True, withStd=True), GBTClassifier(
        featuresCol="_z", labelCol="_y", maxIter=max_iter, maxDepth=max_depth, predictionCol="_pred", seed=7)]).fit(M.with_vector(df, NAMES))
    out = IndexToString(inputCol="_pred", outputCol="predicted_label", labels=index.labels).transform(model.transform(M.with_vector(df, NAMES)))
    return sorted(map(tuple, out.select("id", "predicted_label").collect()))


@pytest.mark.parametrize("n, parts, max_iter, max_depth", [(11_000, 3, 4, 3), (400, 1, 3, 4)])
def test_labels_are_those_of_spark_ml(spark, n, parts, max_iter, max_depth):
    """Also where the cuts come from a sample (above 10,000 rows)."""
    df = flows(spark, n).repartition(parts, "id").localCheckpoint()
    got = sorted(map(tuple, M.tree_only_labels(df, NAMES, "kind", max_iter=max_iter, max_depth=max_depth).select("id", "predicted_label").collect()))
    assert got == by_spark_ml(df, max_iter, max_depth) and len({label for _, label in got}) == 2


def test_rows_are_kept_as_a_byte_a_feature(spark, monkeypatch):
    """Every row is kept, once, with a byte for each feature that varies and one for the label."""
    kept, write = [], boost.write_once
    monkeypatch.setattr(boost, "write_once", lambda *a, **options: kept.append(write(*a, **options)) or kept[-1])
    M.tree_only_labels(flows(spark, 3000), NAMES, "kind", max_iter=2, max_depth=2)
    assert [df.agg(F.sum(F.length("block"))).first()[0] for df in kept] == [3000 * 4]


def test_tables_without_a_split(spark):
    same = flows(spark, 50).withColumns({c: F.lit(2.5) for c in NAMES})
    for df in (same, same.limit(1), flows(spark, 50).where("kind = 'BENIGN'")):
        most = df.groupBy("kind").count().orderBy(F.desc("count")).first()["kind"]
        assert [r[0] for r in M.tree_only_labels(df, NAMES, "kind", max_iter=2, max_depth=2).select("predicted_label").distinct().collect()] == [most]


def test_tables_that_cannot_be_fitted(spark):
    df = flows(spark, 30)
    for wrong in (df.withColumn("a", F.expr("if(id = 3, null, a)")), df.withColumn("kind", F.expr("if(id % 7 = 0, 'x', kind)"))):
        with pytest.raises(ValueError):
            M.tree_only_labels(wrong, NAMES, "kind", max_iter=1, max_depth=1)


def test_a_sample_above_its_expected_size_gives_more_cuts():
    """A cut more than Spark's 31; sums then have as many bins."""
    cuts = boost.find_cuts(np.arange(1.0, 10_601.0), 10_000.0, 31)
    assert len(cuts) > 31
    rng = np.random.default_rng(3)
    x, node, r = rng.integers(0, len(cuts) + 1, (3, 500)).astype(np.uint8), rng.integers(0, 2, 500), rng.normal(size=500)
    x[:, 0] = len(cuts)
    sums = boost.Sums(2, 3, len(cuts) + 1)
    sums.add(x, node, r)
    flat = sums.flat()
    count, total = flat[:-4].reshape(2, 2, 3, len(cuts) + 1)
    for k in range(2):
        for f in range(3):
            at = x[f][node == k]
            assert np.array_equal(count[k, f], np.bincount(at, minlength=len(cuts) + 1))
            assert np.allclose(total[k, f], np.bincount(at, r[node == k], len(cuts) + 1))
    assert flat[-4:-2].sum() == 500 and flat[-2:].sum() == pytest.approx(r.sum())


def test_zeros_are_what_lacks_to_the_expected_sample():
    assert boost.find_cuts(np.array([0.0, 0.0, -2.0, 4.0]), 4.0, 31).tolist() == [-1.0, 2.0]
    assert boost.find_cuts(np.array([-2.0, 4.0]), 2.0, 31).tolist() == [1.0]
    assert boost.find_cuts(np.zeros(5), 5.0, 31).tolist() == []
