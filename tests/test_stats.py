"""Exact quantile, AUC and error attribution against brute force."""

import random

import numpy as np
import pytest

from packetlens.operators.stats import auc, error_share_topk, evaluate, exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rnd = random.Random(5)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [7.0] * 2000 + [rnd.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "e double")
    got = exact_quantile(df, "e", q, max_local=300, bins=16)
    assert got == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)


def test_auc_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(800)]
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "truth int, score double")
    assert auc(df, buckets=8) == pytest.approx(want, abs=1e-12)
    m = evaluate(df.withColumn("prediction", (df.score > 15).cast("int"))).first()
    assert m["n"] == 800 and m["auc"] == pytest.approx(want, abs=1e-12)


def test_error_share_topk(spark):
    df = spark.createDataFrame([(1, 3.0, -4.0, 0.0), (2, 0.0, 0.0, 0.0)], "id int, a double, b double, c double")
    out = error_share_topk(df, ["a", "b", "c"], k=2, keep=["id"]).orderBy("id", "rank").collect()
    assert [(r["id"], r["rank"], r["feature"]) for r in out] == [(1, 1, "b"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")]
    assert out[0]["share"] == pytest.approx(16 / 25)
