"""Model operators against numpy on a small fixture; persistence; log records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators import models as M
from packetlens.operators.reports import log_records
from packetlens.sources.fixtures import table, vectors_from_embeddings


@pytest.fixture(scope="module")
def vectors(spark):
    return vectors_from_embeddings(table(spark, "/root/testdata/sf0.001", "embeddings")).withColumn(
        "attack", (~F.col("benign")).cast("int"))


def test_pca_error_matches_numpy(spark, vectors):
    model = M.fit_anomaly(vectors, "x", k=8, benign="benign")
    got = model.errors(vectors).select("vec_id", "dl_error").toPandas().set_index("vec_id").sort_index()
    pdf = vectors.select("vec_id", "x", "benign").toPandas().set_index("vec_id").sort_index()
    X = np.vstack(pdf["x"].to_numpy())
    B = X[pdf["benign"].to_numpy()]
    mu, sd = B.mean(axis=0), B.std(axis=0, ddof=1)
    Z = (X - mu) / np.where(sd == 0, 1, sd)
    Zb = (B - mu) / np.where(sd == 0, 1, sd)
    w, v = np.linalg.eigh(np.cov(Zb, rowvar=False))
    P = v[:, np.argsort(w)[::-1][:8]]
    err = ((Z * Z).sum(axis=1) - ((Z @ P) ** 2).sum(axis=1)) / X.shape[1]
    assert got["dl_error"].to_numpy() == pytest.approx(np.maximum(err, 0), rel=1e-6, abs=1e-9)


def test_hybrid_roundtrip_and_quality(spark, vectors, tmp_path):
    h = M.fit_hybrid(vectors, "x", "attack", "benign", k=4, quantile=0.9, max_iter=5, max_depth=3)
    a = h.score_live(vectors).select("vec_id", "final_score").orderBy("vec_id").collect()
    M.save_hybrid(h, str(tmp_path / "m"))
    h2 = M.load_hybrid(spark, str(tmp_path / "m"))
    b = h2.score_live(vectors).select("vec_id", "final_score").orderBy("vec_id").collect()
    assert a == b and h2.threshold == h.threshold
    q = M.evaluate_models(vectors, "x", "attack", "benign", k=4, max_iter=5, max_depth=3).collect()
    assert sorted(r["model"] for r in q) == ["anomaly", "hybrid", "trees"]


def test_log_records(spark):
    df = spark.createDataFrame([("2024-01-01 10:11:12", "10.0.0.1", 443, 6, 60, 0.5, 0.25, 0.875, "ATTACK")],
                               "ts string, src_ip string, dst_port int, proto int, pkt_len int, "
                               "ml_prob double, dl_score double, final_score double, label string")
    r = log_records(df.withColumn("ts", F.to_timestamp("ts"))).first()
    assert (r["Time"], r["Proto"], r["ML Prob"], r["DL Score"], r["Score"], r["Display"]) == \
        ("10:11:12", "TCP", "50.0%", "25.0%", "0.875", "⚠ ATTACK")
