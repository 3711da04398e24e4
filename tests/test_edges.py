"""Decision edge, cleaning, quarantine, overflow and empty-input cases."""

import pytest
from pyspark.sql import functions as F

from packetlens.operators import models as M
from packetlens.operators.flows import flow_features, flow_features_bucketed, quarantined_packets, valid_packets
from packetlens.operators.reports import log_records, moving_mean, session_counters
from packetlens.operators.scoring import ensemble_batch, ensemble_live
from tests.test_flows import packet, to_df


def test_decision_edge_is_not_the_error_scale(spark):
    df = spark.createDataFrame([(0.5256, 0.0), (0.3504, 0.2)], "dl_error double, ml_prob double")
    live = ensemble_live(df, threshold=0.876).orderBy("final_score").collect()
    assert [(r.final_score, r.label) for r in live] == [(0.46, "NORMAL"), (0.6, "ATTACK")]
    batch = ensemble_batch(spark.createDataFrame([(0.0, 0.0), (1.0, 0.2)], "dl_error double, ml_prob double"))
    assert {r.label for r in batch.where("final_score > 0.5").collect()} == {"ATTACK"}


def _vectors(spark, extra=()):
    rows = [([float(i % 7), float(i % 5), float(i % 3)], i % 4 != 0, int(i % 4 == 0)) for i in range(60)]
    return spark.createDataFrame(rows + list(extra), "x array<double>, benign boolean, attack int")


def test_hybrid_cleans_its_input(spark):
    clean = _vectors(spark)
    h = M.fit_hybrid(clean, "x", "attack", "benign", k=2, max_iter=2, max_depth=2)
    bad = _vectors(spark, [([float("nan"), 1.0, 2.0], True, 0)])
    live = h.score_live(bad)
    assert live.count() == 61 and live.where("final_score is null or isnan(final_score)").count() == 0
    batch = h.score_batch(bad)
    assert batch.count() == 60
    assert batch.groupBy("label").count().collect() == h.score_batch(clean).groupBy("label").count().collect()


def test_fit_without_benign_rows(spark):
    none = _vectors(spark).withColumn("benign", F.lit(False))
    with pytest.raises(ValueError, match="benign"):
        M.fit_hybrid(none, "x", "attack", "benign", k=2, max_iter=1, max_depth=1)


@pytest.mark.parametrize("size", [46_340, 46_341, 65_535])
def test_long_packets(spark, size):
    rows = [packet(i, i, 0, 1) for i in range(6)]
    for r in rows:
        r["pkt_len"] = size
    df = to_df(spark, rows)
    assert flow_features_bucketed(df, bucket_seconds=2).count() == flow_features(df, strategy="window").count() > 0


def test_quarantine_is_the_complement(spark):
    rows = [packet(i, i, 0, 1) for i in range(4)]
    rows[1]["proto"], rows[2]["pkt_len"] = None, None
    df = to_df(spark, rows)
    good = {r.packet_id for r in valid_packets(df).collect()}
    bad = {r.packet_id for r in quarantined_packets(df).collect()}
    assert (good, bad) == ({0, 3}, {1, 2})


def test_counters_and_log_defaults(spark):
    empty = spark.createDataFrame([], "label string")
    assert session_counters(empty).first().asDict() == {"total_packets": 0, "total_attacks": 0, "total_normal": 0, "attack_rate": 0.0}
    df = spark.createDataFrame([(None, None)], "dst_port int, proto int").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    r = log_records(df).first()
    assert (r["Dst Port"], r["Proto"], r["Src IP"]) == ("?", "?", "?")


def test_global_moving_mean_in_buckets(spark):
    df = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 13).cast("double").alias("v"))
    got = {r.id: r.moving_mean for r in moving_mean(df, "v", ["ts", "id"], n=50, hot_rows=60).collect()}
    v = [i % 13 for i in range(500)]
    want = {i: sum(v[max(0, i - 49):i + 1]) / len(v[max(0, i - 49):i + 1]) for i in range(500)}
    assert got == pytest.approx(want)


def test_blocked_moving_mean_keeps_null_times(spark):
    when = F.when(F.col("id") % 6 != 0, F.timestamp_seconds(F.col("id") * 7))
    key = F.when(F.col("id") % 5 != 0, F.col("id") % 2)
    df = spark.range(500).select("id", when.alias("ts"), key.alias("k"), (F.col("id") % 13).cast("double").alias("v"))
    for by in (None, ["k"]):
        want = {r.id: r.moving_mean for r in moving_mean(df, "v", ["ts", "id"], by=by, n=50, strategy="window").collect()}
        strategy = "blocked" if by else "auto"
        got = {r.id: r.moving_mean for r in moving_mean(df, "v", ["ts", "id"], by=by, n=50, hot_rows=60, strategy=strategy).collect()}
        assert len(got) == 500 and got == pytest.approx(want)
