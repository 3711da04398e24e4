"""Golden boundary rows of the rules, ensembles, gate and bands."""

import math

from pyspark.sql import functions as F

from packetlens.functions.columns import attack_type, clip01, rule_flags
from packetlens.operators.reports import score_bands
from packetlens.operators.scoring import ensemble_batch, ensemble_live, live_gate


def test_attack_type_edges(spark):
    rows = [(r, p) for r in (4000.0, 4000.01, 40000.0, 40000.01) for p in (22, 3306, 80, None)]
    df = spark.createDataFrame(rows, "rate double, port int")
    got = {(r["rate"], r["port"]): r["t"] for r in df.select("rate", "port", attack_type("port", "rate").alias("t")).collect()}
    for (r, p), t in got.items():
        if r > 40000:
            assert t == "DDoS"
        elif p == 22:
            assert t == "BruteForce"
        elif p == 3306:
            assert t == "SQLInject"
        elif r > 4000:
            assert t == "PortScan"
        else:
            assert t == "Other"
    assert got[(40000.0, 80)] == "PortScan" and got[(4000.0, None)] == "Other"


def test_attack_type_truncates_port_and_defaults(spark):
    df = spark.createDataFrame([(22.9, None), (None, 5.0)], "port double, rate double")
    out = [r[0] for r in df.select(attack_type("port", "rate")).collect()]
    assert out == ["BruteForce", "Other"]


def test_rule_label_guide(spark):
    rows = [(float(r), p) for r in (100, 101, 200, 201, 1000, 1001) for p in (22, 3306, 80)]
    df = spark.createDataFrame(rows, "rate double, port int")
    flags = rule_flags("rate", "port")
    got = {(r["rate"], r["port"]): r["rule"] for r in df.select("rate", "port", flags["rule"].alias("rule")).collect()}
    assert got[(1001.0, 22)] == "DDoS"
    assert got[(1000.0, 22)] == "BruteForce" and got[(201.0, 3306)] == "SQLInject"
    assert got[(200.0, 22)] == "PortScan" and got[(101.0, 80)] == "PortScan"
    assert got[(100.0, 80)] == "Normal" and got[(1000.0, 80)] == "PortScan"


def test_ensemble_worked_cases(spark):
    # dl_error = 0.5 * dl because the dl score is err / 0.5
    rows = [(0.275, 0.0), (0.275, 0.8), (0.05, 0.0), (0.05, 0.9)]
    df = spark.createDataFrame(rows, "dl_error double, ml_prob double")
    out = ensemble_live(df).orderBy("dl_error", "ml_prob").collect()
    got = [(r["final_score"], r["label"]) for r in out]
    assert got == [(0.1, "NORMAL"), (0.37, "NORMAL"), (0.55, "ATTACK"), (0.79, "ATTACK")]
    assert [r["confidence"] for r in out] == [90.0, 63.0, 55.0, 79.0]


def test_gate_edges_keep_confidence(spark):
    rows = [(0.5, 0.2999), (0.5, 0.30), (0.4499 / 2 + 0.3, 0.30)]
    df = spark.createDataFrame([(1.0, 0.2999), (1.0, 0.30), (0.3749, 0.30), (0.375, 0.30)],
                               "dl_error double, ml_prob double")
    live = ensemble_live(df)
    gated = live_gate(live).orderBy("dl_error", "ml_prob").collect()
    base = live.orderBy("dl_error", "ml_prob").collect()
    labels = [(r["dl_error"], r["ml_prob"], r["final_score"], r["label"]) for r in gated]
    # final = min(dl + 0.09, 1): 0.7498+0.09 -> 0.8398 ATTACK; ml 0.2999 blocks the gate
    assert labels[-2][3] == "NORMAL" and labels[-1][3] == "ATTACK"
    assert [r["confidence"] for r in gated] == [r["confidence"] for r in base]
    assert rows  # documented inputs


def test_gate_score_edge(spark):
    df = spark.createDataFrame([("ATTACK", 0.5, 0.7499, 75.0), ("ATTACK", 0.5, 0.75, 75.0)],
                               "label string, ml_prob double, final_score double, confidence double")
    out = [r["label"] for r in live_gate(df).orderBy("final_score").collect()]
    assert out == ["NORMAL", "ATTACK"]


def test_score_bands_edges(spark):
    df = spark.createDataFrame([("NORMAL", s) for s in (0.15, 0.1501, 0.35, 0.3501)] + [("ATTACK", 0.9)],
                               "label string, final_score double")
    r = score_bands(df).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 2, 1)


def test_minmax_all_equal_is_normal(spark):
    df = spark.createDataFrame([(0.2, 0.9), (0.2, 0.1)], "dl_error double, ml_prob double")
    out = ensemble_batch(df).collect()
    assert all(r["label"] == "NORMAL" and r["dl_score"] is None for r in out)


def test_clip_negative_zero_and_nan(spark):
    df = spark.createDataFrame([(-0.0,), (float("nan"),), (2.0,), (-3.0,)], "x double")
    out = [r[0] for r in df.select(clip01("x")).collect()]
    assert out[0] == 0.0 and math.copysign(1, out[0]) == 1.0
    assert out[1] is None and out[2] == 1.0 and out[3] == 0.0
    assert F is not None
