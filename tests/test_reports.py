"""Reports: blocked moving mean, timeline spine, breakdown, retention."""

import datetime as dt
import random

import pytest

from packetlens.operators import reports as R


def test_blocked_moving_mean_hot_key(spark):
    rnd = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 10 else 2, base + dt.timedelta(seconds=rnd.randrange(0, 20000)), rnd.random())
            for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")
    a = R.moving_mean(df, "v", ["ts", "id"], by=["k"], n=50).toPandas().set_index("id").sort_index()
    b = R.moving_mean(df, "v", ["ts", "id"], by=["k"], n=50, strategy="blocked", ts="ts",
                      bucket_seconds=600).toPandas().set_index("id").sort_index()
    assert b["moving_mean"].to_numpy() == pytest.approx(a["moving_mean"].to_numpy(), rel=1e-12)


def test_timeline_zero_filled_last_40(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), "ATTACK" if m % 2 else "NORMAL") for m in (0, 1, 50, 55, 100)]
    df = spark.createDataFrame(rows, "ts timestamp, label string")
    out = R.timeline(df, "ts", "label", bucket_seconds=60, last_n=40).orderBy("bucket_start").collect()
    assert len(out) == 40
    assert sum(r["attacks"] + r["normal"] for r in out) == 1   # only minute 100 is in the last 40
    assert out[-1]["normal"] == 1


def test_breakdown_all_types(spark):
    df = spark.createDataFrame([("DDoS", "ATTACK"), ("DDoS", "ATTACK"), ("Other", "NORMAL")],
                               "attack_type string, label string")
    out = {r["attack_type"]: (r["n"], r["pct"]) for r in R.attack_breakdown(df).collect()}
    assert out["DDoS"] == (2, 100.0) and out["Other"] == (0, 0.0) and len(out) == 5


def test_keep_last_per_key(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(300)], "k int, i int")
    out = R.keep_last(df, ["i"], by=["k"], n=200)
    assert out.count() == 400 and out.agg({"i": "min"}).first()[0] == 100


def test_moving_mean_auto_split(spark):
    rnd = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 4 else rnd.randrange(2, 6), base + dt.timedelta(seconds=rnd.randrange(0, 9000)), rnd.random())
            for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")
    a = R.moving_mean(df, "v", ["ts", "id"], by=["k"], n=50, strategy="window").toPandas().set_index("id").sort_index()
    b = R.moving_mean(df, "v", ["ts", "id"], by=["k"], n=50, strategy="auto", hot_rows=100, ts="ts",
                      bucket_seconds=300).toPandas().set_index("id").sort_index()
    assert b["moving_mean"].to_numpy() == pytest.approx(a["moving_mean"].to_numpy(), rel=1e-12)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "ts timestamp, label string, attack_type string")
    assert R.timeline(empty, "ts", "label").count() == 0
    out = R.attack_breakdown(empty).collect()
    assert len(out) == 5 and all(r["n"] == 0 and r["pct"] == 0.0 for r in out)
    assert R.session_counters(empty).first()["attack_rate"] == 0.0
