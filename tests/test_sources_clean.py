"""Flow CSV (hand-written, FX5 shape), projection, cleaning and log formatting."""

import math

from pyspark.sql import functions as F

from packetlens.functions.columns import clock_text, pct_text, score_text, verdict_display
from packetlens.operators.clean import drop_label, drop_nonfinite, feature_projection, impute_nonfinite
from packetlens.schemas import FEATURES
from packetlens.sources.files import dedupe_names, read_flow_csv

CSV = """ Destination Port, Flow Duration, Fwd Header Length, Fwd Packets/s, Fwd Header Length, Label
80,100,20,1.5,20,BENIGN
443,200,32,Infinity,32,DDoS
22,300,40,-Infinity,40,DDoS
53,400,20,NaN,20,BENIGN
8080,500,20,abc,20,BENIGN
3306,600,24,2.5,24,DDoS
5432,700,24,3.0,24,DDoS
21,800,20,4.0,20,BENIGN
23,900,20,5.5,20,BENIGN
3389,1000,20,6.5,20,DDoS
5900,1100,20,7.5,20,DDoS
1433,1200,20,8.5,20,BENIGN
"""


def test_dedupe_names():
    assert dedupe_names([" a", "b ", " a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_flow_csv_end_to_end(spark, tmp_path):
    p = tmp_path / "flows.csv"
    p.write_text(CSV)
    df = read_flow_csv(spark, str(p))
    assert df.columns[:6] == ["Destination Port", "Flow Duration", "Fwd Header Length", "Fwd Packets/s",
                              "Fwd Header Length.1", "Label"]
    rows = df.orderBy("Flow Duration").collect()
    assert math.isinf(rows[1]["Fwd Packets/s"]) and rows[2]["Fwd Packets/s"] < 0
    assert math.isnan(rows[3]["Fwd Packets/s"])
    assert rows[4]["Fwd Packets/s"] is None and rows[4]["_corrupt_record"] is not None
    proj = feature_projection(drop_label(df), keep=["Flow Duration"])
    assert proj.columns == ["Flow Duration"] + FEATURES
    pr = {r["Flow Duration"]: r for r in proj.collect()}
    assert pr[500.0]["Fwd Packets/s"] == 0.0          # malformed -> 0
    assert pr[100.0]["Fwd Header Length.1"] == 20.0
    assert pr[100.0]["Bwd IAT Mean"] == 0.0           # missing column -> 0
    imp = {r["Flow Duration"]: r["Fwd Packets/s"] for r in impute_nonfinite(proj).collect()}
    assert imp[200.0] == 0.0 and imp[300.0] == 0.0 and imp[400.0] == 0.0 and imp[1200.0] == 8.5
    kept = [r["Flow Duration"] for r in drop_nonfinite(proj).collect()]
    assert sorted(kept) == [100.0, 500.0, 600.0, 700.0, 800.0, 900.0, 1000.0, 1100.0, 1200.0]


def test_log_formatting(spark):
    df = spark.createDataFrame([(0.25, 0.123456, "ATTACK")], "p double, s double, label string")
    r = df.select(pct_text("p").alias("a"), score_text("s").alias("b"), verdict_display("label").alias("c"),
                  clock_text(F.to_timestamp(F.lit("2024-01-01 13:05:09"))).alias("d")).first()
    assert r["a"] in ("25.0%",) and r["b"] == "0.123" and r["c"] == "⚠ ATTACK" and r["d"] == "13:05:09"


def test_display_functions(spark):
    from packetlens.functions.columns import day_text, is_tcp_text, merge_counts, short_name, thousands
    df = spark.createDataFrame([(1234567, "Fwd Packet Length Mean", "TCP/6")], "n long, name string, p string")
    r = df.select(thousands("n").alias("a"), short_name("name").alias("b"), is_tcp_text("p").alias("c"),
                  day_text(F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("d"),
                  merge_counts(F.create_map(F.lit("DDoS"), F.lit(1)), F.lit("DDoS"), F.lit(2)).alias("m")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("1,234,567", "Fwd Packet Length ", True, "Monday 01 Jan 2024")
    assert r["m"]["DDoS"] == 2


def test_cluster_settings():
    from packetlens.session import cluster_settings
    s = cluster_settings(100 << 40)
    assert int(s["spark.sql.shuffle.partitions"]) >= 400_000
