"""Streaming flow features over several micro-batches equal the batch operator."""

import os
import time

import pytest

from packetlens.operators.flows import flow_features
from packetlens.schemas import FEATURES, PACKET
from packetlens.sources.fixtures import packets_from_events, table
from packetlens.streaming.flows import stream_flow_features


def test_stream_equals_batch_across_batches(spark, tmp_path):
    p = packets_from_events(table(spark, "/root/testdata/sf0.001", "events")).cache()
    landing = str(tmp_path / "landing")
    os.makedirs(landing)
    # time-ordered files, written one by one so the stream reads them in order
    bounds = p.selectExpr("percentile_approx(ts_s, array(0.25, 0.5, 0.75))").first()[0]
    edges = [-1.0] + list(bounds) + [1e12]
    for i in range(4):
        part = p.where((p.ts_s > edges[i]) & (p.ts_s <= edges[i + 1]))
        part.coalesce(1).write.parquet(os.path.join(landing, f"part-{i}"))
        for f in os.listdir(os.path.join(landing, f"part-{i}")):
            if f.endswith(".parquet"):
                os.replace(os.path.join(landing, f"part-{i}", f), os.path.join(landing, f"{i:03d}.parquet"))
        time.sleep(1.1)
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(landing + "/*.parquet")
    out = str(tmp_path / "out")
    q = (stream_flow_features(stream).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    assert len([x for x in q.recentProgress if x["numInputRows"] > 0]) >= 2
    got = spark.read.parquet(out).toPandas().set_index("packet_id").sort_index()
    want = flow_features(p).toPandas().set_index("packet_id").sort_index()
    assert list(got.index) == list(want.index)
    for c in FEATURES:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-9), c


def test_stream_summary_emits_closed_conversations(spark, tmp_path):
    import datetime as dt
    from packetlens.operators.flows import flow_summary
    from packetlens.streaming.flows import stream_flow_summary
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def pk(i, sec, a, b, ln=60):
        hosts = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 22), ("10.0.0.4", 5000)]
        return (i, base + dt.timedelta(seconds=sec), float(sec), hosts[a][0], hosts[b][0], hosts[a][1],
                hosts[b][1], 6, ln, 5, 5, 100)
    early = [pk(1, 0, 0, 1), pk(2, 10, 0, 1, 90), pk(3, 20, 1, 0, 400), pk(4, 30, 0, 1, 70)]
    late = [pk(10, 5000, 2, 3), pk(11, 5010, 2, 3), pk(12, 5020, 2, 3)]
    rows = early + late
    df = spark.createDataFrame(rows, PACKET)
    landing = str(tmp_path / "landing")
    df.write.parquet(landing)
    stream = spark.readStream.schema(PACKET).parquet(landing)
    out = str(tmp_path / "out")
    q = (stream_flow_summary(stream, idle_seconds=600).writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    got = spark.read.parquet(out).toPandas()
    assert list(got["packet_id"]) == [4]          # the open conversation is not closed yet
    want = flow_summary(spark.createDataFrame(early, PACKET)).toPandas()
    for c in FEATURES:
        assert got[c].iloc[0] == pytest.approx(want[c].iloc[0], rel=1e-9, abs=1e-9), c
