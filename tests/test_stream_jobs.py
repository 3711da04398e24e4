"""Order, sessions, late rows and exactly-once tables of the streaming jobs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from packetlens.operators.flows import flow_features, flow_sessions, quarantined_packets, session_facts, stream_sessions
from packetlens.plans.detection import detect, fit_detector, typed_flows
from packetlens.operators.models import load_hybrid, save_hybrid
from packetlens.operators.reports import session_counters
from packetlens.schemas import FEATURES, PACKET
from packetlens.session import scratch_path
from packetlens.sources.fixtures import packets_from_events, table
from packetlens.streaming import jobs
from packetlens.streaming.flows import stream_flow_features, stream_flow_summary, track_flows
from packetlens.streaming.sink import BatchLog

SF = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def few_state_stores(spark):
    """Each shuffle partition commits a state store in every micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def packet(i, sec, a, b, ln=60, proto=6):
    hosts = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 22), ("10.0.0.4", 5000)]
    return (i, BASE + dt.timedelta(seconds=sec), float(sec), hosts[a][0], hosts[b][0], hosts[a][1], hosts[b][1], proto, ln, 5,
            5 if proto == 6 else None, 100 if proto == 6 else None)


def rows_of(df):
    return {r.packet_id: tuple(round(r[n], 6) for n in FEATURES) for r in df.collect()}


def as_files(spark, packets, files, name, order=None):
    """A landing folder, one file a slice; ``order`` sorts the rows before they are cut."""
    path = scratch_path(spark, name)
    rows = packets.collect()
    rows.sort(key=order or (lambda r: hash((r.packet_id * 7919) % 104729)))
    step = -(-len(rows) // files)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k:k + step], PACKET).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def some_packets(spark):
    """Few conversations, with replies, ties and gaps around an hour."""
    rng, rows, sec = random.Random(4), [], 0.0
    for i in range(700):
        sec += rng.choice([0, 0, 0.001, 1.5, 40, 400, 3600, 3600.000001, 4000])
        a, b = rng.choice([(0, 1), (1, 0), (0, 2), (2, 0), (3, 1), (1, 3), (2, 2)])
        rows.append(packet(i, sec, a, b, rng.choice([0, 20, 41, 60, 1500]), rng.choice([6, 6, 17])))
    return spark.createDataFrame(rows, PACKET)


@pytest.mark.parametrize("files", [1, 4, 16])
def test_any_order_and_any_batches_give_the_batch_rows(spark, some_packets, files):
    path = as_files(spark, some_packets, files, "order")
    last = some_packets.agg(F.max("ts")).first()[0]
    jobs.land_flush(spark, path, last + dt.timedelta(days=60))
    stream = lambda: jobs.read_stream(spark, path, PACKET, max_files=1)
    delay = 40 * 86400
    out, q = jobs.run_append(stream_flow_features(stream(), delay, slot_seconds=3600, shards=3), "any")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == files + 1
    assert rows_of(spark.read.parquet(out)) == rows_of(flow_features(some_packets))
    out, _ = jobs.run_append(stream_flow_summary(stream(), 3600, delay, slot_seconds=3600, shards=3), "any-sessions")
    got = spark.read.parquet(out)
    assert rows_of(got) == rows_of(flow_sessions(some_packets, 3600)) and got.count() > 20


def test_sessions_close_as_time_goes_on(spark, some_packets):
    """In time order with a short delay most sessions close long before the end."""
    path = as_files(spark, some_packets, 12, "ordered", order=lambda r: (r.ts, r.packet_id))
    stream = jobs.read_stream(spark, path, PACKET, max_files=1)
    log, _ = jobs.run_batches(track_flows(stream, ("session", "kept"), 60, 3600, shards=2), scratch_path(spark, "closing"), lambda b: {"t": b})
    got, want = rows_of(log.read("t").where("kind = 'session'")), rows_of(flow_sessions(some_packets, 3600))
    assert set(got.items()) <= set(want.items()) and len(want) - len(got) <= 4   # the open ones
    assert log.read("t").where("kind = 'late'").count() == 0
    with pytest.raises(ValueError):
        track_flows(stream, ("session",), None, 3600)


def test_late_packets_are_counted(spark, some_packets):
    held = F.col("packet_id") % 5 == 0
    path = scratch_path(spark, "late")
    for part in (some_packets.where(~held), some_packets.where(held)):
        part.coalesce(1).write.mode("append").parquet(path)
    end = some_packets.where(~held).agg(F.max("ts")).first()[0]
    late = {r.packet_id for r in some_packets.where(held & (F.col("ts") < end - dt.timedelta(seconds=100_000))).collect()}

    def run():
        stream = jobs.read_stream(spark, path, PACKET, max_files=1)
        out, _ = jobs.run_append(track_flows(stream, ("kept",), 100_000, shards=2), "late")
        return {k: {r.packet_id for r in spark.read.parquet(out).where(F.col("kind") == k).collect()} for k in ("late", "kept")}

    talk = {r.packet_id for r in some_packets.where("src_ip = dst_ip").collect()}   # never tracked
    before = run()
    waiting = set(range(700)) - talk - before["late"] - before["kept"]
    assert before["late"] == late - talk and waiting and late
    jobs.land_flush(spark, path, end + dt.timedelta(days=9))
    after = run()
    assert after["late"] == late - talk and after["kept"] | after["late"] == set(range(700)) - talk


def test_live_job_equals_batch(spark):
    packets = packets_from_events(table(spark, SF, "events"))
    edges = {"ddos_rate": 1e-4, "scan_rate": 1e-5}
    model = scratch_path(spark, "model")
    flows = typed_flows(packets, **edges)
    save_hybrid(fit_detector(flows, max_iter=3, max_depth=3), model)
    path = jobs.land_in_files(packets, "live", 3)
    first, last = packets.agg(F.min("ts"), F.max("ts")).first()
    jobs.land_flush(spark, path, last + 2 * (last - first))
    stream = jobs.read_stream(spark, path, packets.schema, max_files=1)
    log, _ = jobs.stream_detect(stream, model, scratch_path(spark, "live"), (last - first).total_seconds() + 1, **edges, slot_seconds=86400)
    cols = ["packet_id", "dst_port", "label", "attack_type", "severity", "confidence"]
    key = lambda df: sorted(map(str, df.select(*cols, *[F.round(c, 6).alias(c) for c in ("dl_error", "ml_prob", "final_score")]).collect()))
    want = detect(flows, load_hybrid(spark, model))
    verdicts = log.read("verdicts")
    assert key(verdicts) == key(want) and log.read("late").count() == 0
    total = jobs.total_counters(log.read("counters")).agg(*[F.sum(c).alias(c) for c in ("total_packets", "total_attacks", "total_normal")]).first()
    batch = session_counters(want).first()
    assert tuple(total) == (batch.total_packets, batch.total_attacks, batch.total_normal)
    assert log.read("alerts").count() == batch.total_attacks


@pytest.mark.parametrize("when", ["before", "after"])
def test_interrupted_stream_gives_each_row_once(spark, when, monkeypatch):
    data = spark.range(400).withColumn("v", F.col("id") * 2)
    path, base, calls = scratch_path(spark, "once-in"), scratch_path(spark, "once"), []
    data.repartition(4).write.parquet(path)
    publish = BatchLog.publish

    def failing(self, batch_id, tables, views=None):
        if batch_id == 1 and not calls:
            calls.append(1)
            if when == "after":   # published, but Spark doesn't learn of it
                publish(self, batch_id, tables, views)
            else:                 # written, but not published
                monkeypatch.setattr(self, "_fs", None)
                publish(self, batch_id, tables, views)
            raise RuntimeError("lost")
        publish(self, batch_id, tables, views)

    monkeypatch.setattr(BatchLog, "publish", failing)
    start = lambda: jobs.run_batches(jobs.read_stream(spark, path, data.schema, max_files=1), base, lambda b: {"t": b},
                                     {"n": lambda t: t["t"].groupBy().count()})[0]
    with pytest.raises(StreamingQueryException):
        start()
    log = start()
    assert log.batches() == [0, 1, 2, 3] and calls
    assert sorted(r.id for r in log.read("t").collect()) == list(range(400))
    assert log.read("n").agg(F.sum("count")).first()[0] == 400
    with pytest.raises(ValueError):
        log.read("absent")


def test_packet_ids_of_any_size(spark):
    ids = [-2**63, -2**63 + 1, 2**63 - 2, 2**63 - 1]
    rows = [packet(i, k, 0, 1) for k, i in enumerate(ids)] + [packet(None, 9, 0, 1), (5, None, None, *packet(5, 1, 0, 1)[3:])]
    p = spark.createDataFrame(rows, PACKET)
    assert {r.packet_id for r in flow_features(p).collect()} == set(ids[1:])
    assert quarantined_packets(p).count() == 2


def test_state_is_exact_for_long_gaps(spark):
    """Gaps of years: the sums of their squares exceed 64 bits."""
    rng = np.random.default_rng(3)
    secs = np.cumsum(rng.integers(1, 10**8, 40)).astype(float)
    p = spark.createDataFrame([packet(i, s, 0, 1, 100) for i, s in enumerate(secs)], PACKET)
    path = as_files(spark, p, 5, "gaps", order=lambda r: r.packet_id)
    out, _ = jobs.run_append(stream_flow_features(jobs.read_stream(spark, path, PACKET, max_files=1)), "gaps")
    got, want = rows_of(spark.read.parquet(out)), rows_of(flow_features(p))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in got)


@pytest.mark.parametrize("files", [1, 4, 16])
def test_session_windows_equal_islands(spark, some_packets, files):
    path = as_files(spark, some_packets, files, "windows")
    last = some_packets.agg(F.max("ts")).first()[0]
    jobs.land_flush(spark, path, last + dt.timedelta(days=60))
    out, _ = jobs.run_append(stream_sessions(jobs.read_stream(spark, path, PACKET, max_files=1), 3600, 40 * 86400), "windows")
    want = session_facts(some_packets, 3600)
    got = spark.read.parquet(out)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert want.agg(F.sum("fwd_packets") + F.sum("bwd_packets")).first()[0] == some_packets.where("src_ip <> dst_ip").count()
