"""Flow features against a brute-force per-packet model of the tracker."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from packetlens.operators.flows import flow_features, flow_summary
from packetlens.schemas import FEATURES, PACKET


def brute_force(packets):
    """Per conversation: the initiator is the first sender; F = its packets
    before the first reply, B = the responder's packets; emit on initiator
    packets once |F| >= 2. Written from the documented semantics."""
    out = {}
    conv = {}
    for p in sorted(packets, key=lambda p: (p["ts_us"], p["packet_id"])):
        if p["proto"] not in (6, 17):
            continue
        a, b = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        if a == b:
            continue
        key = (min(a, b), max(a, b), p["proto"])
        c = conv.setdefault(key, {"init": a, "F": [], "B": [], "replied": False, "start": p["ts_us"]})
        hdr = (p["ip_ihl"] if p["ip_ihl"] is not None else 5) * 4 + (
            (p["tcp_dataofs"] * 4 if p["tcp_dataofs"] is not None else 20) if p["proto"] == 6 else 8)
        if a != c["init"]:
            c["replied"] = True
            c["B"].append((p["ts_us"], p["pkt_len"]))
            continue
        if not c["replied"]:
            c["F"].append((p["ts_us"], p["pkt_len"]))
        F_, B_ = c["F"], c["B"]
        if len(F_) < 2:
            continue
        fl = [x for _, x in F_]
        bl = [x for _, x in B_]
        allv = fl + bl
        fts = [t for t, _ in F_]
        bts = [t for t, _ in B_]
        fi = [(y - x) / 1e6 for x, y in zip(fts, fts[1:])]
        bi = [(y - x) / 1e6 for x, y in zip(bts, bts[1:])]
        ats = sorted(fts + bts)
        ai = [(y - x) / 1e6 for x, y in zip(ats, ats[1:])]

        def pstd(v):
            if len(v) <= 1:
                return 0.0
            m = sum(v) / len(v)
            return math.sqrt(sum((x - m) ** 2 for x in v) / len(v))

        dur = max((p["ts_us"] - c["start"]) / 1e6, 0.5)
        out[p["packet_id"]] = {
            'Destination Port': p["dst_port"], 'Total Fwd Packets': len(fl),
            'Total Length of Fwd Packets': sum(fl), 'Fwd Packet Length Max': max(fl),
            'Fwd Packet Length Mean': sum(fl) / len(fl), 'Fwd Packet Length Std': pstd(fl),
            'Bwd Packet Length Max': max(bl) if bl else 0, 'Bwd Packet Length Min': min(bl) if bl else 0,
            'Bwd Packet Length Mean': sum(bl) / len(bl) if bl else 0,
            'Min Packet Length': min(allv), 'Packet Length Mean': sum(allv) / len(allv),
            'Fwd Packets/s': len(fl) / dur, 'Fwd Header Length': hdr, 'Fwd Header Length.1': hdr,
            'Fwd IAT Total': sum(fi), 'Fwd IAT Mean': sum(fi) / len(fi), 'Fwd IAT Std': pstd(fi),
            'Fwd IAT Max': max(fi), 'Bwd IAT Mean': sum(bi) / len(bi) if bi else 0,
            'Flow IAT Std': pstd(ai), 'Average Packet Size': sum(allv) / len(allv),
            'Avg Fwd Segment Size': sum(fl) / len(fl), 'Avg Bwd Segment Size': sum(bl) / len(bl) if bl else 0,
            'Subflow Fwd Packets': len(fl), 'Subflow Fwd Bytes': sum(fl), 'Subflow Bwd Packets': len(bl),
            'Down/Up Ratio': len(bl) / max(len(fl), 1), 'Init_Win_bytes_forward': p["tcp_window"] if p["proto"] == 6 else 0,
            'Init_Win_bytes_backward': 0, 'act_data_pkt_fwd': sum(1 for x in fl if x > hdr),
        }
    return out


def to_df(spark, packets):
    import datetime as dt
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for p in packets:
        ts = base + dt.timedelta(microseconds=p["ts_us"])
        rows.append(Row(packet_id=p["packet_id"], ts=ts, ts_s=p["ts_us"] / 1e6, src_ip=p["src_ip"],
                        dst_ip=p["dst_ip"], src_port=p["src_port"], dst_port=p["dst_port"], proto=p["proto"],
                        pkt_len=p["pkt_len"], ip_ihl=p["ip_ihl"], tcp_dataofs=p["tcp_dataofs"],
                        tcp_window=p["tcp_window"]))
    return spark.createDataFrame(rows, PACKET)


def compare(spark, packets):
    want = brute_force(packets)
    got = {r["packet_id"]: r.asDict() for r in flow_features(to_df(spark, packets)).collect()}
    assert set(got) == set(want)
    for pid, w in want.items():
        for k, v in w.items():
            assert got[pid][k] == pytest.approx(float(v), rel=1e-9, abs=1e-9), (pid, k)
    return got


HOSTS = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 22), ("10.0.0.1", 1001)]


def packet(i, ts, s, d, proto=6, ln=60, ihl=5, off=5, win=100):
    return {"packet_id": i, "ts_us": ts, "src_ip": HOSTS[s][0], "src_port": HOSTS[s][1],
            "dst_ip": HOSTS[d][0], "dst_port": HOSTS[d][1], "proto": proto, "pkt_len": ln,
            "ip_ihl": ihl, "tcp_dataofs": off if proto == 6 else None, "tcp_window": win}


def test_boundary_flows(spark):
    pk = [
        packet(1, 0, 0, 1),                                   # single packet: no emission
        packet(2, 10, 2, 3), packet(3, 20, 3, 2),             # reply after one packet: never emits
        packet(4, 30, 2, 3),
        packet(5, 0, 1, 2, ln=100), packet(6, 5, 1, 2, ln=41),  # reply after two
        packet(7, 7, 2, 1, ln=500), packet(8, 9, 1, 2, ln=70), packet(9, 9, 2, 1, ln=90),
        packet(10, 0, 0, 3, proto=17, ln=30), packet(11, 0, 0, 3, proto=17, ln=29),  # UDP, equal ts
        packet(12, 1_000_000, 0, 3, proto=17, ln=120, ihl=None),
        packet(13, 0, 0, 0), packet(14, 1, 0, 0),             # self-talk never emits
        packet(15, 2, 0, 1, proto=1),                         # not TCP/UDP
    ]
    got = compare(spark, pk)
    assert set(got) == {6, 8, 11, 12}
    assert got[8]['Total Fwd Packets'] == 2 and got[8]['Subflow Bwd Packets'] == 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 3), st.integers(0, 3), st.sampled_from([6, 17]),
                          st.integers(20, 200), st.integers(5, 15), st.integers(5, 15)),
                min_size=1, max_size=60))
def test_property_random_interleavings(spark, items):
    pk = [packet(i, ts * 250_000, s, d, proto, ln, ihl, off, win=i * 7 % 65536)
          for i, (ts, s, d, proto, ln, ihl, off) in enumerate(items)]
    compare(spark, pk)


def test_summary_is_last_emission(spark):
    rnd = random.Random(3)
    pk = [packet(i, rnd.randrange(0, 4_000_000_000), rnd.randrange(4), rnd.randrange(4),
                 rnd.choice([6, 17]), rnd.randrange(20, 300), 5, rnd.randrange(5, 16))
          for i in range(400)]
    df = to_df(spark, pk)
    ff = flow_features(df).toPandas()
    last = (ff.sort_values(["ts", "packet_id"]).groupby(["src_ip", "dst_ip", "src_port", "dst_port", "proto"])
            .tail(1))
    for kw in ({"bucket_seconds": 600}, {"target_rows": 3}, {}):
        summ = flow_summary(df, **kw).toPandas()
        assert len(summ) <= len(last)
        a = summ.set_index("packet_id").sort_index()
        b = ff.set_index("packet_id").loc[a.index]
        for c in FEATURES:
            assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), rel=1e-9, abs=1e-9), (kw, c)


def test_one_exchange_and_pushed_filter(spark, tmp_path):
    pk = [packet(i, i * 1000, i % 2, 1 - i % 2) for i in range(20)]
    path = str(tmp_path / "p")
    to_df(spark, pk).write.parquet(path)
    df = spark.read.parquet(path)
    plan = flow_features(df, strategy="window")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    scan = df.where("proto in (6, 17)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "proto" in scan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 3), st.integers(0, 3), st.sampled_from([6, 17]),
                          st.integers(20, 200), st.integers(5, 15), st.integers(5, 15)),
                min_size=1, max_size=60))
def test_bucketed_equals_brute_force(spark, items):
    from packetlens.operators.flows import flow_features_bucketed
    pk = [packet(i, ts * 250_000, s, d, proto, ln, ihl, off, win=i * 7 % 65536)
          for i, (ts, s, d, proto, ln, ihl, off) in enumerate(items)]
    want = brute_force(pk)
    got = {r["packet_id"]: r.asDict() for r in flow_features_bucketed(to_df(spark, pk), bucket_seconds=1).collect()}
    assert set(got) == set(want)
    for pid, w in want.items():
        for k, v in w.items():
            assert got[pid][k] == pytest.approx(float(v), rel=1e-9, abs=1e-9), (pid, k)


def test_auto_split_equals_window(spark):
    rnd = random.Random(11)
    pk = [packet(i, rnd.randrange(0, 10_000_000), rnd.randrange(4), rnd.randrange(4),
                 rnd.choice([6, 17]), rnd.randrange(20, 300), 5, rnd.randrange(5, 16))
          for i in range(300)]
    df = to_df(spark, pk)
    a = flow_features(df, strategy="window").toPandas().set_index("packet_id").sort_index()
    b = flow_features(df, strategy="auto", hot_rows=20, target_rows=3).toPandas().set_index("packet_id").sort_index()
    assert list(a.index) == list(b.index)
    for c in FEATURES:
        assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), rel=1e-9, abs=1e-9), c


def test_quarantine_and_header_defaults(spark):
    from pyspark.sql import functions as F

    from packetlens.functions.columns import header_len
    from packetlens.operators.flows import quarantined_packets, valid_packets
    pk = [packet(1, 0, 0, 1), packet(2, 1, 0, 1, ihl=16), packet(3, 2, 0, 1, off=None),
          packet(4, 3, 0, 1, proto=17), packet(5, 4, 0, 1, proto=1)]
    pk[0]["src_port"] = 70000          # not a 16-bit port
    df = to_df(spark, pk)
    good = {r["packet_id"] for r in valid_packets(df).collect()}
    bad = {r["packet_id"]: r["reason"] for r in quarantined_packets(df).collect()}
    assert good == {3, 4} and bad == {1: "malformed", 2: "malformed"}
    hl = {r["packet_id"]: r["h"] for r in df.select("packet_id", header_len().alias("h")).collect()}
    assert hl[3] == 40 and hl[4] == 28     # TCP without dataofs -> 20 + 20; UDP -> 20 + 8
    assert F is not None


@pytest.mark.parametrize("hot_rows", [3])
def test_hot_conversations_by_broadcast_give_the_same_rows(spark, hot_rows):
    """Some, all or few conversations take the broadcast side of the facts join;
    packets of 65,535 bytes overflow nothing on either path."""
    from pyspark.sql import functions as F

    from packetlens.operators.flows import flow_features_bucketed
    from packetlens.sources.fixtures import packets_from_events, table
    p = packets_from_events(table(spark, "/root/testdata/sf0.001", "events")).withColumn(
        "pkt_len", F.when(F.col("packet_id") % 5 == 0, F.lit(65535)).otherwise(F.col("pkt_len")))
    rows = lambda df: df.toPandas().sort_values("packet_id").reset_index(drop=True)
    want = rows(flow_features(p, strategy="window"))
    got = rows(flow_features_bucketed(p, bucket_seconds=86400, hot_rows=hot_rows))
    last = rows(flow_summary(p, target_rows=2, hot_rows=hot_rows))
    whole = want[want["packet_id"].isin(last["packet_id"])].reset_index(drop=True)
    assert list(got["packet_id"]) == list(want["packet_id"]) and list(whole["packet_id"]) == list(last["packet_id"])
    for c in FEATURES:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-6), c
        assert last[c].to_numpy() == pytest.approx(whole[c].to_numpy(), rel=1e-9, abs=1e-6), c
