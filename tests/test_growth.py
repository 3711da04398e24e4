"""What one task or worker holds doesn't grow with the tables."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetlens.operators import dense, flows as flow_steps, models as M
from packetlens.operators.stats import error_share_topk
from packetlens.plans import queries as Q
from packetlens.sources.fixtures import packets_from_events, table
from packetlens.streaming import flows, jobs

SF = "/root/testdata/sf0.001"


def test_error_share_adds_the_squares_up_once(spark):
    names = [f"r{i}" for i in range(12)]
    df = spark.range(40).select("id", *[(F.rand(i) - 0.5).alias(n) for i, n in enumerate(names)])
    plan = error_share_topk(df, names, keep=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("r11#") < 12      # a few per step, not one for every share


class _Map(dict):
    def getValue(self, k):
        return self.get(k)

    def updateValue(self, k, v):
        self[k] = v

    removeKey = dict.__delitem__


class _Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, _Map())

    def registerTimer(self, ms):
        pass


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _tracked(frames, idle_us=None):
    tracker = flows.FlowTracker(("flow", "session"), 0.5, True, 60_000_000, idle_us)
    tracker.init(_Handle())
    out = [*tracker.handleInputRows((0,), iter(frames), _At(0)), *tracker.handleExpiredTimer((0,), _At(10**9), None)]
    return pd.concat(out).sort_values(["kind", "packet_id"]).reset_index(drop=True)


def _frames(n, of):
    rng = np.random.default_rng(3)
    conv = [flows.SEP.join(("10.0.0.1", str(c), "9.9.9.9", "80", "6")) for c in rng.integers(0, n // 8, n)]
    rows = pd.DataFrame({"conv": conv, "packet_id": np.arange(n), "ts_us": rng.integers(0, 600_000_000, n), "pkt_len": rng.integers(40, 1500, n),
                         "from_lo": rng.random(n) < 0.7, "hdr": 40, "win": 100})
    return [rows[at:at + of] for at in range(0, n, of)]


def test_tracker_works_in_bounded_pieces(monkeypatch):
    """A shard's packets of one release are computed some at a time, whatever their number."""
    sizes, advance = [], flows.advance
    monkeypatch.setattr(flows, "advance", lambda seg, *a: sizes.append(seg.n) or advance(seg, *a))
    _tracked(_frames(50_000, 10_000))
    assert sum(sizes) == 50_000 and max(sizes) <= 20_000


def test_tracker_pieces_give_the_same_rows(monkeypatch):
    whole = _tracked(_frames(3000, 500), 30_000_000)
    sizes, wait = [], flows.FlowTracker.keep_waiting
    monkeypatch.setattr(flows.FlowTracker, "keep_waiting", lambda self, p, t: sizes.append(p.num_rows) or wait(self, p, t))
    monkeypatch.setattr(flows, "RELEASE", 700)
    monkeypatch.setattr(flows, "CHUNK", 90)
    pd.testing.assert_frame_equal(_tracked(_frames(3000, 500), 30_000_000), whole)
    assert sizes == [1000, 1000, 1000]


def test_landing_has_as_many_files_a_batch_as_the_table_has_partitions(spark):
    path, each = jobs.land_batches(spark.range(4000).repartition(3), "growth", 4, F.col("id"))
    assert each == 3 and len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 12


@pytest.fixture
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_late_lands_in_many_files(spark, monkeypatch, few_state_stores):
    """Late rows are those behind the first landing's watermark, however many files it has."""
    packets = packets_from_events(table(spark, SF, "events")).repartition(3).localCheckpoint()
    paths, scratch = {}, Q.scratch_path
    monkeypatch.setattr(Q, "_packets", lambda spark, sf: packets)
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: paths.setdefault(name, scratch(spark, name)))
    got = {r["part"]: (r["n"], r["id_sum"]) for r in Q.q_stream_late(spark, SF).collect()}
    held = F.col("packet_id") % 10 == 0
    mark = packets.where(~held).agg(F.expr("max(unix_millis(ts)) - 7 * 86400000")).first()[0]
    late = held & (F.unix_micros("ts") < mark * 1000)
    want = {kind: tuple(packets.where(cond).agg(F.count("*"), F.sum("packet_id")).first()) for kind, cond in (("late", late), ("kept", ~late))}
    assert got == want and want["late"][0] > 0
    assert len([f for f in os.listdir(paths["landing-late"]) if f.endswith(".parquet")]) == 7


def test_trees_are_fitted_on_bounded_partitions(spark, monkeypatch):
    df = spark.range(2000).coalesce(1).select("id", (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 10 > 4, "x").otherwise("y").alias("kind"))
    monkeypatch.setattr(M, "TREE_ROWS", 300)
    sizes = [r[0] for r in M.in_tree_parts(df).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 7 and max(sizes) < 600
    out = M.tree_only_labels(df, ["a"], "kind", max_iter=2, max_depth=2)
    assert out.where("kind = predicted_label").count() == 2000


def test_dense_rows_are_multiplied_in_blocks():
    x = np.random.default_rng(1).normal(size=(1300, 5))
    layers = dense.initial_layers(5, (4, 2, 4))
    parts = [dense.gradient(b, layers) for b in dense.blocks(x)]
    loss, g = dense.gradient(x, layers)
    assert [len(b) for b in dense.blocks(x)] == [512, 512, 276]
    assert sum(p[0] for p in parts) == pytest.approx(loss)
    assert np.allclose(sum(dense._flat(p[1]) for p in parts), dense._flat(g))


def test_packet_source_is_parsed_once(spark):
    """Filters over the packets don't repeat the parsing of an event's text."""
    plan = flow_steps._prepared(packets_from_events(table(spark, SF, "events")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_running_counts_are_kept_for_header_levels_that_occur(spark):
    packets = packets_from_events(table(spark, SF, "events"))
    assert flow_steps.extent(packets) == (packets.count(), [7, 10, 11, 12, 13])
    plan = flow_steps.flow_features(packets, strategy="window")._jdf.queryExecution().optimizedPlan().toString()
    assert "above13" in plan and "above14" not in plan


def test_queries_run_with_methods_that_the_jvm_compiles(spark):
    import __spark_entry__ as entry
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    entry.queries()["flow_features"](spark, SF)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_bucketed_rows_are_computed_once(spark):
    """The running values are written once; what is left joins the carry to them and doesn't go back to the packets."""
    packets = packets_from_events(table(spark, SF, "events"))
    plan = flow_steps.flow_features_bucketed(packets, bucket_seconds=86400)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("Join ") == 1
