"""The composed detection job, split CSVs and permutation importance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators import models as M
from packetlens.operators.scoring import ensemble_live
from packetlens.plans import detection as D
from packetlens.schemas import FEATURES, fcol
from packetlens.session import write_once
from packetlens.sources.files import read_flow_csv, split_flow_csv
from packetlens.sources.fixtures import packets_from_events, table

EDGES = (D.EVENT_DDOS_RATE, D.EVENT_SCAN_RATE)


@pytest.fixture(scope="module")
def packets(spark):
    return packets_from_events(table(spark, "/root/testdata/sf0.001", "events"))


@pytest.fixture(scope="module")
def verdicts(packets):
    return write_once(D.detect_batch(packets, *EDGES, max_iter=10, max_depth=4), "test-verdicts")


def test_verdicts_follow_from_the_model_outputs(packets, verdicts):
    rows = verdicts.toPandas()
    assert len(rows) == D.typed_flows(packets, *EDGES).count()
    final = np.clip(rows["dl_score"] + 0.3 * rows["ml_prob"], 0, 1)
    assert rows["final_score"].to_numpy() == pytest.approx(final.to_numpy(), abs=2e-4)
    gated = (rows["final_score"] > 0.5) & (rows["ml_prob"] >= 0.30) & (rows["final_score"] >= 0.75)
    assert list(rows["label"] == "ATTACK") == list(gated)
    want = np.where(~gated, None, np.where(rows["final_score"] > 0.75, "crit", "warn"))
    assert [s if isinstance(s, str) else None for s in rows["severity"]] == list(want)
    # the weak label can be learnt from the columns
    attack = rows["attack_type"] != "Other"
    assert ((rows["ml_prob"] > 0.5) == attack).mean() > 0.95


def test_report_counts_the_verdicts(verdicts):
    rows = verdicts.toPandas()
    got = {(r["section"], r["name"]): r["value"] for r in D.detection_report(verdicts).collect()}
    attacks = rows[rows["label"] == "ATTACK"]
    assert got["counter", "total_packets"] == len(rows)
    assert got["counter", "total_attacks"] == len(attacks)
    for t in ("DDoS", "PortScan", "BruteForce", "SQLInject", "Other"):
        assert got["attack_type", t] == (attacks["attack_type"] == t).sum()


def test_decision_edge_does_not_move_with_the_threshold(spark):
    df = spark.createDataFrame([(0.6, 0.0), (0.3, 0.0)], "dl_error double, ml_prob double")
    labels = [r["label"] for r in ensemble_live(df, threshold=0.876).collect()]
    assert labels == ["ATTACK", "NORMAL"]


def test_one_invalid_row_leaves_the_others_alone(packets):
    flows = write_once(D.typed_flows(packets, *EDGES), "test-flows")
    model = D.fit_detector(flows, max_iter=2, max_depth=3)
    first = flows.agg(F.min("packet_id")).first()[0]
    broken = flows.withColumn("Fwd Packets/s", F.when(F.col("packet_id") == first, F.lit(float("nan")))
                              .otherwise(F.col(fcol("Fwd Packets/s"))))
    key = lambda df: {r["packet_id"]: r["label"] for r in df.select("packet_id", "label").collect()}
    a, b = key(D.detect(flows, model)), key(D.detect(broken, model))
    assert a.keys() == b.keys() and {k: v for k, v in a.items() if k != first} == {k: v for k, v in b.items() if k != first}
    batch = key(model.score_batch(broken))
    assert first not in batch and "ATTACK" in batch.values()


def test_importance_permutes_small_tables_whole(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 3), i % 2) for i in range(200)], "id long, a double, b double, y int")
    model = M.fit_trees(df, ["a", "b"], "y", max_iter=5, max_depth=2)
    got = {r["feature"]: r["importance"] for r in M.permutation_importance(df, model, "y", "id").collect()}
    whole = {r["feature"]: r["importance"] for r in M.permutation_importance(df, model, "y", "id", buckets=1).collect()}
    assert got == pytest.approx(whole) and got["a"] > 0.5


def test_importance_ranks_the_deciding_column_first(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(i, *map(float, v), int(v[1] > 0)) for i, v in enumerate(x)],
                               "id long, a double, b double, c double, y int")
    model = M.fit_trees(df, ["a", "b", "c"], "y", max_iter=5, max_depth=2)
    got = M.permutation_importance(df, model, "y", "id", buckets=8).collect()
    assert got[0]["feature"] == "b" and got[0]["importance"] > 0.3
    assert all(abs(r["importance"]) < 0.1 for r in got[1:])
    assert M.permutation_importance(df.limit(0), model, "y", "id").count() == 0


def test_malformed_csv_rows_are_split_by_all_their_fields(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" Flow ID, Total Fwd Packets, Label\n1,2,BENIGN\n2,x,DDoS\n3,Infinity,BENIGN\n")
    good, bad = split_flow_csv(read_flow_csv(spark, str(tmp_path / "f.csv")))
    assert sorted(r["Flow ID"] for r in good.select("Flow ID").collect()) == [1.0, 3.0]
    assert bad.count() == 1 and bad.first()["reason"] == "malformed"
