"""CSV to batch verdicts, feature choice, held-out quality, exact quantiles, one-pass evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.operators import models as M
from packetlens.operators import stats as S
from packetlens.operators.clean import head
from packetlens.plans import detection as D
from packetlens.schemas import FEATURES, fcol
from packetlens.session import scratch_path, write_once
from packetlens.sources.files import read_threshold, write_flow_csv, write_scores, write_threshold
from packetlens.sources.fixtures import flows_from_lineitem, packets_from_events, table

SF = "/root/testdata/sf0.001"
IDS = ["Flow ID", "line"]
SMALL = {"max_iter": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def csv(spark):
    path = scratch_path(spark, "csv")
    write_flow_csv(flows_from_lineitem(table(spark, SF, "lineitem")), path)
    return write_once(D.csv_flows(spark, path, IDS), "csv-rows")


@pytest.fixture(scope="module")
def csv_model(csv):
    train = csv.withColumn("attack", (F.col("Label") == "DDoS").cast("int")).withColumn("benign", F.col("attack") == 0)
    return M.fit_hybrid(train.where(~D.held_out(["Flow ID"])), list(FEATURES), "attack", "benign", quantile=None, **SMALL)


@pytest.mark.parametrize("sample", [None, 10])
def test_batch_verdicts_follow_from_their_own_columns(spark, csv, csv_model, sample):
    out = scratch_path(spark, "verdicts")
    write_scores(D.batch_verdicts(csv, csv_model, IDS, sample), out)
    rows = spark.read.parquet(out).toPandas()
    src = csv if sample is None else head(csv.drop("Label"), sample, [*IDS, *FEATURES])
    fine = src.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('infinity')" for c in FEATURES))
    assert sorted(zip(rows["Flow ID"], rows["line"])) == sorted((r[0], r[1]) for r in fine.select(*[F.col(fcol(c)) for c in IDS]).collect())
    if sample is None:
        assert len(rows) > 1000 and csv.count() > len(rows)      # rows with inf or null are dropped, the others keep their ids
    span = rows.dl_error.max() - rows.dl_error.min()
    dl = (rows.dl_error - rows.dl_error.min()) / span
    assert rows.dl_score.to_numpy() == pytest.approx(dl.to_numpy(), abs=1e-9)
    final = 0.5 * dl + 0.5 * rows.ml_prob
    assert rows.final_score.to_numpy() == pytest.approx(final.to_numpy(), abs=1e-9)
    assert list(rows.label == "ATTACK") == list(final > 0.5)


def test_threshold_file_round_trip(spark):
    path = scratch_path(spark, "threshold")
    write_threshold(spark, path, 0.123456789)
    assert read_threshold(spark, path) == 0.123456789


@pytest.fixture(scope="module")
def wide(spark):
    flows = D.typed_flows(packets_from_events(table(spark, SF, "events")), D.EVENT_DDOS_RATE, D.EVENT_SCAN_RATE)
    return write_once(D.wide_flows(flows), "wide")


def test_chosen_features_are_saved_with_the_model(spark, wide):
    assert len(D.WIDE) == len(set(D.WIDE)) == 79 and set(D.WIDE) <= set(wide.columns)
    path = scratch_path(spark, "chosen")
    chosen = D.fit_chosen(wide, path, top=12, forest={"num_trees": 5}, **SMALL)
    names = [r.feature for r in chosen.collect()]
    model = M.load_hybrid(spark, path)
    assert model.anomaly.features == model.trees.features == names and len(set(names)) == 12
    # the saved order decides, wherever the columns stand
    a = model.score_live(wide).select("packet_id", "dl_error", "ml_prob", "label")
    b = model.score_live(wide.select(*[F.col(fcol(c)) for c in sorted(wide.columns, reverse=True)])).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    # a model saved under another order of the same names scores by that order
    again = M.load_hybrid(spark, path)
    other = scratch_path(spark, "other")
    M.save_hybrid(again, other)
    c = M.load_hybrid(spark, other).score_live(wide).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, c.collect()))


def test_held_out_conversations_are_not_learnt(spark, wide):
    part = wide.select(*D.FLOW_KEY, D.held_out(D.FLOW_KEY).alias("out"))
    assert part.groupBy(*D.FLOW_KEY).agg(F.countDistinct("out").alias("n")).where("n > 1").count() == 0
    share = part.agg(F.avg(F.col("out").cast("int"))).first()[0]
    assert 0.05 < share < 0.4
    packets = packets_from_events(table(spark, SF, "events"))
    verdicts = write_once(D.detect_batch(packets, D.EVENT_DDOS_RATE, D.EVENT_SCAN_RATE, **SMALL), "held-verdicts")
    got = {r.model: r for r in D.detection_quality(verdicts).collect()}
    rows = verdicts.where("held_out").toPandas()
    truth, hit = rows.attack_type != "Other", rows.ml_prob > 0.5
    assert got["trees"].n == len(rows) and got["trees"].tp == (truth & hit).sum() and got["trees"].fp == (~truth & hit).sum()
    assert set(got) == {"anomaly", "trees", "verdict"}


@pytest.mark.parametrize("bins,max_local", [(8, 10), (64, 50), (4096, 2_000_000)])
def test_quantile_is_exact_for_any_sketch(spark, bins, max_local):
    rng = np.random.default_rng(bins)
    vals = np.concatenate([np.full(2500, 3.0), rng.normal(0, 1, 1500), rng.pareto(0.5, 500), [-0.0, 0.0, 1e300, -1e300]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),), (float("inf"),)], "e double").repartition(6)
    for q in (0.0, 0.013, 0.5, 0.777, 0.99, 1.0):
        v, n = S.exact_quantile(df, "e", q, with_count=True, bins=bins, max_local=max_local)
        assert n == len(vals) and v == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)
    assert S.exact_quantile(df.limit(0), "e", 0.5) is None and S.exact_quantile(df.limit(0), "e", 0.5, with_count=True) == (None, 0)
    assert S.exact_quantile(spark.createDataFrame([(4.0,)], "e double"), "e", 0.3) == 4.0


def test_all_models_from_one_histogram(spark):
    rng = np.random.default_rng(8)
    rows = [(m, int(t), int(rng.random() < 0.4 + 0.3 * t), None if rng.random() < 0.05 else float(np.round(rng.normal(t * k, 1), 1)))
            for k, m in enumerate(["flat", "some", "good", None]) for t in rng.integers(0, 2, 400)]
    rows += [("only ones", 1, 1, 0.5)] * 5
    df = spark.createDataFrame(rows, "model string, truth int, prediction int, score double")
    got = {r.model: r for r in S.evaluate_all(df).collect()}
    for m in got:
        mine = df.where(F.col("model").eqNullSafe(F.lit(m)))
        one = S.evaluate(mine).first()
        assert {k: got[m][k] for k in ("n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")} == {k: one[k] for k in ("n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")}
        pos = [r[3] for r in rows if r[0] == m and r[1] == 1 and r[3] is not None]
        neg = [r[3] for r in rows if r[0] == m and r[1] == 0 and r[3] is not None]
        if neg:
            want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
            assert got[m].auc == pytest.approx(want) == one.auc
        else:
            assert got[m].auc is None and one.auc is None
    assert S.evaluate_all(df.limit(0)).collect() == [] and S.evaluate(df.limit(0)).first().n == 0
