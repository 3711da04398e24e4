"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the shared test tables through the adapters in
``packetlens.sources.fixtures`` and runs the library operator over the whole
table. ``for_check`` only normalises the output for comparison (doubles
rounded to 6 digits, event times as wall-clock UTC).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.functions.columns import attack_type, dl_score, rule_flags
from packetlens.operators import reports as R
from packetlens.operators.flows import (
    flow_features, flow_features_bucketed, flow_sessions, flow_summary, quarantined_packets, session_facts, stream_sessions,
    valid_packets,
)
from packetlens.operators.scoring import ensemble_batch, ensemble_live, live_gate
from packetlens.plans.detection import (
    EVENT_DDOS_RATE, EVENT_SCAN_RATE, FLOW_KEY, batch_verdicts, csv_flows, detect_batch, detection_quality, detection_report, fit_chosen,
    fit_detector, flow_attack_breakdown, held_out, score_rows, typed_flows, wide_flows,
)
from packetlens.operators.dense import fit_dense, load_dense
from packetlens.operators import clean as C
from packetlens.operators import models as M
from packetlens.operators import stats as S
from packetlens.schemas import FEATURES, fcol
from packetlens.session import scratch_path, write_once
from packetlens.sources.files import read_flow_csv, read_threshold, split_flow_csv, write_flow_csv, write_scores, write_threshold
from packetlens.sources.fixtures import (
    doc_predictions, flows_from_lineitem, packets_from_events, scored_from_lineitem, table,
    vectors_from_embeddings,
)


# Per-column digits for the comparison (default 6).
COARSE: dict[str, int] = {}


def check_round(c, digits: int = 6):
    """Round through DECIMAL(38,9) so exact half-way values round the same
    (half up) in every engine; non-finite values pass through."""
    fin = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    r = F.round(c.cast("decimal(38,9)"), digits).cast("double") + F.lit(0.0)
    return F.when(fin, r).otherwise(c)


# The benchmark times the operators without this normalisation.
CHECK = True


def for_check(df: DataFrame) -> DataFrame:
    if not CHECK:
        return df
    cols = []
    for f in df.schema.fields:
        c = F.col(fcol(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = check_round(c.cast("double"), COARSE.get(f.name, 6))
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return packets_from_events(table(spark, sf, "events"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_from_lineitem(table(spark, sf, "lineitem"))


def q_flow_features(spark, sf):
    return for_check(flow_features(_packets(spark, sf)))


def q_flow_features_bucketed(spark, sf):
    return for_check(flow_features_bucketed(_packets(spark, sf), bucket_seconds=86400))


def q_flow_summary(spark, sf):
    return for_check(flow_summary(_packets(spark, sf)))


def q_attack_breakdown(spark, sf):
    return for_check(flow_attack_breakdown(_packets(spark, sf), ddos_rate=EVENT_DDOS_RATE, scan_rate=EVENT_SCAN_RATE))


def q_attack_type(spark, sf):
    s = _scored(spark, sf)
    return for_check(s.select("rate", "port", attack_type("port", "rate").alias("attack_type")))


def q_rule_label(spark, sf):
    s = _scored(spark, sf)
    flags = rule_flags("rate", "port")
    return for_check(s.select("rate", "port", *[v.alias(k) for k, v in flags.items()]))


_LIVE_COLS = ["rate", "port", "dl_error", "dl_score", "ml_prob", "final_score", "label", "confidence"]


def q_ensemble_live(spark, sf):
    return for_check(ensemble_live(_scored(spark, sf)).select(*_LIVE_COLS))


def q_live_gate(spark, sf):
    return for_check(live_gate(ensemble_live(_scored(spark, sf))).select(*_LIVE_COLS))


def q_ensemble_batch(spark, sf):
    out = ensemble_batch(_scored(spark, sf))
    return for_check(out.select("rate", "port", "dl_error", "ml_prob", "dl_score", "final_score", "label"))


def q_score_bands(spark, sf):
    return for_check(R.score_bands(score_rows(_scored(spark, sf)), by=["attack_type"]))


def q_session_counters(spark, sf):
    return for_check(R.session_counters(score_rows(_scored(spark, sf), gate=True)))


TIMELINE_BUCKET_S = 7 * 86400


def q_attack_only_breakdown(spark, sf):
    """A4 as the live job counts it: ATTACK rows after the gate."""
    return for_check(R.attack_breakdown(score_rows(_scored(spark, sf), gate=True), "attack_type", label="label"))


def q_timeline(spark, sf):
    return for_check(R.timeline(score_rows(_scored(spark, sf)), "ts", "label",
                                bucket_seconds=TIMELINE_BUCKET_S, last_n=40))


_ORDER = ["ts", "rate", "port", "dl_error", "ml_prob"]


def q_recent_logs(spark, sf):
    rows = score_rows(_scored(spark, sf), gate=True)
    out = R.newest(rows, _ORDER, 60)
    return for_check(out.select("ts", "port", "rate", "dl_error", "ml_prob", "dl_score",
                                "final_score", "label"))


def q_recent_alerts(spark, sf):
    out = R.recent_alerts(score_rows(_scored(spark, sf)), _ORDER, n=15)
    return for_check(out.select("ts", "port", "rate", "attack_type", "final_score", "severity"))


def q_port_class_join(spark, sf):
    j = R.port_class(_scored(spark, sf), "port")
    return for_check(j.groupBy("port_class").agg(F.count(F.lit(1)).alias("n")))


def q_feed_union(spark, sf):
    live = typed_flows(_packets(spark, sf), EVENT_DDOS_RATE, EVENT_SCAN_RATE).select(
        "ts", F.col(fcol("Destination Port")).cast("int").alias("port"),
        F.col(fcol("Fwd Packets/s")).alias("rate"), "attack_type")
    sim = _scored(spark, sf).select("ts", "port", "rate", attack_type("port", "rate").alias("attack_type"))
    return for_check(R.feed_union({"live": live, "SIM": sim}))


def _raw_flows(spark, sf):
    return flows_from_lineitem(table(spark, sf, "lineitem"))


_IDS = ["Flow ID", "line"]


def _clean_flows(spark, sf):
    return C.impute_nonfinite(C.feature_projection(_raw_flows(spark, sf), keep=_IDS + ["Label"]))


def q_feature_projection(spark, sf):
    return for_check(C.feature_projection(_raw_flows(spark, sf), keep=_IDS))


def q_impute_zero(spark, sf):
    return for_check(_clean_flows(spark, sf).drop("Label"))


def q_drop_nonfinite(spark, sf):
    return for_check(C.drop_nonfinite(C.feature_projection(_raw_flows(spark, sf), keep=_IDS)))


def q_standardise(spark, sf):
    d = _clean_flows(spark, sf).drop("Label")
    return for_check(M.standardise(d, FEATURES))


def _centroid_errors(spark, sf):
    """Anomaly error of the mean model (PCA with k = 0): mean squared z-score,
    statistics fitted on the benign rows."""
    d = _clean_flows(spark, sf).withColumn("benign", F.col("Label") == "BENIGN")
    z = M.standardise(d, FEATURES, fit_on=d.where("benign"))
    sq = [F.col(fcol(c)) * F.col(fcol(c)) for c in FEATURES]
    return z.withColumn("dl_error", sum(sq[1:], sq[0]) / F.lit(float(len(FEATURES))))


def q_threshold_p90(spark, sf):
    return for_check(S.calibrate_threshold(_centroid_errors(spark, sf), "dl_error", 0.9, benign="benign"))


def q_error_share_topk(spark, sf):
    d = _clean_flows(spark, sf).withColumn("benign", F.col("Label") == "BENIGN")
    z = M.standardise(d, FEATURES, fit_on=d.where("benign"))
    return for_check(S.error_share_topk(z, FEATURES, k=3, keep=_IDS))


def q_eval_metrics(spark, sf):
    p = doc_predictions(table(spark, sf, "labels"), table(spark, sf, "documents"))
    return for_check(S.evaluate(p, "truth", "prediction", "score"))


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def q_moving_mean_50(spark, sf):
    out = R.moving_mean(_events(spark, sf), "value", ["ts", "event_id"], by=["user_id"], n=50)
    return for_check(out.select("event_id", "user_id", "moving_mean"))


def q_moving_mean_50_blocked(spark, sf):
    out = R.moving_mean(_events(spark, sf), "value", ["ts", "event_id"], by=["user_id"], n=50,
                        strategy="blocked", ts="ts", bucket_seconds=86400)
    return for_check(out.select("event_id", "user_id", "moving_mean"))


def q_moving_mean_50_global(spark, sf):
    out = R.moving_mean(_events(spark, sf), "value", ["ts", "event_id"], n=50, hot_rows=4096)
    return for_check(out.select("event_id", "moving_mean"))


def q_keep_last_200(spark, sf):
    return for_check(R.keep_last(_events(spark, sf), ["ts", "event_id"], by=["user_id"], n=200))


def _vectors(spark, sf):
    return vectors_from_embeddings(table(spark, sf, "embeddings")).withColumn(
        "attack", (~F.col("benign")).cast("int"))


_SMALL_TREES = {"max_iter": 20, "max_depth": 4}


def q_pca_error(spark, sf):
    v = _vectors(spark, sf)
    model = M.fit_anomaly(v, "x", k=8, benign="benign")
    return model.errors(v).select("vec_id", "label", "dl_error")


def q_tree_prob(spark, sf):
    v = _vectors(spark, sf)
    model = M.fit_trees(v, "x", "attack", **_SMALL_TREES)
    return model.probability(v).select("vec_id", "attack", "ml_prob")


def q_rf_select(spark, sf):
    v = _vectors(spark, sf)
    return M.rank_features(v, "x", "attack", names=[f"x{i}" for i in range(64)], top=30)


def q_hybrid_live(spark, sf):
    v = _vectors(spark, sf)
    h = M.fit_hybrid(v, "x", "attack", "benign", k=8, quantile=0.9, **_SMALL_TREES)
    return h.score_live(v).select("vec_id", "dl_error", "dl_score", "ml_prob", "final_score",
                                  "label", "confidence")


def q_hybrid_batch(spark, sf):
    v = _vectors(spark, sf)
    h = M.fit_hybrid(v, "x", "attack", "benign", k=8, quantile=0.9, **_SMALL_TREES)
    return h.score_batch(v).select("vec_id", "dl_error", "dl_score", "ml_prob", "final_score", "label")


def q_model_quality(spark, sf):
    v = _vectors(spark, sf)
    return M.evaluate_models(v, "x", "attack", "benign", k=8, **_SMALL_TREES)


def q_tree_only(spark, sf):
    d = _clean_flows(spark, sf)
    return M.tree_only_labels(d, FEATURES, "Label", max_iter=10, max_depth=3).select(
        *[F.col(fcol(c)) for c in _IDS], "Label", "predicted_label")


def _stream_of(spark, df, name):
    from packetlens.streaming.jobs import land, read_stream
    path = land(df, name)
    return read_stream(spark, path, spark.read.parquet(path).schema)


STREAM_FILES = 4
STREAM_IDLE_S = 86400


def _shuffled_packets(spark, sf, name):
    """The packets as a bounded stream of files that each span the whole time, closed
    by a marker, and the delay that covers their disorder."""
    from packetlens.streaming.jobs import land_batches, land_flush, read_stream
    packets = _packets(spark, sf)
    path, each = land_batches(packets, name, STREAM_FILES, F.col("packet_id"))
    first, last = spark.read.parquet(path).agg(F.min("ts"), F.max("ts")).first()
    delay = (last - first).total_seconds() + 1
    land_flush(spark, path, last + timedelta(seconds=2 * delay + 2 * STREAM_IDLE_S))
    return read_stream(spark, path, packets.schema, max_files=each), delay


def q_stream_flow_features(spark, sf):
    """ST1 + S4: packets out of order, a quarter of the files a micro-batch."""
    from packetlens.streaming.flows import stream_flow_features
    from packetlens.streaming.jobs import run_append
    stream, delay = _shuffled_packets(spark, sf, "packets")
    out, _ = run_append(stream_flow_features(stream, delay, slot_seconds=86400), "flows")
    return for_check(spark.read.parquet(out))


def q_stream_flow_summary(spark, sf):
    """ST2 + ST3: the sessions of the same stream."""
    from packetlens.streaming.flows import stream_flow_summary
    from packetlens.streaming.jobs import run_append
    stream, delay = _shuffled_packets(spark, sf, "sessions")
    out, _ = run_append(stream_flow_summary(stream, STREAM_IDLE_S, delay, slot_seconds=86400), "flow-summary")
    return for_check(spark.read.parquet(out))


def q_flow_sessions(spark, sf):
    """The batch twin of the streaming sessions."""
    return for_check(flow_sessions(_packets(spark, sf), STREAM_IDLE_S))


def q_session_facts(spark, sf):
    return for_check(session_facts(_packets(spark, sf), STREAM_IDLE_S))


def q_stream_sessions(spark, sf):
    """ST2 by ``session_window``: closed sessions of the shuffled stream."""
    from packetlens.streaming.jobs import run_append
    stream, delay = _shuffled_packets(spark, sf, "windows")
    out, _ = run_append(stream_sessions(stream, STREAM_IDLE_S, delay), "sessions")
    return for_check(spark.read.parquet(out))


def q_stream_late(spark, sf):
    """ST8: every tenth packet comes after all others; those behind the watermark are
    routed aside, and kept and late ones add up to the input. The stream runs to the end of each
    landing and goes on from its checkpoint with the next: a landing may have any number of files."""
    from packetlens.streaming.flows import track_flows
    from packetlens.streaming.jobs import land_flush, read_stream, run_append
    packets, path = _packets(spark, sf), scratch_path(spark, "landing-late")
    held, base = F.col("packet_id") % 10 == 0, scratch_path(spark, "sink-late")

    def run() -> str:
        stream = read_stream(spark, path, packets.schema)
        return run_append(track_flows(stream, ("kept",), delay_seconds=7 * 86400, slot_seconds=86400), "late", base=base)[0]
    for part in (packets.where(~held), packets.where(held)):
        part.write.mode("append").parquet(path)
        run()
    land_flush(spark, path, packets.agg(F.max("ts")).first()[0] + timedelta(days=60))
    out = run()
    rows = spark.read.parquet(out).where("packet_id >= 0")
    return rows.groupBy(F.col("kind").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("packet_id").alias("id_sum"))


def q_stream_detect(spark, sf):
    """ST1, M7, R5, R1, ST5, ST7, ST8: the live job over the shuffled packets with a saved model."""
    from packetlens.streaming.jobs import stream_detect
    packets = _packets(spark, sf)
    path = scratch_path(spark, "detector")
    flows = write_once(typed_flows(packets, EVENT_DDOS_RATE, EVENT_SCAN_RATE), "detect-flows")
    M.save_hybrid(fit_detector(flows, **_SMALL_TREES), path)
    stream, delay = _shuffled_packets(spark, sf, "detect")
    log, _ = stream_detect(stream, path, scratch_path(spark, "live"), delay, EVENT_DDOS_RATE, EVENT_SCAN_RATE, slot_seconds=86400)
    return log.read("verdicts").select(*_VERDICT_COLS)


class Interrupted(Exception):
    """Ends a stream in the middle, as a lost driver would."""


def q_stream_scores_resumed(spark, sf):
    """S4 + S5: a bounded stream that stops after writing a batch and before
    publishing it, and is started again from its checkpoint."""
    from packetlens.streaming.jobs import land_batches, read_stream, run_batches, stream_scores
    scored, base = _scored(spark, sf), scratch_path(spark, "resumed")
    landing, each = land_batches(scored, "resumed", STREAM_FILES)
    calls = []

    def stopping(written):
        calls.append(1)
        if len(calls) == 2:
            raise Interrupted
        return written["scores"].limit(0)

    def start():
        stream = stream_scores(read_stream(spark, landing, scored.schema, max_files=each))
        return run_batches(stream, base, lambda batch: {"scores": batch}, {"nothing": stopping})[0]
    try:
        start()
    except StreamingQueryException as e:
        if "Interrupted" not in str(e):
            raise
    return for_check(start().read("scores").select(*_LIVE_COLS, "attack_type"))


def _stream_scores(spark, sf):
    from packetlens.streaming.jobs import stream_scores
    return stream_scores(_stream_of(spark, _scored(spark, sf), "scored"), gate=True)


def q_stream_scores(spark, sf):
    from packetlens.streaming.jobs import run_append
    out, _ = run_append(_stream_scores(spark, sf), "scores")
    return for_check(spark.read.parquet(out).select(*_LIVE_COLS, "attack_type"))


def q_stream_counters(spark, sf):
    from packetlens.streaming.jobs import run_complete, stream_counters
    out, _ = run_complete(stream_counters(_stream_scores(spark, sf)), "counters")
    return for_check(out)


def q_stream_timeline(spark, sf):
    from packetlens.streaming.jobs import run_append, stream_timeline
    out, _ = run_append(stream_timeline(_stream_scores(spark, sf), "ts", "7 days", "7 days"), "timeline")
    return for_check(spark.read.parquet(out))


def q_stream_alerts(spark, sf):
    from packetlens.streaming.jobs import run_append, stream_alerts
    out, _ = run_append(stream_alerts(_stream_scores(spark, sf)), "alerts")
    newest = R.newest(spark.read.parquet(out), _ORDER, 15)
    return for_check(newest.select("ts", "port", "rate", "attack_type", "final_score", "severity"))


def q_csv_scan(spark, sf):
    """S1 -> S2 -> P6 -> P3 over a flow CSV that Spark writes from lineitem."""
    path = scratch_path(spark, "flow-csv")
    write_flow_csv(_raw_flows(spark, sf), path)
    df = C.drop_label(read_flow_csv(spark, path))
    return for_check(C.feature_projection(df, keep=_IDS))


def q_packet_quarantine(spark, sf):
    """P1 + P7: packets whose fields are broken by rules of their id, counted by
    where they end: kept, quarantined, or another protocol."""
    i = F.col("packet_id")
    p = _packets(spark, sf).withColumns({
        "pkt_len": F.when(i % 7 != 0, F.col("pkt_len")),
        "proto": F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, F.lit(1)).otherwise(F.col("proto")),
        "src_port": F.when(i % 17 == 0, F.lit(70000)).otherwise(F.col("src_port")),
        "dst_ip": F.when(i % 19 != 0, F.col("dst_ip")),
        "ip_ihl": F.when(i % 23 == 0, F.lit(16)).otherwise(F.col("ip_ihl")),
    })
    parts = {"valid": valid_packets(p), "quarantined": quarantined_packets(p),
             "other_protocol": p.where(~F.col("proto").isin(6, 17))}
    out = None
    for name, part in parts.items():
        c = part.agg(F.count(F.lit(1)).alias("n"), F.sum("packet_id").alias("id_sum")).withColumn("part", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return for_check(out)


def q_csv_quarantine(spark, sf):
    """S1 + P7: a flow CSV whose numbers are text on some rows; good and malformed
    rows are counted per label with the total of a column of the good ones."""
    path = scratch_path(spark, "flow-csv")
    rows = _raw_flows(spark, sf)
    broken = F.when((F.col("Flow ID") + F.col("line")) % 9 == 0, F.lit("n/a")).otherwise(
        F.col("Total Fwd Packets").cast("string"))
    write_flow_csv(rows.withColumn("Total Fwd Packets", broken), path)
    good, bad = split_flow_csv(read_flow_csv(spark, path))

    def count(df, part):
        return df.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.sum("Flow ID").alias("id_sum")).withColumn("part", F.lit(part))
    return for_check(count(good, "valid").unionByName(count(bad, "quarantined")))


def q_log_records(spark, sf):
    rows = score_rows(_scored(spark, sf), gate=True).withColumnRenamed("port", "dst_port")
    return for_check(R.log_records(rows))


_VERDICT_COLS = ["packet_id", "ts", "src_ip", "dst_ip", "dst_port", "proto", "dl_error", "dl_score", "ml_prob",
                 "final_score", "label", "confidence", "attack_type", "severity"]


def _detected(spark, sf):
    return detect_batch(_packets(spark, sf), EVENT_DDOS_RATE, EVENT_SCAN_RATE, **_SMALL_TREES)


def q_detect_flows(spark, sf):
    """The composed job: packets -> features -> reloaded model -> gate -> type -> severity."""
    return _detected(spark, sf).select(*_VERDICT_COLS)


def q_detect_report(spark, sf):
    return detection_report(_detected(spark, sf))


def q_detect_quality(spark, sf):
    """M14 of the composed job on conversations that its model has not seen."""
    return detection_quality(_detected(spark, sf))


def _typed(spark, sf, name):
    return write_once(typed_flows(_packets(spark, sf), EVENT_DDOS_RATE, EVENT_SCAN_RATE)
                      .withColumn("attack", (F.col("attack_type") != "Other").cast("int")), name)


def q_permutation_importance(spark, sf):
    """M15 (b) on held-out conversations."""
    flows = _typed(spark, sf, "importance-flows")
    model = M.fit_trees(flows.where(~held_out(FLOW_KEY)), list(FEATURES), "attack", **_SMALL_TREES)
    return M.permutation_importance(flows.where(held_out(FLOW_KEY)), model, "attack", "packet_id")


def q_feature_choice(spark, sf):
    """M10 + T3 on a flow table of 79 columns: the 30 names in the order that the saved and reloaded
    model scores with, and each one's importance."""
    path = scratch_path(spark, "chosen")
    chosen = fit_chosen(write_once(wide_flows(_typed(spark, sf, "wide-flows")), "wide-flows"), path, forest={"num_trees": 20}, **_SMALL_TREES)
    names = M.load_hybrid(spark, path).anomaly.features
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature"))
    return chosen.select(at.cast("int").alias("position"), "feature", "importance")


def _csv(spark, sf):
    path = scratch_path(spark, "flow-csv")
    write_flow_csv(_raw_flows(spark, sf), path)
    return csv_flows(spark, path, _IDS)


def q_csv_verdicts(spark, sf):
    """From a flow CSV to written verdicts of the whole batch; the
    models are fitted on four fifths of the flows."""
    flows = write_once(_csv(spark, sf).withColumn("attack", (F.col("Label") == "DDoS").cast("int")), "csv-flows")
    train = flows.where(~held_out(["Flow ID"])).withColumn("benign", F.col("attack") == 0)
    model = M.fit_hybrid(train, list(FEATURES), "attack", "benign", quantile=None, **_SMALL_TREES)
    path = scratch_path(spark, "csv-verdicts")
    write_scores(batch_verdicts(flows.drop("attack"), model, _IDS), path)
    return spark.read.parquet(path)


def q_csv_head(spark, sf):
    """The first ten rows of a flow CSV, in an explicit order."""
    rows = C.drop_label(_csv(spark, sf))
    return for_check(C.head(rows, 10, [*_IDS, *FEATURES]))


def q_threshold_file(spark, sf):
    """The calibrated threshold is written as JSON, read back and applied."""
    errors = write_once(_centroid_errors(spark, sf).select("benign", "dl_error"), "threshold-errors")
    path = scratch_path(spark, "threshold-json")
    write_threshold(spark, path, S.calibrate_threshold(errors, "dl_error", 0.9, benign="benign").first()["threshold"])
    threshold = read_threshold(spark, path)
    scored = errors.withColumn("dl_score", dl_score("dl_error", threshold))
    return for_check(scored.groupBy("benign").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("dl_score") >= 1).cast("long")).alias("n_above")).withColumn("threshold", F.lit(threshold)))


def q_dense_error(spark, sf):
    """M2 as a dense autoencoder, trained on the benign flows, saved and reloaded."""
    flows = write_once(_clean_flows(spark, sf).withColumn("benign", F.col("Label") == "BENIGN"), "dense-flows")
    path = scratch_path(spark, "dense-model")
    fit_dense(flows, list(FEATURES), "benign", steps=20).save(spark, path)
    return load_dense(spark, path).errors(flows).select(*[F.col(fcol(c)) for c in _IDS], "Label", "dl_error")


QUERIES = {
    "flow_features": q_flow_features,
    "flow_features_bucketed": q_flow_features_bucketed,
    "flow_summary": q_flow_summary,
    "attack_breakdown": q_attack_breakdown,
    "attack_type": q_attack_type,
    "rule_label": q_rule_label,
    "ensemble_live": q_ensemble_live,
    "live_gate": q_live_gate,
    "ensemble_batch": q_ensemble_batch,
    "score_bands": q_score_bands,
    "session_counters": q_session_counters,
    "attack_only_breakdown": q_attack_only_breakdown,
    "timeline": q_timeline,
    "recent_logs": q_recent_logs,
    "recent_alerts": q_recent_alerts,
    "port_class_join": q_port_class_join,
    "feed_union": q_feed_union,
    "feature_projection": q_feature_projection,
    "impute_zero": q_impute_zero,
    "drop_nonfinite": q_drop_nonfinite,
    "standardise": q_standardise,
    "threshold_p90": q_threshold_p90,
    "error_share_topk": q_error_share_topk,
    "eval_metrics": q_eval_metrics,
    "moving_mean_50": q_moving_mean_50,
    "moving_mean_50_blocked": q_moving_mean_50_blocked,
    "moving_mean_50_global": q_moving_mean_50_global,
    "keep_last_200": q_keep_last_200,
    "pca_error": q_pca_error,
    "tree_prob": q_tree_prob,
    "rf_select": q_rf_select,
    "hybrid_live": q_hybrid_live,
    "hybrid_batch": q_hybrid_batch,
    "tree_only": q_tree_only,
    "model_quality": q_model_quality,
    "csv_scan": q_csv_scan,
    "csv_quarantine": q_csv_quarantine,
    "packet_quarantine": q_packet_quarantine,
    "log_records": q_log_records,
    "detect_flows": q_detect_flows,
    "detect_report": q_detect_report,
    "detect_quality": q_detect_quality,
    "permutation_importance": q_permutation_importance,
    "feature_choice": q_feature_choice,
    "csv_verdicts": q_csv_verdicts,
    "csv_head": q_csv_head,
    "threshold_file": q_threshold_file,
    "dense_error": q_dense_error,
    "stream_flow_features": q_stream_flow_features,
    "stream_flow_summary": q_stream_flow_summary,
    "flow_sessions": q_flow_sessions,
    "session_facts": q_session_facts,
    "stream_sessions": q_stream_sessions,
    "stream_late": q_stream_late,
    "stream_detect": q_stream_detect,
    "stream_scores": q_stream_scores,
    "stream_scores_resumed": q_stream_scores_resumed,
    "stream_counters": q_stream_counters,
    "stream_timeline": q_stream_timeline,
    "stream_alerts": q_stream_alerts,
}
