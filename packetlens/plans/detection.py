"""End-to-end detection jobs built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions.columns import DDOS_RATE, PORTSCAN_RATE, attack_type, severity
from packetlens.operators.flows import flow_features
from packetlens.operators.clean import drop_label, feature_projection, head
from packetlens.operators.models import HybridModel, fit_hybrid, load_hybrid, rank_features, save_hybrid
from packetlens.operators.reports import attack_breakdown, session_counters
from packetlens.operators.scoring import ensemble_live, live_gate
from packetlens.operators.stats import evaluate_all
from packetlens.schemas import FEATURES, fcol
from packetlens.session import scratch_path, write_once
from packetlens.sources.files import read_flow_csv, split_flow_csv

# Rate edges that the registered queries pass for the events-derived packets: their gaps are minutes, so the
# packet rates sit far below the dataset-scale edges (40,000 / 4,000). The
# ratio of the two edges is kept.
EVENT_DDOS_RATE = 1e-4
EVENT_SCAN_RATE = 1e-5


def typed_flows(packets: DataFrame, ddos_rate: float = DDOS_RATE,
                scan_rate: float = PORTSCAN_RATE) -> DataFrame:
    """P1, P2 -> FL1 -> R1: flow feature rows with their attack type."""
    return with_type(flow_features(packets), ddos_rate, scan_rate)


def with_type(flows: DataFrame, ddos_rate: float = DDOS_RATE, scan_rate: float = PORTSCAN_RATE) -> DataFrame:
    """R1 on flow feature rows."""
    return flows.withColumn("attack_type", attack_type(F.col(fcol("Destination Port")), F.col(fcol("Fwd Packets/s")),
                                                       ddos_rate, scan_rate))


def flow_attack_breakdown(packets: DataFrame, **kw) -> DataFrame:
    """Flagship: packets -> flow features -> attack type -> breakdown of all five types."""
    return attack_breakdown(typed_flows(packets, **kw), "attack_type", label=None)


def score_rows(scored: DataFrame, gate: bool = False) -> DataFrame:
    """Rows with dl_error / ml_prob -> live ensemble (-> gate) -> attack type."""
    out = ensemble_live(scored)
    if gate:
        out = live_gate(out)
    return out.withColumn("attack_type", attack_type("port", "rate"))


def held_out(columns: list[str], share: int = 5) -> Column:
    """Whether a row belongs to the part (one in ``share``) that no model is fitted on: by a
    hash of ``columns``, so that rows of one conversation stay together."""
    return F.pmod(F.xxhash64(*[F.col(fcol(c)) for c in columns], F.lit("held out")), F.lit(share)) == 0


# Initiator packets alone emit, so a flow row's endpoints are those of its conversation.
FLOW_KEY = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]


def fit_detector(flows: DataFrame, features: list[str] = FEATURES, **model_options) -> HybridModel:
    """Both models on the flow columns ``features``. ``flows`` are typed flow rows; the
    weak label of a row is its attack type (all but Other are attacks)."""
    attack = F.col("attack_type") != "Other"
    train = flows.select(*[F.col(fcol(c)) for c in features], attack.cast("int").alias("attack"),
                         (~attack).alias("benign"))
    return fit_hybrid(train, list(features), "attack", "benign", **model_options)


def detect(flows: DataFrame, model: HybridModel, gate: bool = True) -> DataFrame:
    """Typed flow rows -> P4 -> M2, M3, M4 -> M5 -> R3, R4 -> R5 -> alert severity
    (null for NORMAL rows)."""
    out = model.score_live(flows)
    if gate:
        out = live_gate(out)
    return out.withColumn("severity", F.when(F.col("label") == "ATTACK", severity("final_score")))


def detect_batch(packets: DataFrame, ddos_rate: float = DDOS_RATE, scan_rate: float = PORTSCAN_RATE,
                 model_path: str | None = None, **model_options) -> DataFrame:
    """Packets -> flow features -> saved and reloaded model -> verdicts.

    The flow rows are written once, as fitting passes over them many times. A
    model found under ``model_path`` (S6) is used as it is; without a path one
    is fitted on these flows, saved to the shared folder and loaded from there. Every
    row is scored; ``held_out`` marks those that the model has not seen.
    """
    spark = packets.sparkSession
    flows = write_once(typed_flows(packets, ddos_rate, scan_rate).withColumn("held_out", held_out(FLOW_KEY)), "detect-flows")
    if model_path is None:
        model_path = scratch_path(spark, "detector")
        save_hybrid(fit_detector(flows.where("not held_out"), **model_options), model_path)
    return detect(flows, load_hybrid(spark, model_path))


def detection_quality(verdicts: DataFrame) -> DataFrame:
    """M14 on the held-out rows of ``detect_batch``: how the anomaly score, the trees and
    the gated verdict meet the weak label (attack type other than Other)."""
    scored = verdicts.where("held_out").withColumn("truth", (F.col("attack_type") != "Other").cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), hit.cast("int").alias("prediction"), F.col(score).alias("score"))
                               for name, hit, score in (("anomaly", F.col("dl_score") >= 1.0, "dl_error"), ("trees", F.col("ml_prob") > 0.5, "ml_prob"),
                                                        ("verdict", F.col("label") == "ATTACK", "final_score"))]))
    return evaluate_all(scored.select("truth", each.alias("x")).select("truth", "x.*"))


def wide_flows(flows: DataFrame) -> DataFrame:
    """A flow table of 79 numeric columns: the 30 features, their logarithms, and 19 of them
    per forward packet (by rule: the first 19 in model order that aren't that count)."""
    logs = {f"log {c}": F.signum(F.col(fcol(c))) * F.log1p(F.abs(F.col(fcol(c)))) for c in FEATURES}
    packets = F.greatest(F.col(fcol("Total Fwd Packets")), F.lit(1.0))
    per = {f"{c} per packet": F.col(fcol(c)) / packets for c in [c for c in FEATURES if c != "Total Fwd Packets"][:19]}
    return flows.withColumns({**logs, **per})


WIDE = [*FEATURES, *[f"log {c}" for c in FEATURES], *[f"{c} per packet" for c in [c for c in FEATURES if c != "Total Fwd Packets"][:19]]]


def choose_features(flows: DataFrame, candidates: list[str] = WIDE, top: int = 30, **forest) -> DataFrame:
    """M10 on flow columns: ``feature, importance``, the ``top`` most important of the candidates
    for the weak label, by a random forest on the rows that aren't held out."""
    train = flows.where(~held_out(FLOW_KEY)).withColumn("attack", (F.col("attack_type") != "Other").cast("int"))
    return rank_features(train, list(candidates), "attack", top=top, **forest)


def fit_chosen(flows: DataFrame, path: str, top: int = 30, forest: dict | None = None, **model_options) -> DataFrame:
    """M10 as a saved stage: choose the features, fit the detector on them and save it under
    ``path``. The saved names and their order are what later scoring uses. Returns the choice."""
    chosen = choose_features(flows, top=top, **(forest or {}))
    names = [r.feature for r in chosen.collect()]     # ``top`` names
    save_hybrid(fit_detector(flows.where(~held_out(FLOW_KEY)), names, **model_options), path)
    return chosen


def csv_flows(spark: SparkSession, path: str, ids: list[str], label: str = "Label") -> DataFrame:
    """The well-formed rows of a labelled flow CSV with ``ids``, the 30 features
    (nulls stay) and the label."""
    good, _ = split_flow_csv(read_flow_csv(spark, path, label=label))
    return feature_projection(good, keep=[*ids, label], fill_nulls=False)


def batch_verdicts(flows: DataFrame, model: HybridModel, ids: list[str], sample: int | None = None, label: str = "Label") -> DataFrame:
    """Drop the label, take the first ``sample`` rows by ``ids`` if given, drop rows with
    non-finite features, and score the rest as one batch. Row ids stay beside the verdicts."""
    rows = drop_label(flows, label)
    if sample:
        rows = head(rows, sample, [*ids, *FEATURES])
    return model.score_batch(rows).select(*[F.col(fcol(c)) for c in ids], "dl_error", "ml_prob", "dl_score", "final_score", "label")


def detection_report(verdicts: DataFrame) -> DataFrame:
    """Counters (A1, A3) and the breakdown of ATTACK rows (A4) as
    ``section, name, value`` rows; one row of counters and five types."""
    counters = session_counters(verdicts).select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in ("total_packets", "total_attacks", "total_normal", "attack_rate")]),
        F.array(*[F.col(c).cast("double") for c in ("total_packets", "total_attacks", "total_normal", "attack_rate")])))
        .alias("name", "value")).select(F.lit("counter").alias("section"), "name", "value")
    types = attack_breakdown(verdicts, "attack_type", label="label").select(
        F.lit("attack_type").alias("section"), F.col("attack_type").alias("name"), F.col("n").cast("double").alias("value"))
    return counters.unionByName(types)
