"""Score combination: additive live ensemble, min-max batch ensemble, live gate.

These take an anomaly error and a tree probability as columns, so they run
on the output of any model (see ``packetlens.operators.models``) or on given
scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.functions.columns import (
    DECISION, ML_GATE, ML_WEIGHT, SCORE_GATE, THRESHOLD, clip01, confidence, dl_score,
    ensemble_live_score, gate_label, round_score, verdict,
)


def ensemble_live(df: DataFrame, err: str = "dl_error", ml: str = "ml_prob",
                  threshold: float = THRESHOLD, weight: float = ML_WEIGHT,
                  decision: float = DECISION) -> DataFrame:
    """M3 + M5 + R3 + R4 + R8 on each row.

    dl = clip(err/threshold); final = clip(dl + weight*ml); ATTACK above
    ``decision``, which doesn't move with the error scale. The verdict and
    confidence use the unrounded final score, outputs are rounded to 4 digits.
    """
    d = df.withColumn("_dl", dl_score(err, threshold)).withColumn("_ml", F.col(ml).cast("double"))
    d = d.withColumn("_fs", ensemble_live_score("_dl", "_ml", weight))
    d = d.withColumn("label", verdict("_fs", decision))
    d = d.withColumn("confidence", confidence("label", "_fs"))
    return d.withColumns({
        "dl_score": round_score("_dl"), "ml_prob": round_score("_ml"),
        "final_score": round_score("_fs"),
    }).drop("_dl", "_ml", "_fs")


def live_gate(df: DataFrame, ml_gate: float = ML_GATE, score_gate: float = SCORE_GATE) -> DataFrame:
    """Downgrade ATTACK to NORMAL unless ml_prob >= ml_gate and final >= score_gate.

    Reads the already rounded scores; the confidence is kept as it was.
    """
    return df.withColumn("label", gate_label("label", "ml_prob", "final_score", ml_gate, score_gate))


def ensemble_batch(df: DataFrame, err: str = "dl_error", ml: str = "ml_prob",
                   decision: float = DECISION) -> DataFrame:
    """M6 + A5 + J4: dl = min-max of the error over the whole batch; 0.5*dl + 0.5*ml.

    The batch extremes are one distributed aggregate (a single row of two
    numbers) folded into the plan as literals. max == min gives a null score
    -> NORMAL.
    """
    ext = df.agg(F.min(err).alias("mn"), F.max(err).alias("mx")).first()
    mn, mx = ext["mn"], ext["mx"]
    if mn is None or mx is None or mx == mn:
        dl = F.lit(None).cast("double")
    else:
        dl = (F.col(err) - F.lit(float(mn))) / F.lit(float(mx) - float(mn))
    return (df.withColumn("dl_score", dl)
            .withColumn("final_score", F.lit(0.5) * F.col("dl_score") + F.lit(0.5) * F.col(ml))
            .withColumn("label", verdict("final_score", decision)))


__all__ = ["ensemble_live", "live_gate", "ensemble_batch", "clip01"]
