"""Scalar column expressions: header length, rules, thresholds, clip, rounding.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "BRUTEFORCE_PORTS", "SQLINJECT_PORTS", "DDOS_RATE", "PORTSCAN_RATE",
    "header_len", "proto_name", "attack_type", "rule_flags", "verdict",
    "confidence", "gate_label", "severity", "clip01", "round_score",
    "dl_score", "ensemble_live_score", "is_finite", "ieee_divide",
    "verdict_display", "pct_text", "score_text", "clock_text", "col_or",
    "thousands", "day_text", "short_name", "is_tcp_text", "merge_counts",
]

# Ports that identify an attack type.
BRUTEFORCE_PORTS = [22, 23, 21, 3389, 5900]
SQLINJECT_PORTS = [3306, 5432, 1433, 1521]
# Rate edges of the attack-type classifier (strict '>').
DDOS_RATE = 40_000.0
PORTSCAN_RATE = 4_000.0
# Slider-scale edges of the rule labeller.
RULE_DDOS_RATE = 1000.0
RULE_PORT_RATE = 200.0
RULE_SCAN_RATE = 100.0
# Scoring constants.
THRESHOLD = 0.5          # anomaly threshold: scale of the error
DECISION = 0.5           # decision edge of the final score
ML_WEIGHT = 0.3          # additive weight of the tree probability
ML_GATE = 0.30           # live gate: minimum tree probability
SCORE_GATE = 0.75        # live gate: minimum final score
BAND_FN = 0.35           # score bands of NORMAL rows
BAND_FP = 0.15
ALERT_CRIT = 0.75


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def col_or(c, default) -> Column:
    """``dict.get(k, default)`` on a column: null -> default."""
    return F.coalesce(_c(c), F.lit(default))


def header_len(ip_ihl="ip_ihl", tcp_dataofs="tcp_dataofs", proto="proto") -> Column:
    """IP header (ihl*4, default 20) + TCP header (dataofs*4, default 20) or UDP 8."""
    ip = F.coalesce(_c(ip_ihl) * 4, F.lit(20))
    l4 = F.when(_c(proto) == 6, F.coalesce(_c(tcp_dataofs) * 4, F.lit(20))).otherwise(F.lit(8))
    return (ip + l4).cast("int")


def proto_name(proto="proto") -> Column:
    return (F.when(_c(proto) == 6, "TCP").when(_c(proto) == 17, "UDP").otherwise("OTHER"))


def attack_type(port="port", rate="rate", ddos_rate: float = DDOS_RATE,
                scan_rate: float = PORTSCAN_RATE) -> Column:
    """Ordered rule: DDoS > BruteForce port > SQLInject port > PortScan > Other.

    The port is truncated to an integer, a missing port or rate counts as 0.
    """
    p = F.coalesce(_c(port).cast("bigint"), F.lit(0))
    r = F.coalesce(_c(rate).cast("double"), F.lit(0.0))
    return (F.when(r > ddos_rate, "DDoS")
            .when(p.isin(BRUTEFORCE_PORTS), "BruteForce")
            .when(p.isin(SQLINJECT_PORTS), "SQLInject")
            .when(r > scan_rate, "PortScan")
            .otherwise("Other"))


def rule_flags(rate="rate", port="port", ddos_rate: float = RULE_DDOS_RATE,
               port_rate: float = RULE_PORT_RATE, scan_rate: float = RULE_SCAN_RATE) -> dict:
    """Weak labels of the what-if rules; ddos and brute/sql may both be true."""
    r, p = _c(rate), _c(port)
    ddos = r > ddos_rate
    brute = p.isin(BRUTEFORCE_PORTS) & (r > port_rate)
    sql = p.isin(SQLINJECT_PORTS) & (r > port_rate)
    scan = (r > scan_rate) & ~ddos & ~brute & ~sql
    rule = (F.when(ddos, "DDoS").when(brute, "BruteForce").when(sql, "SQLInject")
            .when(scan, "PortScan").otherwise("Normal"))
    return {"is_ddos": ddos, "is_bruteforce": brute, "is_sqlinject": sql,
            "is_portscan": scan, "is_attack": ddos | brute | sql | scan, "rule": rule}


def clip01(x) -> Column:
    """np.clip(x, 0, 1); NaN/null stay null, -0.0 becomes 0.0."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) + F.lit(0.0))


def round_score(x, digits: int = 4) -> Column:
    return F.round(_c(x), digits)


def dl_score(err="dl_error", threshold: float = THRESHOLD) -> Column:
    """clip(err / threshold, 0, 1): an error at the threshold scores 1.0."""
    return clip01(_c(err) / F.lit(float(threshold)))


def ensemble_live_score(dl="dl_score", ml="ml_prob", weight: float = ML_WEIGHT) -> Column:
    """Additive ensemble: clip(dl + weight*ml, 0, 1); ml alone never alerts."""
    return clip01(_c(dl) + F.lit(weight) * _c(ml))


def verdict(score="final_score", threshold: float = DECISION) -> Column:
    """ATTACK iff the unrounded score exceeds the threshold (NaN/null -> NORMAL)."""
    s = _c(score)
    return F.when(s.isNotNull() & ~F.isnan(s) & (s > F.lit(threshold)), "ATTACK").otherwise("NORMAL")


def confidence(label="label", score="final_score") -> Column:
    s = _c(score)
    return F.round(F.when(_c(label) == "ATTACK", s * 100).otherwise((F.lit(1.0) - s) * 100), 1)


def gate_label(label="label", ml="ml_prob", score="final_score",
               ml_gate: float = ML_GATE, score_gate: float = SCORE_GATE) -> Column:
    """Live gate on the rounded scores: keep ATTACK only if both gates pass."""
    ok = (_c(ml) >= F.lit(ml_gate)) & (_c(score) >= F.lit(score_gate))
    return F.when(F.coalesce(ok, F.lit(False)), _c(label)).otherwise(F.lit("NORMAL"))


def severity(score="final_score", crit: float = ALERT_CRIT) -> Column:
    return F.when(_c(score) > F.lit(crit), "crit").otherwise("warn")


def is_finite(x) -> Column:
    """Not null, not NaN, not +-inf. One reference to ``x`` (NaN compares above
    +inf in Spark), so an inlined upstream expression is not repeated."""
    return F.coalesce(F.abs(_c(x)) < F.lit(float("inf")), F.lit(False))


def ieee_divide(num, den) -> Column:
    """IEEE-754 division (x/0 -> +-inf, 0/0 -> NaN) without ANSI errors."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return (F.when(d != 0, n / d)
            .when(n > 0, F.lit(float("inf")))
            .when(n < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def verdict_display(label="label") -> Column:
    return F.when(_c(label) == "ATTACK", F.lit("⚠ ATTACK")).otherwise(F.lit("✓ NORMAL"))


def pct_text(x) -> Column:
    """``f"{x*100:.1f}%"``."""
    return F.concat(F.format_string("%.1f", F.coalesce(_c(x), F.lit(0.0)) * 100), F.lit("%"))


def score_text(x) -> Column:
    """``f"{x:.3f}"``."""
    return F.format_string("%.3f", F.coalesce(_c(x), F.lit(0.0)))


def clock_text(ts) -> Column:
    """``%H:%M:%S`` of an event time."""
    return F.date_format(_c(ts), "HH:mm:ss")


def thousands(x) -> Column:
    """``f"{n:,}"``: integer with thousands separators."""
    return F.format_number(_c(x).cast("long"), 0)


def day_text(ts) -> Column:
    """``%A %d %b %Y`` (e.g. Monday 01 Jan 2024)."""
    return F.date_format(_c(ts), "EEEE dd MMM yyyy")


def short_name(x, n: int = 18) -> Column:
    """First ``n`` characters (label prefixes such as feature names or protocol tags)."""
    return F.substring(_c(x), 1, n)


def is_tcp_text(x) -> Column:
    """``s.startswith("TCP")``."""
    return _c(x).startswith("TCP")


def merge_counts(counts, key, value) -> Column:
    """``{**counts, key: value}`` on a map column (right side wins)."""
    rest = F.map_filter(_c(counts), lambda k, v: k != _c(key))
    return F.map_concat(rest, F.create_map(_c(key), _c(value)))
