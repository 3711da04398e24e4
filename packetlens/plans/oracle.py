"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark operators from the documented semantics.
Doubles are rounded to 6 digits (``+ 0.0`` clears negative zero) to match
``for_check`` on the Spark side.
"""

from __future__ import annotations

from packetlens.schemas import FEATURES


COARSE: dict[str, int] = {}


def rnd(expr: str, digits: int = 6) -> str:
    """Round through DECIMAL(38,9) (half up on the decimal value), as the Spark side does."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN isfinite({x}) THEN CAST(round(CAST({x} AS DECIMAL(38, 9)), {digits}) AS DOUBLE) + 0.0 "
            f"ELSE {x} END")


def r6(expr: str, name: str) -> str:
    return f'{rnd(expr, COARSE.get(name, 6))} AS "{name}"'


PACKETS = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS svc
  FROM events),
pk0 AS (
  SELECT event_id AS packet_id, ts,
         (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS ts_s,
         (event_type IN ('view', 'click') AND event_id % 3 = 0) AS is_reply,
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS cip,
         CAST(40000 + user_id % 20000 AS INTEGER) AS cport,
         '192.168.0.' || CAST(svc AS VARCHAR) AS sip,
         CAST([80, 443, 22, 3306, 53, 3389, 8080, 5432][svc + 1] AS INTEGER) AS sport,
         CAST(CASE WHEN svc = 4 THEN 17 ELSE 6 END AS INTEGER) AS proto,
         CAST(40 + CAST(floor(value * 3) AS INTEGER) AS INTEGER) AS pkt_len,
         5 AS ip_ihl,
         CASE WHEN svc = 4 THEN NULL ELSE 5 + event_id % 4 END AS tcp_dataofs,
         CAST((event_id * 7919) % 65536 AS INTEGER) AS tcp_window
  FROM ev),
packets AS (
  SELECT packet_id, ts, ts_s,
         CASE WHEN is_reply THEN sip ELSE cip END AS src_ip,
         CASE WHEN is_reply THEN cip ELSE sip END AS dst_ip,
         CASE WHEN is_reply THEN sport ELSE cport END AS src_port,
         CASE WHEN is_reply THEN cport ELSE sport END AS dst_port,
         proto, pkt_len, ip_ihl, tcp_dataofs, tcp_window
  FROM pk0)"""

# Flow features: F = initiator packets before the first reply, B = responder packets.
FLOWS = PACKETS + """,
c AS (
  SELECT *,
         least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS ka,
         greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS kb,
         (src_ip || ':' || src_port) = least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS from_a,
         epoch_us(ts) AS ts_us,
         ip_ihl * 4 + CASE WHEN proto = 6 THEN coalesce(tcp_dataofs * 4, 20) ELSE 8 END AS hdr
  FROM packets
  WHERE proto IN (6, 17) AND NOT (src_ip = dst_ip AND src_port = dst_port)),
r1 AS (SELECT *, (first_value(from_a) OVER w) = from_a AS is_init FROM c
       WINDOW w AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r2 AS (SELECT *, max(CASE WHEN is_init THEN 0 ELSE 1 END) OVER w > 0 AS seen_reply FROM r1
       WINDOW w AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r3 AS (SELECT *, is_init AND NOT seen_reply AS isF, NOT is_init AS isB,
              (is_init AND NOT seen_reply) OR NOT is_init AS isFB FROM r2),
r4 AS (SELECT *,
         CASE WHEN isF THEN ts_us - last_value(CASE WHEN isF THEN ts_us END IGNORE NULLS) OVER wb END AS iatF,
         CASE WHEN isB THEN ts_us - last_value(CASE WHEN isB THEN ts_us END IGNORE NULLS) OVER wb END AS iatB,
         CASE WHEN isFB THEN ts_us - last_value(CASE WHEN isFB THEN ts_us END IGNORE NULLS) OVER wb END AS iatFB
       FROM r3
       WINDOW wb AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r5 AS (SELECT *,
         sum(CASE WHEN isF THEN 1 ELSE 0 END) OVER w AS nF,
         sum(CASE WHEN isB THEN 1 ELSE 0 END) OVER w AS nB,
         sum(CASE WHEN isF THEN pkt_len END) OVER w AS sumF,
         max(CASE WHEN isF THEN pkt_len END) OVER w AS maxF,
         avg(CASE WHEN isF THEN pkt_len END) OVER w AS avgF,
         stddev_pop(CASE WHEN isF THEN pkt_len END) OVER w AS stdF,
         max(CASE WHEN isB THEN pkt_len END) OVER w AS maxB,
         min(CASE WHEN isB THEN pkt_len END) OVER w AS minB,
         avg(CASE WHEN isB THEN pkt_len END) OVER w AS avgB,
         min(CASE WHEN isFB THEN pkt_len END) OVER w AS minFB,
         avg(CASE WHEN isFB THEN pkt_len END) OVER w AS avgFB,
         sum(iatF) OVER w AS iatF_sum, count(iatF) OVER w AS iatF_n,
         stddev_pop(iatF) OVER w AS iatF_std, max(iatF) OVER w AS iatF_max,
         sum(iatB) OVER w AS iatB_sum, count(iatB) OVER w AS iatB_n, stddev_pop(iatFB) OVER w AS iatFB_std,
         first_value(ts_us) OVER w AS start_us,
         list(CASE WHEN isF THEN pkt_len END) OVER w AS lensF
       FROM r4
       WINDOW w AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ff AS (
  SELECT ka, kb, packet_id, ts, src_ip, dst_ip, src_port, dst_port, proto, pkt_len,
    dst_port AS "Destination Port", nF AS "Total Fwd Packets", sumF AS "Total Length of Fwd Packets",
    maxF AS "Fwd Packet Length Max", avgF AS "Fwd Packet Length Mean",
    coalesce(stdF, 0) AS "Fwd Packet Length Std", coalesce(maxB, 0) AS "Bwd Packet Length Max",
    coalesce(minB, 0) AS "Bwd Packet Length Min", coalesce(avgB, 0) AS "Bwd Packet Length Mean",
    coalesce(minFB, 0) AS "Min Packet Length", coalesce(avgFB, 0) AS "Packet Length Mean",
    nF / greatest((ts_us - start_us) / 1000000.0::DOUBLE, 0.5::DOUBLE) AS "Fwd Packets/s",
    hdr AS "Fwd Header Length", hdr AS "Fwd Header Length.1",
    coalesce(CAST(iatF_sum AS DOUBLE) / 1000000.0::DOUBLE, 0) AS "Fwd IAT Total",
    coalesce(CAST(iatF_sum AS DOUBLE) / iatF_n / 1000000.0::DOUBLE, 0) AS "Fwd IAT Mean",
    coalesce(iatF_std / 1000000.0::DOUBLE, 0) AS "Fwd IAT Std",
    coalesce(CAST(iatF_max AS DOUBLE) / 1000000.0::DOUBLE, 0) AS "Fwd IAT Max",
    coalesce(CAST(iatB_sum AS DOUBLE) / iatB_n / 1000000.0::DOUBLE, 0) AS "Bwd IAT Mean",
    coalesce(iatFB_std / 1000000.0::DOUBLE, 0) AS "Flow IAT Std",
    coalesce(avgFB, 0) AS "Average Packet Size", avgF AS "Avg Fwd Segment Size",
    coalesce(avgB, 0) AS "Avg Bwd Segment Size", nF AS "Subflow Fwd Packets",
    sumF AS "Subflow Fwd Bytes", nB AS "Subflow Bwd Packets",
    nB / greatest(nF, 1)::DOUBLE AS "Down/Up Ratio",
    CASE WHEN proto = 6 THEN tcp_window ELSE 0 END AS "Init_Win_bytes_forward",
    0 AS "Init_Win_bytes_backward",
    len(list_filter(lensF, lambda x: x > hdr)) AS "act_data_pkt_fwd"
  FROM r5 WHERE is_init AND nF >= 2)"""

FEATURE_SELECT = ", ".join(r6(f'"{n}"', n) for n in FEATURES)

SCORED = """
sc AS (
  SELECT l_extendedprice AS rate,
         CAST([22, 23, 21, 3389, 5900, 3306, 5432, 1433, 1521, 80, 443, 53][l_partkey % 12 + 1] AS INTEGER) AS port,
         l_discount * 5 + 0.0::DOUBLE AS dl_error,
         l_tax * 12.5::DOUBLE + 0.0::DOUBLE AS ml_prob,
         l_shipdate AS ts
  FROM lineitem)"""


def attack_type_sql(port: str, rate: str, ddos: str = "40000.0", scan: str = "4000.0") -> str:
    return (f"CASE WHEN coalesce(CAST({rate} AS DOUBLE), 0) > {ddos}::DOUBLE THEN 'DDoS' "
            f"WHEN coalesce(CAST(trunc({port}) AS BIGINT), 0) IN (22, 23, 21, 3389, 5900) THEN 'BruteForce' "
            f"WHEN coalesce(CAST(trunc({port}) AS BIGINT), 0) IN (3306, 5432, 1433, 1521) THEN 'SQLInject' "
            f"WHEN coalesce(CAST({rate} AS DOUBLE), 0) > {scan}::DOUBLE THEN 'PortScan' ELSE 'Other' END")


# Live ensemble: dl = clip(err/0.5), final = clip(dl + 0.3*ml), verdict on the unrounded score.
LIVE = SCORED + """,
e1 AS (SELECT *, CASE WHEN isnan(dl_error / 0.5::DOUBLE) THEN NULL
                      ELSE least(greatest(dl_error / 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) + 0.0::DOUBLE END AS dl
       FROM sc),
e2 AS (SELECT *, least(greatest(dl + 0.3::DOUBLE * ml_prob, 0.0::DOUBLE), 1.0::DOUBLE) + 0.0::DOUBLE AS fs FROM e1),
e3 AS (SELECT *, CASE WHEN fs > 0.5::DOUBLE THEN 'ATTACK' ELSE 'NORMAL' END AS label0 FROM e2),
live AS (
  SELECT rate, port, dl_error, ts, round(dl, 4) AS dl_score, round(ml_prob, 4) AS ml_prob,
         round(fs, 4) AS final_score, label0 AS label,
         round(CASE WHEN label0 = 'ATTACK' THEN fs * 100 ELSE (1.0::DOUBLE - fs) * 100 END, 1) AS confidence,
         """ + attack_type_sql("port", "rate") + """ AS attack_type
  FROM e3),
gated AS (
  SELECT * REPLACE (CASE WHEN ml_prob >= 0.30::DOUBLE AND final_score >= 0.75::DOUBLE
                         THEN label ELSE 'NORMAL' END AS label)
  FROM live)"""

LIVE_COLS = ("rate, port, " + r6("dl_error", "dl_error") + ", " + r6("dl_score", "dl_score") + ", "
             + r6("ml_prob", "ml_prob") + ", " + r6("final_score", "final_score") + ", label, "
             + r6("confidence", "confidence"))

EVENT_DDOS, EVENT_SCAN = "0.0001", "0.00001"

SQL = {
    "flow_features": "WITH " + FLOWS + """
SELECT packet_id, CAST(ts AS TIMESTAMP) AS ts, src_ip, dst_ip, src_port, dst_port, proto, pkt_len, """
    + FEATURE_SELECT + " FROM ff",

    "attack_breakdown": "WITH " + FLOWS + """,
t AS (SELECT """ + attack_type_sql('"Destination Port"', '"Fwd Packets/s"', EVENT_DDOS, EVENT_SCAN)
    + """ AS attack_type FROM ff),
types(attack_type, type_order) AS (VALUES ('DDoS', 1), ('PortScan', 2), ('BruteForce', 3), ('SQLInject', 4), ('Other', 5)),
cnt AS (SELECT types.attack_type, types.type_order, CAST(count(t.attack_type) AS BIGINT) AS n
        FROM types LEFT JOIN t ON t.attack_type = types.attack_type
        GROUP BY types.attack_type, types.type_order)
SELECT attack_type, CAST(type_order AS INTEGER) AS type_order, n,
       """ + r6("n * 100.0::DOUBLE / greatest(sum(n) OVER (), 1)", "pct") + " FROM cnt",

    "attack_type": "WITH " + SCORED + "\nSELECT " + r6("rate", "rate") + ", port, "
    + attack_type_sql("port", "rate") + " AS attack_type FROM sc",

    "rule_label": "WITH " + SCORED + """,
f AS (SELECT rate, port,
        rate > 1000.0::DOUBLE AS is_ddos,
        port IN (22, 23, 21, 3389, 5900) AND rate > 200.0::DOUBLE AS is_bruteforce,
        port IN (3306, 5432, 1433, 1521) AND rate > 200.0::DOUBLE AS is_sqlinject FROM sc),
g AS (SELECT *, rate > 100.0::DOUBLE AND NOT is_ddos AND NOT is_bruteforce AND NOT is_sqlinject AS is_portscan FROM f)
SELECT """ + r6("rate", "rate") + """, port, is_ddos, is_bruteforce, is_sqlinject, is_portscan,
       is_ddos OR is_bruteforce OR is_sqlinject OR is_portscan AS is_attack,
       CASE WHEN is_ddos THEN 'DDoS' WHEN is_bruteforce THEN 'BruteForce' WHEN is_sqlinject THEN 'SQLInject'
            WHEN is_portscan THEN 'PortScan' ELSE 'Normal' END AS rule
FROM g""",

    "ensemble_live": "WITH " + LIVE + "\nSELECT " + LIVE_COLS + " FROM live",

    "live_gate": "WITH " + LIVE + "\nSELECT " + LIVE_COLS + " FROM gated",

    "ensemble_batch": "WITH " + SCORED + """,
ext AS (SELECT min(dl_error) AS mn, max(dl_error) AS mx FROM sc),
b AS (SELECT sc.*, CASE WHEN mx - mn = 0 THEN NULL ELSE (dl_error - mn) / (mx - mn) END AS dl FROM sc, ext),
b2 AS (SELECT *, 0.5::DOUBLE * dl + 0.5::DOUBLE * ml_prob AS fs FROM b)
SELECT """ + r6("rate", "rate") + ", port, " + r6("dl_error", "dl_error") + ", " + r6("ml_prob", "ml_prob")
    + ", " + r6("dl", "dl_score") + ", " + r6("fs", "final_score") + """,
       CASE WHEN fs > 0.5::DOUBLE THEN 'ATTACK' ELSE 'NORMAL' END AS label FROM b2""",

    "score_bands": "WITH " + LIVE + """
SELECT attack_type,
  CAST(sum(CASE WHEN label = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label <> 'ATTACK' AND final_score > 0.35::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label <> 'ATTACK' AND NOT final_score > 0.35::DOUBLE AND final_score > 0.15::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label <> 'ATTACK' AND NOT final_score > 0.35::DOUBLE AND NOT final_score > 0.15::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM live GROUP BY attack_type""",

    "session_counters": "WITH " + LIVE + """,
k AS (SELECT CAST(count(*) AS BIGINT) AS total_packets,
             CAST(sum(CASE WHEN label = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS total_attacks,
             CAST(sum(CASE WHEN label = 'ATTACK' THEN 0 ELSE 1 END) AS BIGINT) AS total_normal FROM gated)
SELECT total_packets, total_attacks, total_normal,
       """ + r6("CASE WHEN total_packets = 0 THEN 0.0 ELSE total_attacks * 100.0::DOUBLE / total_packets END",
                "attack_rate") + " FROM k",

    "timeline": "WITH " + LIVE + """,
r AS (SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS b, label = 'ATTACK' AS a FROM live),
m AS (SELECT max(b) AS mx FROM r),
spine AS (SELECT unnest(range(mx - 39 * 604800, mx + 1, 604800)) AS b FROM m)
SELECT make_timestamp(spine.b * 1000000) AS bucket_start,
       CAST(count(r.a) FILTER (WHERE r.a) AS BIGINT) AS attacks,
       CAST(count(r.a) FILTER (WHERE NOT r.a) AS BIGINT) AS normal
FROM spine LEFT JOIN r ON r.b = spine.b GROUP BY spine.b""",

    "recent_logs": "WITH " + LIVE + """
SELECT ts, port, """ + r6("rate", "rate") + ", " + r6("dl_error", "dl_error") + ", " + r6("ml_prob", "ml_prob")
    + ", " + r6("dl_score", "dl_score") + ", " + r6("final_score", "final_score") + """, label
FROM gated ORDER BY ts DESC, rate DESC, port DESC, dl_error DESC, ml_prob DESC LIMIT 60""",

    "recent_alerts": "WITH " + LIVE + """
SELECT ts, port, """ + r6("rate", "rate") + ", attack_type, " + r6("final_score", "final_score") + """,
       CASE WHEN final_score > 0.75::DOUBLE THEN 'crit' ELSE 'warn' END AS severity
FROM live WHERE label = 'ATTACK'
ORDER BY ts DESC, rate DESC, port DESC, dl_error DESC, ml_prob DESC LIMIT 15""",

    "port_class_join": "WITH " + SCORED + """
SELECT CASE WHEN port IN (22, 23, 21, 3389, 5900) THEN 'bruteforce'
            WHEN port IN (3306, 5432, 1433, 1521) THEN 'database' ELSE 'other' END AS port_class,
       CAST(count(*) AS BIGINT) AS n
FROM sc GROUP BY 1""",

    "feed_union": "WITH " + FLOWS + "," + SCORED + """
SELECT CAST(ts AS TIMESTAMP) AS ts, CAST("Destination Port" AS INTEGER) AS port, """
    + r6('"Fwd Packets/s"', "rate") + ", "
    + attack_type_sql('"Destination Port"', '"Fwd Packets/s"', EVENT_DDOS, EVENT_SCAN) + """ AS attack_type,
       'live' AS source FROM ff
UNION ALL
SELECT ts, port, """ + r6("rate", "rate") + ", " + attack_type_sql("port", "rate") + """ AS attack_type,
       'SIM' AS source FROM sc""",
}


def _ieee(num: str, den: str) -> str:
    return (f"CASE WHEN {den} <> 0 THEN {num} / {den} WHEN {num} > 0 THEN 'Infinity'::DOUBLE "
            f"WHEN {num} < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END")


RAW_FLOWS = """
raw AS (
  SELECT row_number() OVER () AS rid, l_orderkey AS "Flow ID", l_linenumber AS line,
         CAST([22, 23, 21, 3389, 5900, 3306, 5432, 1433, 1521, 80, 443, 53][l_partkey % 12 + 1] AS INTEGER)
           AS "Destination Port",
         """ + _ieee("l_quantity", "(l_discount + 0.0::DOUBLE)") + """ AS "Fwd Packets/s",
         """ + _ieee("l_tax", "(l_discount + 0.0::DOUBLE)") + """ AS "Down/Up Ratio",
         l_quantity AS "Total Fwd Packets",
         l_extendedprice AS "Total Length of Fwd Packets",
         """ + _ieee("l_extendedprice", "l_quantity") + """ AS "Fwd Packet Length Mean",
         l_linenumber AS "Init_Win_bytes_forward",
         CASE WHEN l_returnflag <> 'R' THEN l_tax * 1000 END AS "Fwd IAT Total",
         CASE WHEN l_linestatus = 'O' THEN 'BENIGN' ELSE 'DDoS' END AS "Label"
  FROM lineitem)"""

_PRESENT = ["Destination Port", "Fwd Packets/s", "Down/Up Ratio", "Total Fwd Packets",
            "Total Length of Fwd Packets", "Fwd Packet Length Mean", "Init_Win_bytes_forward",
            "Fwd IAT Total"]


def _proj_col(n: str) -> str:
    if n in _PRESENT:
        return f'coalesce(TRY_CAST("{n}" AS DOUBLE), 0.0::DOUBLE) AS "{n}"'
    return f'0.0::DOUBLE AS "{n}"'


PROJ = RAW_FLOWS + """,
proj AS (SELECT rid, "Flow ID", line, "Label", """ + ", ".join(_proj_col(n) for n in FEATURES) + """ FROM raw),
imp AS (SELECT rid, "Flow ID", line, "Label", """ + ", ".join(
    f'CASE WHEN isfinite("{n}") THEN "{n}" ELSE 0.0::DOUBLE END AS "{n}"' for n in FEATURES) + """ FROM proj)"""


def _zscores(src: str, fit: str) -> str:
    stats = ", ".join(f'avg("{n}") AS m{i}, stddev_samp("{n}") AS s{i}' for i, n in enumerate(FEATURES))
    zs = ", ".join(f'CASE WHEN s{i} IS NULL OR s{i} = 0 THEN 0.0::DOUBLE ELSE ("{n}" - m{i}) / s{i} END '
                   f'+ 0.0::DOUBLE AS "{n}"' for i, n in enumerate(FEATURES))
    return (f"st AS (SELECT {stats} FROM {fit}),\n"
            f'z AS (SELECT rid, "Flow ID", line, "Label", {zs} FROM {src}, st)')


FEATS6 = ", ".join(r6(f'"{n}"', n) for n in FEATURES)

SQL.update({
    "feature_projection": "WITH " + PROJ + '\nSELECT "Flow ID", line, ' + FEATS6 + " FROM proj",

    "impute_zero": "WITH " + PROJ + '\nSELECT "Flow ID", line, ' + FEATS6 + " FROM imp",

    "drop_nonfinite": "WITH " + PROJ + '\nSELECT "Flow ID", line, ' + FEATS6 + " FROM proj WHERE "
    + " AND ".join(f'isfinite("{n}")' for n in FEATURES),

    "standardise": "WITH " + PROJ + ",\n" + _zscores("imp", "imp") + '\nSELECT "Flow ID", line, ' + FEATS6
    + " FROM z",

    "threshold_p90": "WITH " + PROJ + ",\n" + _zscores("imp", "imp WHERE \"Label\" = 'BENIGN'") + """,
e AS (SELECT "Label", (""" + " + ".join(f'"{n}" * "{n}"' for n in FEATURES) + f""") / {float(len(FEATURES))}::DOUBLE AS err FROM z)
SELECT """ + r6("quantile_cont(err, 0.9)", "threshold") + """, CAST(count(err) AS BIGINT) AS n
FROM e WHERE "Label" = 'BENIGN'""",

    "error_share_topk": "WITH " + PROJ + ",\n" + _zscores("imp", "imp WHERE \"Label\" = 'BENIGN'") + """,
tot AS (SELECT *, (""" + " + ".join(f'"{n}" * "{n}"' for n in FEATURES) + """) AS t FROM z),
u AS (""" + "\n UNION ALL ".join(
        f"""SELECT "Flow ID", line, rid, '{n}' AS feature,
               CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE ("{n}" * "{n}") / t END AS share FROM tot"""
        for n in FEATURES) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY share DESC, feature) AS rk FROM u)
SELECT "Flow ID", line, CAST(rk AS INTEGER) AS rank, feature, """ + r6("share", "share") + """
FROM r WHERE rk <= 3""",

    "eval_metrics": """WITH p AS (
  SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS truth, CAST(d.n_chars > 2000 AS INTEGER) AS prediction,
         CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS n,
             CAST(sum(CASE WHEN truth = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN truth <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN truth <> 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN truth = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END AS prec,
                CASE WHEN tp + fn = 0 THEN NULL ELSE tp::DOUBLE / (tp + fn) END AS rec FROM c),
g AS (SELECT score, sum(truth) AS pos, sum(1 - truth) AS neg FROM p GROUP BY score),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS below FROM g),
a AS (SELECT CAST(sum(pos * (below + neg * 0.5)) AS DOUBLE) AS u, CAST(sum(pos) AS DOUBLE) AS npos,
             CAST(sum(neg) AS DOUBLE) AS nneg FROM r)
SELECT n, tp, fp, tn, fn, """ + r6("(tp + tn)::DOUBLE / n", "accuracy") + ", " + r6("prec", "precision")
    + ", " + r6("rec", "recall") + ", " + r6("CASE WHEN prec + rec = 0 THEN NULL ELSE 2 * prec * rec / (prec + rec) END", "f1")
    + ", " + r6("CASE WHEN npos = 0 OR nneg = 0 THEN NULL ELSE u / (npos * nneg) END", "auc") + " FROM m, a",

    "moving_mean_50": """SELECT event_id, user_id, """ + r6(
        "avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
        "moving_mean") + " FROM events",

    "keep_last_200": """SELECT event_id, user_id, ts, """ + r6("value", "value") + """ FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200""",
})

SQL["flow_summary"] = ("WITH " + FLOWS + """
SELECT packet_id, CAST(ts AS TIMESTAMP) AS ts, src_ip, dst_ip, src_port, dst_port, proto, pkt_len, """
                       + FEATURE_SELECT + """ FROM ff
QUALIFY row_number() OVER (PARTITION BY ka, kb, proto ORDER BY ts DESC, packet_id DESC) = 1""")

SQL["stream_flow_features"] = SQL["flow_features"]
SQL["stream_scores"] = "WITH " + LIVE + "\nSELECT " + LIVE_COLS + ", attack_type FROM gated"
SQL["stream_counters"] = "WITH " + LIVE + """
SELECT attack_type, CAST(count(*) AS BIGINT) AS total_packets,
       CAST(sum(CASE WHEN label = 'ATTACK' THEN 1 ELSE 0 END) AS BIGINT) AS total_attacks,
       CAST(sum(CASE WHEN label = 'ATTACK' THEN 0 ELSE 1 END) AS BIGINT) AS total_normal
FROM gated GROUP BY attack_type"""
SQL["stream_timeline"] = "WITH " + LIVE + """,
r AS (SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS b, label = 'ATTACK' AS a FROM gated),
wm AS (SELECT epoch(max(ts)) - 604800 AS wm FROM gated)
SELECT make_timestamp(b * 1000000) AS bucket_start,
       CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS attacks,
       CAST(sum(CASE WHEN a THEN 0 ELSE 1 END) AS BIGINT) AS normal
FROM r, wm WHERE b + 604800 <= wm GROUP BY b"""
SQL["stream_alerts"] = "WITH " + LIVE + """
SELECT ts, port, """ + r6("rate", "rate") + ", attack_type, " + r6("final_score", "final_score") + """,
       CASE WHEN final_score > 0.75::DOUBLE THEN 'crit' ELSE 'warn' END AS severity
FROM gated WHERE label = 'ATTACK'
ORDER BY ts DESC, rate DESC, port DESC, dl_error DESC, ml_prob DESC LIMIT 15"""

SQL["csv_scan"] = "WITH " + PROJ + """
SELECT CAST("Flow ID" AS DOUBLE) AS "Flow ID", CAST(line AS DOUBLE) AS line, """ + FEATS6 + " FROM proj"

SQL["flow_features_bucketed"] = SQL["flow_features"]

SQL["attack_only_breakdown"] = ("WITH " + LIVE + """,
t AS (SELECT """ + attack_type_sql("port", "rate") + """ AS attack_type FROM gated WHERE label = 'ATTACK'),
types(attack_type, type_order) AS (VALUES ('DDoS', 1), ('PortScan', 2), ('BruteForce', 3), ('SQLInject', 4), ('Other', 5)),
cnt AS (SELECT types.attack_type, types.type_order, CAST(count(t.attack_type) AS BIGINT) AS n
        FROM types LEFT JOIN t ON t.attack_type = types.attack_type
        GROUP BY types.attack_type, types.type_order)
SELECT attack_type, CAST(type_order AS INTEGER) AS type_order, n,
       """ + r6("n * 100.0::DOUBLE / greatest(sum(n) OVER (), 1)", "pct") + " FROM cnt")
SQL["moving_mean_50_blocked"] = SQL["moving_mean_50"]
SQL["moving_mean_50_global"] = "SELECT event_id, " + r6(
    "avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "moving_mean") + " FROM events"

# Sessions: a conversation that was silent for more than a day starts anew.
_SESSIONS = (FLOWS.replace("r1 AS (SELECT *, (first_value", """s0 AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w > 86400000000, false) AS opens FROM c
       WINDOW w AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id)),
s1 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS island FROM s0
       WINDOW w AS (PARTITION BY ka, kb, proto ORDER BY ts, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r1 AS (SELECT *, (first_value""").replace("AS is_init FROM c\n", "AS is_init FROM s1\n")
    .replace("PARTITION BY ka, kb, proto ORDER BY ts, packet_id\n", "PARTITION BY ka, kb, proto, island ORDER BY ts, packet_id\n")
    .replace("SELECT ka, kb, packet_id, ts,", "SELECT ka, kb, island, packet_id, ts,"))
SQL["flow_sessions"] = ("WITH " + _SESSIONS + """
SELECT packet_id, CAST(ts AS TIMESTAMP) AS ts, src_ip, dst_ip, src_port, dst_port, proto, pkt_len, """
                        + FEATURE_SELECT + """
FROM ff QUALIFY row_number() OVER (PARTITION BY ka, kb, proto, island ORDER BY ts DESC, packet_id DESC) = 1""")
SQL["stream_flow_summary"] = SQL["flow_sessions"]
SQL["stream_scores_resumed"] = SQL["stream_scores"]

# The first file's newest packet sets the watermark that the second file meets.
SQL["stream_late"] = "WITH " + PACKETS + """,
w AS (SELECT max(epoch_us(ts)) // 1000 - 7 * 86400000 AS ms FROM packets WHERE packet_id % 10 <> 0),
k AS (SELECT packet_id, CASE WHEN packet_id % 10 = 0 AND epoch_us(ts) < ms * 1000 THEN 'late' ELSE 'kept' END AS part FROM packets, w)
SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(packet_id) AS BIGINT) AS id_sum FROM k GROUP BY part"""

SQL["packet_quarantine"] = "WITH " + PACKETS + """,
b AS (
  SELECT packet_id,
         CASE WHEN packet_id % 11 = 0 THEN NULL WHEN packet_id % 13 = 0 THEN 1 ELSE proto END AS proto,
         packet_id % 7 = 0 OR packet_id % 17 = 0 OR packet_id % 19 = 0 OR packet_id % 23 = 0 AS broken
  FROM packets),
t AS (SELECT packet_id, CASE WHEN proto IS NULL OR (proto IN (6, 17) AND broken) THEN 'quarantined'
                             WHEN proto IN (6, 17) THEN 'valid' ELSE 'other_protocol' END AS part FROM b),
names(part) AS (VALUES ('valid'), ('quarantined'), ('other_protocol'))
SELECT part, CAST(count(packet_id) AS BIGINT) AS n, CAST(sum(packet_id) AS BIGINT) AS id_sum
FROM names LEFT JOIN t USING (part) GROUP BY part"""

SQL["csv_quarantine"] = """
SELECT CASE WHEN l_linestatus = 'O' THEN 'BENIGN' ELSE 'DDoS' END AS "Label",
       CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 'quarantined' ELSE 'valid' END AS part,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS DOUBLE) AS id_sum
FROM lineitem GROUP BY ALL"""

# Texts are rounded half up on the decimal value, as Spark's formatter does.
SQL["log_records"] = "WITH " + LIVE + """
SELECT strftime(ts, '%H:%M:%S') AS "Time", '?' AS "Src IP", CAST(port AS VARCHAR) AS "Dst Port", '?' AS "Proto",
       CAST(0 AS INTEGER) AS "Pkt Len",
       printf('%.1f', CAST(round(CAST(ml_prob AS DECIMAL(18, 9)) * 100, 1) AS DOUBLE)) || '%' AS "ML Prob",
       printf('%.1f', CAST(round(CAST(dl_score AS DECIMAL(18, 9)) * 100, 1) AS DOUBLE)) || '%' AS "DL Score",
       printf('%.3f', CAST(round(CAST(final_score AS DECIMAL(18, 9)), 3) AS DOUBLE)) AS "Score",
       label AS "Verdict", CASE WHEN label = 'ATTACK' THEN '⚠ ATTACK' ELSE '✓ NORMAL' END AS "Display"
FROM gated"""

_ORDER10 = ", ".join(f'"{n}" NULLS FIRST' for n in ["Flow ID", "line", *FEATURES])
SQL["csv_head"] = ("WITH " + RAW_FLOWS + """,
p AS (SELECT CAST("Flow ID" AS DOUBLE) AS "Flow ID", CAST(line AS DOUBLE) AS line, """
                   + ", ".join(f'TRY_CAST("{n}" AS DOUBLE) AS "{n}"' if n in _PRESENT else f'0.0::DOUBLE AS "{n}"' for n in FEATURES) + f""" FROM raw),
t AS (SELECT * FROM p ORDER BY {_ORDER10} LIMIT 10)
SELECT "Flow ID", line, {FEATS6} FROM t""")

SQL["threshold_file"] = (SQL["threshold_p90"].partition("SELECT " + r6("quantile_cont(err, 0.9)", "threshold"))[0].rstrip() + """,
q AS (SELECT quantile_cont(err, 0.9) AS threshold FROM e WHERE "Label" = 'BENIGN')
SELECT "Label" = 'BENIGN' AS benign, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN err >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_above,
       """ + r6("threshold", "threshold") + """
FROM e, q GROUP BY benign, threshold""")

SQL["session_facts"] = "WITH " + PACKETS + """,
c AS (SELECT *, epoch_us(ts) AS us, src_ip || ':' || src_port AS a, dst_ip || ':' || dst_port AS b FROM packets
      WHERE proto IN (6, 17) AND NOT (src_ip = dst_ip AND src_port = dst_port)),
o AS (SELECT *, CASE WHEN us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS opens FROM c
      WINDOW w AS (PARTITION BY least(a, b), greatest(a, b), proto ORDER BY ts, packet_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY least(a, b), greatest(a, b), proto ORDER BY ts, packet_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
f AS (SELECT *, first_value(a) OVER (PARTITION BY least(a, b), greatest(a, b), proto, island ORDER BY ts, packet_id) = a AS fwd FROM i)
SELECT arg_min(src_ip, (us, packet_id)) AS src_ip, arg_min(src_port, (us, packet_id)) AS src_port,
       arg_min(dst_ip, (us, packet_id)) AS dst_ip, arg_min(dst_port, (us, packet_id)) AS dst_port, proto,
       CAST(min(ts) AS TIMESTAMP) AS "start", CAST(max(ts) AS TIMESTAMP) AS "end",
       CAST(count(*) FILTER (WHERE fwd) AS BIGINT) AS fwd_packets, CAST(count(*) FILTER (WHERE NOT fwd) AS BIGINT) AS bwd_packets,
       CAST(coalesce(sum(pkt_len) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_bytes,
       CAST(coalesce(sum(pkt_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bwd_bytes, min(pkt_len) AS shortest, max(pkt_len) AS longest
FROM f GROUP BY least(a, b), greatest(a, b), proto, island"""
# the closing marker is a session of its own, never followed and so never closed
SQL["stream_sessions"] = SQL["session_facts"]
