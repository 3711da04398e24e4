"""Per-flow running statistics (the 30 model features) as Spark window jobs.

Reading the packet tracker as a state machine gives these semantics (mode
``compat``): the first packet of a conversation fixes the *initiator*; the
forward set F is the initiator's packets before the first reply; the
backward set B is every responder packet so far; a row is emitted on each
initiator packet once |F| >= 2 (also after the reply: F is then frozen).
Responder packets never emit, and an endpoint talking to itself never does.

A conversation is the unordered endpoint pair plus protocol, so one hash
exchange on that key feeds every window below (they share partitioning and
ordering, Catalyst stacks them on one sort). The direction of a packet is a
flag relative to the canonical order, which replaces a self-join of the
5-tuple with its reversal.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.functions.columns import header_len
from packetlens.schemas import FEATURES, fcol
from packetlens.session import write_once

CONV = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
ORDER = ["ts", "packet_id"]
# Header lengths are ihl*4 + dataofs*4 (or + 8): multiples of 4 in [0, 120].
MAX_HDR_LEVEL = 30
MIN_DURATION_S = 0.5
US = 1e6
KEEP = ["packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "pkt_len"]


def valid_packets(packets: DataFrame) -> DataFrame:
    """P1 + P7: keep TCP/UDP rows with well-formed fields."""
    return packets.where(F.col("proto").isin(6, 17)).where(_valid_expr())


def quarantined_packets(packets: DataFrame) -> DataFrame:
    """The complement of ``valid_packets`` among TCP/UDP rows and rows without
    a protocol, with the reason (other protocols are P1's filter)."""
    ok = F.coalesce(F.col("proto").isin(6, 17) & _valid_expr(), F.lit(False))
    return packets.where(F.coalesce(F.col("proto").isin(6, 17), F.lit(True)) & ~ok).withColumn("reason", F.lit("malformed"))


def _valid_expr() -> Column:
    """Well-formed packet: identity, endpoints, length and time present, ports 16-bit,
    ihl / dataofs 4-bit (so header lengths are multiples of 4 up to 120).

    Each column is referenced once: Catalyst inlines the source projection
    into this filter, and repeated references would multiply its cost.
    """
    ports16 = F.shiftright(F.col("src_port").bitwiseOR(F.col("dst_port")), 16) == 0
    nibbles = (F.coalesce(F.col("ip_ihl"), F.lit(0)).bitwiseOR(F.coalesce(F.col("tcp_dataofs"), F.lit(0)))
               .bitwiseAND(F.lit(~15)) == 0)
    present = [F.col(c).isNotNull() for c in ("src_ip", "dst_ip", "ts", "packet_id", "pkt_len")]
    return reduce(and_, present, ports16 & nibbles)


def with_conversation(packets: DataFrame) -> DataFrame:
    """FL3: canonical conversation key and the packet's direction flag."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    end = lambda c, low: F.when(F.col("_up") == low, F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}"))
    # the ends are compared once a row: every reference to a comparison would be one more
    return packets.withColumn("_up", src <= dst).withColumns({
        "lo_ip": end("ip", True), "lo_port": end("port", True), "hi_ip": end("ip", False), "hi_port": end("port", False),
    }).withColumns({
        "from_lo": (F.col("src_ip") == F.col("lo_ip")) & (F.col("src_port") == F.col("lo_port")),
        "self_talk": (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port")),
    }).drop("_up")


def extent(packets: DataFrame) -> tuple[int, list[int]]:
    """The number of packets and the header levels (length / 4) that occur, at most 31: one narrow
    pass. Running counts of longer packets are kept for these levels alone."""
    level = (header_len() / 4).cast("int")
    n, mask = packets.select(F.when(level.between(0, MAX_HDR_LEVEL), level).alias("_level")).agg(
        F.count(F.lit(1)), F.bit_or(F.expr("shiftleft(1, _level)"))).first()
    return n, [m for m in range(MAX_HDR_LEVEL + 1) if (mask or 0) >> m & 1]


def _at_level(hdr: str, counts: dict[int, Column]) -> Column:
    """The count of ``hdr``'s level."""
    level = (F.col(hdr) / 4).cast("int")
    return F.coalesce(*[F.when(level == m, c) for m, c in counts.items()], F.lit(0))


def _prepared(packets: DataFrame) -> DataFrame:
    return (with_conversation(valid_packets(packets))
            .where(~F.col("self_talk"))
            .withColumns({"hdr": header_len(), "ts_us": F.unix_micros("ts")}))


def _roles(df: DataFrame, w_run) -> DataFrame:
    """Initiator flag, forward set F (before the first reply) and backward set B."""
    df = df.withColumn("is_init", F.first("from_lo").over(w_run) == F.col("from_lo"))
    df = df.withColumn("seen_reply", F.max((~F.col("is_init")).cast("int")).over(w_run) > 0)
    return df.withColumns({
        "isF": F.col("is_init") & ~F.col("seen_reply"),
        "isB": ~F.col("is_init"),
    }).withColumn("isFB", F.col("isF") | F.col("isB"))


HOT_ROWS = 2_000_000
BUCKET_SECONDS = 60
# A side is broadcast only if a count shows at most so many rows.
BROADCAST_ROWS = 500_000


def hot_conversations(packets: DataFrame, hot_rows: int = HOT_ROWS,
                      target_rows: int = HOT_ROWS // 4) -> DataFrame:
    """Conversations with more than ``hot_rows`` packets (partial aggregate).

    At most total_rows / hot_rows keys, so the result is safe to broadcast.
    ``bucket_us`` sizes each hot conversation's time buckets to hold about
    ``target_rows`` packets at its average rate.
    """
    span = F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts")) + 1
    return (with_conversation(valid_packets(packets)).groupBy(*CONV)
            .agg(F.count(F.lit(1)).alias("n"), span.alias("span"))
            .where(F.col("n") > hot_rows)
            .select(*CONV, F.greatest(F.lit(1), F.ceil(F.col("span") * target_rows / F.col("n")))
                    .cast("long").alias("bucket_us")))


def flow_features(packets: DataFrame, mode: str = "compat", strategy: str = "auto",
                  hot_rows: int = HOT_ROWS, bucket_seconds: int = BUCKET_SECONDS,
                  min_duration: float = MIN_DURATION_S, target_rows: int | None = None) -> DataFrame:
    """FL1: one row per emitted initiator packet with the 30 features.

    Input: PACKET rows. Output: packet identity columns + FEATURES (double).

    strategy ``window``: running windows per conversation (one exchange).
    ``bucketed``: prefix scan over (conversation, time bucket), skew-safe.
    ``auto`` (default): conversations above ``hot_rows`` packets take the
    bucketed path with buckets sized to about ``target_rows`` packets each
    (default hot_rows / 4), the rest the window path; both give identical rows.
    """
    if mode != "compat":
        raise ValueError(f"unknown mode {mode!r}; only 'compat' is defined")
    if strategy == "window":
        return _flow_features_window(packets, min_duration, extent(packets)[1])
    if strategy == "bucketed":
        return flow_features_bucketed(packets, bucket_seconds, min_duration)
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    n, levels = extent(packets)
    cold, hot = split_hot(packets, hot_rows, target_rows or max(1, hot_rows // 4), n)
    if hot is None:
        return _flow_features_window(cold, min_duration, levels)
    return (_flow_features_window(cold, min_duration, levels)
            .unionByName(flow_features_bucketed(hot, bucket_seconds, min_duration,
                                                bucket_col="bucket_us", hot_rows=0)))


def split_hot(packets: DataFrame, hot_rows: int, target_rows: int, n: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Packets of conversations up to ``hot_rows`` packets, and those of the others
    with ``bucket_us`` (None: there are no others).

    A table of at most ``hot_rows`` rows (``n``, counted if not given) has no others. Else the conversations are counted in
    one narrow pass. Their keys are few (rows / ``hot_rows`` at most) and written once to the
    shared checkpoint folder, so that the test and the two joins don't recompute them.
    """
    from packetlens.session import checkpoint_dir
    if (packets.count() if n is None else n) <= hot_rows:
        return packets, None
    checkpoint_dir(packets.sparkSession)
    keys = hot_conversations(packets, hot_rows, target_rows).checkpoint(eager=True)
    if keys.isEmpty():
        return packets, None
    keyed, few = with_conversation(packets), F.broadcast(keys)
    return (keyed.join(few.select(*CONV), CONV, "left_anti").select(*packets.columns),
            keyed.join(few, CONV, "inner").select(*packets.columns, "bucket_us"))


def _flow_features_window(packets: DataFrame, min_duration: float, levels: list[int]) -> DataFrame:
    return _window_features(_prepared(packets), CONV, min_duration, levels=levels)


def flow_sessions(packets: DataFrame, idle_seconds: float, min_duration: float = MIN_DURATION_S) -> DataFrame:
    """ST2's batch twin: the 30 features once per session, at its last emission.

    A conversation that was silent for more than ``idle_seconds`` starts anew: its
    packets are numbered by islands between such gaps, and an island is treated
    like a conversation. Sessions that never emit have no row.
    """
    return _last_emissions(_with_islands(_prepared(packets), idle_seconds), [*CONV, "session"], min_duration)


def _with_islands(p: DataFrame, idle_seconds: float) -> DataFrame:
    at = Window.partitionBy(*CONV).orderBy(*ORDER)
    opens = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(at) > int(idle_seconds * US), F.lit(False))
    # the same partitioning and order as the running windows that follow: one exchange
    return (p.withColumn("opens", opens.cast("int"))
            .withColumn("session", F.sum("opens").over(at.rowsBetween(Window.unboundedPreceding, 0))))


def _session_aggregates() -> dict[str, Column]:
    return {"first": F.min(F.struct("ts_us", "packet_id", "from_lo")), "last_us": F.max("ts_us"), "packets": F.count(F.lit(1)),
            "bytes": F.sum("pkt_len"), "lo_packets": F.sum(F.col("from_lo").cast("long")),
            "lo_bytes": F.sum(F.when(F.col("from_lo"), F.col("pkt_len")).otherwise(0)),
            "longest": F.max("pkt_len"), "shortest": F.min("pkt_len")}


def _facts_by_role(grouped) -> DataFrame:
    """One row a session from order-free aggregates: its conversation (initiator first),
    span, and packets and bytes of both sides. Nothing is collected."""
    s = grouped.agg(*[v.alias(k) for k, v in _session_aggregates().items()])
    lo = F.col("first.from_lo")
    ours = lambda a, whole: F.when(lo, F.col(a)).otherwise(F.col(whole) - F.col(a)).cast("long")
    theirs = lambda a, whole: F.when(lo, F.col(whole) - F.col(a)).otherwise(F.col(a)).cast("long")
    end = lambda k, mine: F.when(lo if mine else ~lo, F.col(f"lo_{k}")).otherwise(F.col(f"hi_{k}"))
    return s.select(
        end("ip", True).alias("src_ip"), end("port", True).alias("src_port"), end("ip", False).alias("dst_ip"), end("port", False).alias("dst_port"), "proto",
        F.timestamp_micros("first.ts_us").alias("start"), F.timestamp_micros("last_us").alias("end"),
        ours("lo_packets", "packets").alias("fwd_packets"), theirs("lo_packets", "packets").alias("bwd_packets"),
        ours("lo_bytes", "bytes").alias("fwd_bytes"), theirs("lo_bytes", "bytes").alias("bwd_bytes"), "shortest", "longest")


def session_facts(packets: DataFrame, idle_seconds: float) -> DataFrame:
    """Sessions as gaps and islands: a conversation that was silent for more than
    ``idle_seconds`` starts anew. One row each; the batch twin of ``stream_sessions``."""
    return _facts_by_role(_with_islands(_prepared(packets), idle_seconds).groupBy(*CONV, "session"))


def stream_sessions(packets: DataFrame, idle_seconds: float, delay_seconds: float) -> DataFrame:
    """ST2 on the JVM alone: closed sessions of a packet stream by ``session_window``, which merges
    sessions in state as packets come in any order within the delay. State is one row
    of aggregates a session."""
    timed = _prepared(packets.withWatermark("ts", f"{int(delay_seconds * 1000)} milliseconds"))
    return _facts_by_role(timed.groupBy(F.session_window("ts", f"{int(idle_seconds * 1000)} milliseconds"), *CONV))


def _last_emissions(prepared: DataFrame, by: list[str], min_duration: float) -> DataFrame:
    """The last row that each group of ``by`` emits."""
    rows = _window_features(prepared, by, min_duration, keep=[*KEEP, *[c for c in by if c not in KEEP]])
    last = Window.partitionBy(*by).orderBy(*ORDER)
    return rows.withColumn("later", F.lead("packet_id").over(last)).where("later is null").select(*KEEP, *[F.col(fcol(n)) for n in FEATURES])


def _window_features(prepared: DataFrame, by: list[str], min_duration: float, keep: list[str] = KEEP,
                     levels: list[int] | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    df = _roles(prepared, run)

    # Gaps are exact integer microseconds: sums, means and maxima do not
    # depend on summation order (or on how a flow is split across tasks).
    def prev_us(flag):
        return F.last(F.when(F.col(flag), F.col("ts_us")), ignorenulls=True).over(before)

    df = df.withColumns({
        "iatF": F.when(F.col("isF"), F.col("ts_us") - prev_us("isF")),
        "iatB": F.when(F.col("isB"), F.col("ts_us") - prev_us("isB")),
        "iatFB": F.when(F.col("isFB"), F.col("ts_us") - prev_us("isFB")),
        "lvl": F.floor((F.col("pkt_len") - 1) / 4).cast("int"),
    })

    def on(flag, c="pkt_len"):
        return F.when(F.col(flag), F.col(c))

    z = F.lit(0.0)
    lenF, lenB, lenFB = on("isF"), on("isB"), on("isFB")
    # act_data_pkt_fwd compares earlier forward lengths with the *current*
    # header length. Running counts of F lengths above each header level
    # (``levels``, by default all 31) keep this linear instead of collecting lists.
    levels = range(MAX_HDR_LEVEL + 1) if levels is None else levels
    above = {f"above{m}": F.sum(F.when(F.col("isF") & (F.col("lvl") >= m), 1).otherwise(0)).over(run) for m in levels}
    agg = {
        "nF": F.sum(F.col("isF").cast("int")).over(run),
        "nB": F.sum(F.col("isB").cast("int")).over(run),
        "sumF": F.sum(lenF).over(run),
        "maxF": F.max(lenF).over(run),
        "avgF": F.avg(lenF).over(run),
        "stdF": F.stddev_pop(lenF).over(run),
        "maxB": F.max(lenB).over(run),
        "minB": F.min(lenB).over(run),
        "avgB": F.avg(lenB).over(run),
        "minFB": F.min(lenFB).over(run),
        "avgFB": F.avg(lenFB).over(run),
        "iatF_sum": F.sum("iatF").over(run),
        "iatF_n": F.count("iatF").over(run),
        "iatF_std": F.stddev_pop("iatF").over(run),
        "iatF_max": F.max("iatF").over(run),
        "iatB_sum": F.sum("iatB").over(run),
        "iatB_n": F.count("iatB").over(run),
        "iatFB_std": F.stddev_pop("iatFB").over(run),
        "start_us": F.first("ts_us").over(run),
        **above,
    }
    df = df.withColumns(agg).where(F.col("is_init") & (F.col("nF") >= 2))

    duration = F.greatest((F.col("ts_us") - F.col("start_us")) / US, F.lit(min_duration))
    d = lambda c: F.col(c).cast("double")
    c0 = lambda c: F.coalesce(F.col(c).cast("double"), z)
    sec = lambda c: F.coalesce(F.col(c).cast("double") / US, z)

    def mean_s(total, n):
        return F.coalesce(F.col(total).cast("double") / F.col(n) / US, z)
    feats = {
        'Destination Port': d("dst_port"),
        'Total Fwd Packets': d("nF"),
        'Total Length of Fwd Packets': d("sumF"),
        'Fwd Packet Length Max': d("maxF"),
        'Fwd Packet Length Mean': d("avgF"),
        'Fwd Packet Length Std': c0("stdF"),
        'Bwd Packet Length Max': c0("maxB"),
        'Bwd Packet Length Min': c0("minB"),
        'Bwd Packet Length Mean': c0("avgB"),
        'Min Packet Length': c0("minFB"),
        'Packet Length Mean': c0("avgFB"),
        'Fwd Packets/s': F.col("nF") / duration,
        'Fwd Header Length': d("hdr"),
        'Fwd Header Length.1': d("hdr"),
        'Fwd IAT Total': sec("iatF_sum"),
        'Fwd IAT Mean': mean_s("iatF_sum", "iatF_n"),
        'Fwd IAT Std': sec("iatF_std"),
        'Fwd IAT Max': sec("iatF_max"),
        'Bwd IAT Mean': mean_s("iatB_sum", "iatB_n"),
        'Flow IAT Std': sec("iatFB_std"),
        'Average Packet Size': c0("avgFB"),
        'Avg Fwd Segment Size': d("avgF"),
        'Avg Bwd Segment Size': c0("avgB"),
        'Subflow Fwd Packets': d("nF"),
        'Subflow Fwd Bytes': d("sumF"),
        'Subflow Bwd Packets': d("nB"),
        'Down/Up Ratio': F.col("nB") / F.greatest(F.col("nF"), F.lit(1)).cast("double"),
        'Init_Win_bytes_forward': F.when(F.col("proto") == 6, F.col("tcp_window"))
                                   .otherwise(F.lit(0)).cast("double"),
        'Init_Win_bytes_backward': z,
        'act_data_pkt_fwd': _at_level("hdr", {m: F.col(f"above{m}") for m in levels}).cast("double"),
    }
    return df.select(*keep, *[feats[name].alias(name) for name in FEATURES])


def _with_facts(p: DataFrame, facts: DataFrame, hot_rows: int) -> DataFrame:
    """Packets with the facts of their conversation (``facts`` holds its packet
    count ``conv_n``). Conversations above ``hot_rows`` packets, at most
    rows / hot_rows of them, get theirs by broadcast if a count allows it: their
    packets stay where they are and are next shuffled by bucket. The others are
    joined on the conversation."""
    facts = write_once(facts, "flow-facts")
    hot = facts.where(F.col("conv_n") > hot_rows)
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    if n_hot == 0 or n_hot > BROADCAST_ROWS:
        return p.join(facts, CONV)
    rest = p.join(F.broadcast(hot.select(*CONV)), CONV, "left_anti")
    return (p.join(F.broadcast(hot), CONV)
            .unionByName(rest.join(facts.where(F.col("conv_n") <= hot_rows), CONV)))


def flow_summary(packets: DataFrame, bucket_seconds: int | None = None,
                 min_duration: float = MIN_DURATION_S, target_rows: int = HOT_ROWS // 4,
                 hot_rows: int = HOT_ROWS // 4) -> DataFrame:
    """FL2: the 30 features once per conversation, at its last emission (the last row
    of ``flow_features``).

    Conversations up to ``hot_rows`` packets take the running windows of one exchange; the
    others, and all if ``bucket_seconds`` is given, the form below without a window
    over a conversation.
    """
    if bucket_seconds:
        return flow_summary_bucketed(packets, bucket_seconds, min_duration, target_rows, hot_rows)
    cold, hot = split_hot(packets, hot_rows, target_rows)
    out = _last_emissions(_prepared(cold), CONV, min_duration)
    return out if hot is None else out.unionByName(flow_summary_bucketed(hot.drop("bucket_us"), None, min_duration, target_rows, hot_rows))


def flow_summary_bucketed(packets: DataFrame, bucket_seconds: int | None = None, min_duration: float = MIN_DURATION_S,
                          target_rows: int = HOT_ROWS // 4, hot_rows: int = HOT_ROWS // 4) -> DataFrame:
    """FL2 where no window spans a conversation, so a conversation holding a large
    share of all packets does not land in one task:

    1. per (conversation, direction) first / last packet -> per conversation
       the initiator, the first reply and the initiator's last packet
       (partial aggregates, a few rows per conversation);
    2. role flags by comparing each packet's (ts, id) with those;
    3. gaps from windows over (conversation, time bucket), the previous
       bucket's last timestamp per role coming from a per-bucket carry table;
    4. one ``groupBy(conversation)`` of order-free aggregates.

    Bucket width: ``bucket_seconds`` if given, else per conversation from its
    packet count and time span (about ``target_rows`` packets per bucket; a
    small conversation is one bucket).
    """
    p = _prepared(packets).withColumns({
        "o": F.struct("ts_us", "packet_id"),
        "win": F.when(F.col("proto") == 6, F.col("tcp_window")).otherwise(F.lit(0)),
    })
    last_pkt = F.struct("ts_us", "packet_id", "hdr", "dst_port", "src_ip", "dst_ip", "src_port",
                        "win", "pkt_len", "ts")
    dirs = p.groupBy(*CONV, "from_lo").agg(F.min("o").alias("first_o"), F.max(last_pkt).alias("last"),
                                           F.count(F.lit(1)).alias("n"))
    facts = dirs.groupBy(*CONV).agg(
        F.min_by("from_lo", "first_o").alias("init_from_lo"),
        F.min("first_o").alias("conv_first"),
        F.when(F.count(F.lit(1)) == 2, F.max("first_o")).alias("reply_o"),
        F.min_by("last", "first_o").alias("il"),
        F.sum("n").alias("conv_n"),
        (F.max("last.ts_us") - F.min("first_o.ts_us") + 1).alias("conv_span"),
    )
    if bucket_seconds:
        width = F.lit(int(bucket_seconds * US))
    else:
        width = F.greatest(F.lit(1), F.ceil(F.col("conv_span") * target_rows / F.col("conv_n"))).cast("long")
    il_o = F.struct(F.col("il.ts_us"), F.col("il.packet_id"))
    r = (_with_facts(p, facts, hot_rows).withColumn("is_init", F.col("from_lo") == F.col("init_from_lo"))
         .withColumn("bucket", F.floor(F.col("ts_us") / width).cast("long")))
    r = r.withColumns({
        "isF": F.col("is_init") & (F.col("reply_o").isNull() | (F.col("o") < F.col("reply_o"))),
        "isB": ~F.col("is_init") & (F.col("o") <= il_o),
    }).withColumn("isFB", F.col("isF") | F.col("isB"))

    # Carry: last timestamp of each role in earlier buckets of the conversation.
    per_bucket = r.groupBy(*CONV, "bucket").agg(
        *[F.max(F.when(F.col(f), F.col("ts_us"))).alias(f"m{f}") for f in ("isF", "isB", "isFB")])
    earlier = Window.partitionBy(*CONV).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*CONV, "bucket", *[F.max(f"m{f}").over(earlier).alias(f"c{f}")
                                                 for f in ("isF", "isB", "isFB")])
    g = r.join(carry, CONV + ["bucket"])
    before = (Window.partitionBy(*CONV, "bucket").orderBy("ts_us", "packet_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumns({
        f"iat{f[2:]}": F.when(F.col(f), F.col("ts_us") - F.coalesce(
            F.last(F.when(F.col(f), F.col("ts_us")), ignorenulls=True).over(before), F.col(f"c{f}")))
        for f in ("isF", "isB", "isFB")})

    def on(flag, c="pkt_len"):
        return F.when(F.col(flag), F.col(c))

    s = g.groupBy(*CONV).agg(
        F.first("il").alias("il"), F.first("conv_first").alias("conv_first"),
        F.sum(F.col("isF").cast("int")).alias("nF"), F.sum(F.col("isB").cast("int")).alias("nB"),
        F.sum(on("isF")).alias("sumF"), F.max(on("isF")).alias("maxF"), F.avg(on("isF")).alias("avgF"),
        F.stddev_pop(on("isF")).alias("stdF"),
        F.max(on("isB")).alias("maxB"), F.min(on("isB")).alias("minB"), F.avg(on("isB")).alias("avgB"),
        F.min(on("isFB")).alias("minFB"), F.avg(on("isFB")).alias("avgFB"),
        F.sum("iatF").alias("iatF_sum"), F.count("iatF").alias("iatF_n"),
        F.stddev_pop("iatF").alias("iatF_std"), F.max("iatF").alias("iatF_max"),
        F.sum("iatB").alias("iatB_sum"), F.count("iatB").alias("iatB_n"),
        F.stddev_pop("iatFB").alias("iatFB_std"),
        F.sum((F.col("isF") & (F.col("pkt_len") > F.col("il.hdr"))).cast("int")).alias("act"),
    ).where(F.col("nF") >= 2)

    z = F.lit(0.0)
    d = lambda c: F.col(c).cast("double")
    c0 = lambda c: F.coalesce(F.col(c).cast("double"), z)
    sec = lambda c: F.coalesce(F.col(c).cast("double") / US, z)

    def mean_s(total, n):
        return F.coalesce(F.col(total).cast("double") / F.col(n) / US, z)

    duration = F.greatest((F.col("il.ts_us") - F.col("conv_first.ts_us")) / US, F.lit(min_duration))
    hdr = F.col("il.hdr").cast("double")
    feats = {
        'Destination Port': F.col("il.dst_port").cast("double"),
        'Total Fwd Packets': d("nF"), 'Total Length of Fwd Packets': d("sumF"),
        'Fwd Packet Length Max': d("maxF"), 'Fwd Packet Length Mean': d("avgF"),
        'Fwd Packet Length Std': c0("stdF"), 'Bwd Packet Length Max': c0("maxB"),
        'Bwd Packet Length Min': c0("minB"), 'Bwd Packet Length Mean': c0("avgB"),
        'Min Packet Length': c0("minFB"), 'Packet Length Mean': c0("avgFB"),
        'Fwd Packets/s': F.col("nF") / duration,
        'Fwd Header Length': hdr, 'Fwd Header Length.1': hdr,
        'Fwd IAT Total': sec("iatF_sum"), 'Fwd IAT Mean': mean_s("iatF_sum", "iatF_n"),
        'Fwd IAT Std': sec("iatF_std"), 'Fwd IAT Max': sec("iatF_max"),
        'Bwd IAT Mean': mean_s("iatB_sum", "iatB_n"), 'Flow IAT Std': sec("iatFB_std"),
        'Average Packet Size': c0("avgFB"), 'Avg Fwd Segment Size': d("avgF"),
        'Avg Bwd Segment Size': c0("avgB"), 'Subflow Fwd Packets': d("nF"),
        'Subflow Fwd Bytes': d("sumF"), 'Subflow Bwd Packets': d("nB"),
        'Down/Up Ratio': F.col("nB") / F.greatest(F.col("nF"), F.lit(1)).cast("double"),
        'Init_Win_bytes_forward': F.col("il.win").cast("double"),
        'Init_Win_bytes_backward': z,
        'act_data_pkt_fwd': d("act"),
    }
    keys = [F.col("il.packet_id").alias("packet_id"), F.col("il.ts").alias("ts"),
            F.col("il.src_ip").alias("src_ip"), F.col("il.dst_ip").alias("dst_ip"),
            F.col("il.src_port").alias("src_port"), F.col("il.dst_port").alias("dst_port"),
            F.col("proto"), F.col("il.pkt_len").alias("pkt_len")]
    return s.select(*keys, *[feats[n].alias(n) for n in FEATURES])


def _exact_std(n: Column, s1: Column, s2: Column) -> Column:
    """Population std from exact integer moments: sqrt((n*S2 - S1^2) / n^2)."""
    dec = "decimal(38,0)"
    num = n.cast(dec) * s2.cast(dec) - s1.cast(dec) * s1.cast(dec)
    nd = n.cast("double")
    return F.when(n > 0, F.sqrt(F.greatest(num.cast("double") / (nd * nd), F.lit(0.0))))


def flow_features_bucketed(packets: DataFrame, bucket_seconds: int = 300,
                           min_duration: float = MIN_DURATION_S,
                           bucket_col: str | None = None, hot_rows: int = HOT_ROWS // 4) -> DataFrame:
    """FL1 as a prefix scan over (conversation, time bucket): skew-safe form.

    Same rows and values as ``flow_features``; no task holds more than one
    bucket of one conversation:

    1. roles from partial aggregates (initiator, first reply) -- a few rows
       per conversation, joined back (by broadcast for conversations above
       ``hot_rows`` packets, whose number is bounded and counted);
    2. running values inside the bucket (window over (conversation, bucket)),
       written once; those at a bucket's last packet are its totals;
    3. a carry of the totals of earlier buckets (a window over the per-bucket
       table, one row per bucket), which also closes the gap from each role's last
       packet before the bucket to its first one inside, joined to the rows once.

    Sums of gaps are differences of times, their counts those of packets less one.
    Standard deviations use exact integer moments (counts, sums and sums of
    squares as DECIMAL(38,0)), which are associative, so the carry + local
    combination is exact. ``bucket_col`` (microseconds per bucket, per row)
    overrides ``bucket_seconds``, e.g. sized per conversation from its rate;
    any bucketing monotone in time gives the same result.
    """
    width = F.col(bucket_col) if bucket_col else F.lit(int(bucket_seconds * US))
    levels = extent(packets)[1]
    p = _prepared(packets).select(
        *CONV, "from_lo", "packet_id", "ts", "ts_us", "pkt_len", "hdr", "tcp_window",
        F.floor(F.col("ts_us") / width).cast("long").alias("bucket"))
    o = F.struct("ts_us", "packet_id")
    dirs = p.groupBy(*CONV, "from_lo").agg(F.min(o).alias("first_o"), F.count(F.lit(1)).alias("n"))
    facts = dirs.groupBy(*CONV).agg(
        F.min_by("from_lo", "first_o").alias("init_from_lo"),
        F.min("first_o.ts_us").alias("start_us"), F.sum("n").alias("conv_n"),
        F.when(F.count(F.lit(1)) == 2, F.max("first_o")).alias("reply_o"))
    r = _with_facts(p, facts, hot_rows).withColumn("is_init", F.col("from_lo") == F.col("init_from_lo"))
    r = r.withColumns({
        "isF": F.col("is_init") & (F.col("reply_o").isNull() | (o < F.col("reply_o"))),
        "isB": ~F.col("is_init"), "reply_us": F.col("reply_o.ts_us"),
    }).withColumn("isX", F.col("isF") | F.col("isB")).drop("reply_o", "init_from_lo", "conv_n")

    # 2. running values inside the bucket
    wb = Window.partitionBy(*CONV, "bucket").orderBy("ts_us", "packet_id")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    run = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dec = "decimal(38,0)"

    def on(flag, c="pkt_len"):
        return F.when(F.col(flag), F.col(c).cast("long"))

    def square(gap):
        return gap.cast(dec) * gap.cast(dec)

    g = r.withColumns({f"gap{k}": F.when(F.col(f"is{k}"), F.col("ts_us") - F.last(on(f"is{k}", "ts_us"), ignorenulls=True).over(before))
                       for k in "FX"})
    sums = {"nF": F.col("isF").cast("long"), "nB": F.col("isB").cast("long"), "sF": on("isF"), "sB": on("isB"), "qF": on("isF") * on("isF"),
            "gFq": square(F.col("gapF")), "gXq": square(F.col("gapX")),
            **{f"h{m}": (F.col("isF") & (F.floor((F.col("pkt_len") - 1) / 4) >= m)).cast("long") for m in levels}}
    maxes = {"xF": on("isF"), "xB": on("isB"), "gFx": F.col("gapF"), "tF": on("isF", "ts_us"), "tB": on("isB", "ts_us")}
    mins = {"iF": on("isF"), "iB": on("isB")}
    firsts = {"eF": on("isF", "ts_us"), "eX": on("isX", "ts_us")}
    g = g.withColumns({**{k: F.coalesce(F.sum(v).over(run), F.lit(0)) for k, v in sums.items()},
                       **{k: F.max(v).over(run) for k, v in maxes.items()},
                       **{k: F.min(v).over(run) for k, v in {**mins, **firsts}.items()},
                       "closes": F.lead("packet_id").over(wb).isNull()})
    g = write_once(g.where(F.col("is_init") | F.col("closes"))
                   .drop("isF", "isB", "isX", "gapF", "gapX"), "flow-running")

    # 3. totals of earlier buckets
    earlier = Window.partitionBy(*CONV).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = g.where("closes").select(*CONV, "bucket", *sums, *maxes, *mins, *firsts).withColumns({
        "dF": F.col("eF") - F.max("tF").over(earlier),
        "dX": F.col("eX") - F.max(F.greatest("tF", "tB")).over(earlier)})
    totals = totals.withColumns({"gFx": F.greatest("gFx", "dF"), **{
        f"g{k}q": F.col(f"g{k}q") + F.coalesce(square(F.col(f"d{k}")), F.lit(0).cast(dec)) for k in "FX"}})
    carry = totals.select(
        *CONV, "bucket", "dF", "dX",
        *[F.sum(k).over(earlier).alias(f"c{k}") for k in sums],
        *[F.max(k).over(earlier).alias(f"c{k}") for k in maxes],
        *[F.min(k).over(earlier).alias(f"c{k}") for k in mins])
    g = g.where("is_init").drop("closes", *firsts).join(carry, CONV + ["bucket"])
    # a bucket's first gap counts from the role's first packet inside on
    g = g.withColumns({"dF": F.when(F.col("nF") > 0, F.col("dF")), "dX": F.when(F.col("nF") + F.col("nB") > 0, F.col("dX"))})
    g = g.withColumns({**{k: F.coalesce(F.col(f"c{k}"), F.lit(0)) + F.col(k) for k in sums},
                       **{k: F.greatest(f"c{k}", k) for k in maxes}, **{k: F.least(f"c{k}", k) for k in mins}})
    g = g.where(F.col("nF") >= 2).withColumns({
        "gFx": F.greatest("gFx", "dF"), **{f"g{k}q": F.col(f"g{k}q") + F.coalesce(square(F.col(f"d{k}")), F.lit(0).cast(dec)) for k in "FX"},
        "gFn": F.col("nF") - 1, "gFs": F.col("tF") - F.col("start_us"),
        "gBn": F.col("nB") - 1, "gBs": F.col("tB") - F.col("reply_us"),
        "nX": F.col("nF") + F.col("nB"), "gXs": F.greatest("tF", "tB") - F.col("start_us"),
        "sX": F.col("sF") + F.col("sB"), "iX": F.least("iF", "iB")}).withColumn("gXn", F.col("nX") - 1)
    ends = [F.when(F.col("from_lo"), F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{name}_{c}")
            for c in ("ip", "port") for name, a, b in (("src", "lo", "hi"), ("dst", "hi", "lo"))]
    g = g.select("*", *ends)

    z = F.lit(0.0)
    d = lambda c: F.col(c).cast("double")
    c0 = lambda c: F.coalesce(F.col(c).cast("double"), z)

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(z)

    duration = F.greatest((F.col("ts_us") - F.col("start_us")) / US, F.lit(min_duration))
    act = _at_level("hdr", {m: F.col(f"h{m}") for m in levels})
    feats = {
        'Destination Port': d("dst_port"),
        'Total Fwd Packets': d("nF"), 'Total Length of Fwd Packets': d("sF"),
        'Fwd Packet Length Max': d("xF"), 'Fwd Packet Length Mean': ratio("sF", "nF"),
        'Fwd Packet Length Std': F.coalesce(_exact_std(F.col("nF"), F.col("sF"), F.col("qF")), z),
        'Bwd Packet Length Max': c0("xB"), 'Bwd Packet Length Min': c0("iB"),
        'Bwd Packet Length Mean': ratio("sB", "nB"),
        'Min Packet Length': c0("iX"), 'Packet Length Mean': ratio("sX", "nX"),
        'Fwd Packets/s': F.col("nF") / duration,
        'Fwd Header Length': d("hdr"), 'Fwd Header Length.1': d("hdr"),
        'Fwd IAT Total': F.col("gFs").cast("double") / US,
        'Fwd IAT Mean': ratio("gFs", "gFn") / US,
        'Fwd IAT Std': F.coalesce(_exact_std(F.col("gFn"), F.col("gFs"), F.col("gFq")), z) / US,
        'Fwd IAT Max': c0("gFx") / US,
        'Bwd IAT Mean': ratio("gBs", "gBn") / US,
        'Flow IAT Std': F.coalesce(_exact_std(F.col("gXn"), F.col("gXs"), F.col("gXq")), z) / US,
        'Average Packet Size': ratio("sX", "nX"), 'Avg Fwd Segment Size': ratio("sF", "nF"),
        'Avg Bwd Segment Size': ratio("sB", "nB"), 'Subflow Fwd Packets': d("nF"),
        'Subflow Fwd Bytes': d("sF"), 'Subflow Bwd Packets': d("nB"),
        'Down/Up Ratio': F.col("nB") / F.greatest(F.col("nF"), F.lit(1)).cast("double"),
        'Init_Win_bytes_forward': F.when(F.col("proto") == 6, F.col("tcp_window"))
                                   .otherwise(F.lit(0)).cast("double"),
        'Init_Win_bytes_backward': z,
        'act_data_pkt_fwd': act.cast("double"),
    }
    return g.select(*KEEP, *[feats[name].alias(name) for name in FEATURES])
