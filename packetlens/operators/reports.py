"""Counters, score bands, breakdowns, timelines, recent rows and feed unions.

Aggregates are plain ``groupBy().agg`` (partial aggregation before the
shuffle). Bounded outputs -- the five attack types, the timeline spine, the
newest-N lists -- are built by union + aggregate or by ``limit`` over a sort,
never by joining an unbounded table against a broadcast of data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.functions.columns import BAND_FN, BAND_FP, severity
from packetlens.schemas import ATTACK_TYPES



def _is_attack(label: str) -> Column:
    return F.col(label) == "ATTACK"


def session_counters(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """A1 + A3: total, attacks, normal and attack rate in percent."""
    a = _is_attack(label)
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.coalesce(F.sum(a.cast("long")), F.lit(0)).alias("total_attacks"),
        F.coalesce(F.sum((~a).cast("long")), F.lit(0)).alias("total_normal"),
    )
    return out.withColumn(
        "attack_rate",
        F.coalesce(F.try_divide(F.col("total_attacks") * 100.0, F.col("total_packets")), F.lit(0.0)))


def score_bands(df: DataFrame, label: str = "label", score: str = "final_score",
                by: list[str] | None = None, fn_edge: float = BAND_FN,
                fp_edge: float = BAND_FP) -> DataFrame:
    """A2: heuristic bands without ground truth.

    ATTACK -> tp; NORMAL rows by score: > fn_edge -> fn, > fp_edge -> fp, else tn.
    """
    a = _is_attack(label)
    s = F.col(score)
    n = lambda cond: F.sum(cond.cast("long"))
    return df.groupBy(*(by or [])).agg(
        n(a).alias("tp"),
        n(~a & (s > fn_edge)).alias("fn"),
        n(~a & ~(s > fn_edge) & (s > fp_edge)).alias("fp"),
        n(~a & ~(s > fn_edge) & ~(s > fp_edge)).alias("tn"),
    )


def attack_breakdown(df: DataFrame, type_col: str = "attack_type",
                     label: str | None = "label") -> DataFrame:
    """A4 + J3: count per attack type, all five types present in fixed order.

    Only ATTACK rows count when ``label`` is given. The five-row spine is
    unioned in and summed, so no join against the data is needed.
    """
    spark = df.sparkSession
    rows = df if label is None else df.where(_is_attack(label))
    counts = rows.groupBy(F.col(type_col).alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(t, i + 1) for i, t in enumerate(ATTACK_TYPES)],
                                  "attack_type string, type_order int")
    # Types outside the fixed five are kept, ordered after them.
    merged = (counts.withColumn("type_order", F.lit(None).cast("int"))
              .unionByName(spine.withColumn("n", F.lit(0).cast("long")))
              .groupBy("attack_type")
              .agg(F.sum("n").alias("n"), F.min("type_order").alias("type_order")))
    total = F.sum("n").over(Window.partitionBy())
    return merged.select(
        "attack_type",
        F.coalesce("type_order", F.lit(len(ATTACK_TYPES) + 1)).alias("type_order"),
        F.col("n").cast("long").alias("n"),
        (F.col("n") * 100.0 / F.greatest(total, F.lit(1))).alias("pct"),
    )


def timeline(df: DataFrame, ts: str = "ts", label: str = "label",
             bucket_seconds: int = 60, last_n: int = 40) -> DataFrame:
    """Attack / normal counts per tumbling event-time bucket.

    Always ``last_n`` buckets ending at the newest one; empty buckets are 0.
    The newest bucket is a scalar aggregate; the cut-off is then a literal
    filter before the group, so only the last ``last_n`` buckets are
    aggregated, and the zero spine is ``last_n`` generated rows.
    """
    w = int(bucket_seconds)
    b = (F.floor(F.unix_seconds(F.col(ts)) / w) * w).cast("long")
    rows = df.select(b.alias("b"), _is_attack(label).alias("a"))
    mx = rows.agg(F.max("b")).first()[0]
    if mx is None:
        return df.sparkSession.createDataFrame([], "bucket_start timestamp, attacks long, normal long")
    lo = int(mx) - (last_n - 1) * w
    counted = (rows.where(F.col("b") >= F.lit(lo)).groupBy("b")
               .agg(F.sum(F.col("a").cast("long")).alias("attacks"),
                    F.sum((~F.col("a")).cast("long")).alias("normal")))
    zeros = df.sparkSession.range(last_n).select(
        (F.lit(lo) + F.col("id") * w).alias("b"), F.lit(0).cast("long").alias("attacks"),
        F.lit(0).cast("long").alias("normal"))
    return (counted.unionByName(zeros).groupBy("b")
            .agg(F.sum("attacks").alias("attacks"), F.sum("normal").alias("normal"))
            .select(F.timestamp_seconds("b").alias("bucket_start"), "attacks", "normal"))


def moving_mean(df: DataFrame, value: str, order: list[str], by: list[str] | None = None,
                n: int = 50, out: str = "moving_mean", strategy: str = "auto",
                ts: str | None = None, bucket_seconds: int = 3600,
                hot_rows: int = 2_000_000) -> DataFrame:
    """Mean of the last ``n`` values (current included) per key.

    ``auto`` (default): without ``by`` the blocked path over buckets sized from
    the table's rate; with it, keys with more than ``hot_rows`` rows (found with a
    partial aggregate; a bounded set, checkpointed and broadcast) take the
    blocked path, the others the window path.
    ``window``: one bounded-frame window per key. ``blocked``: skew-safe --
    rows get their exact per-key position from per-(key, time bucket) counts
    and prefix offsets, then each row is sent to its block of ``n`` positions
    and, as look-back, to the next block; every window group holds at most
    2n rows whatever the key's size. ``ts`` is the event-time column used for
    the buckets (default: the first order column).
    """
    if strategy == "auto" and not by:
        # one global key: buckets by its rate, so that no task holds all rows
        t_us = F.unix_micros(F.col(ts or order[0]).cast("timestamp"))
        n_rows, span = df.agg(F.count(F.lit(1)), F.max(t_us) - F.min(t_us) + 1).first()
        width = max(1, -(-(span or 1) * max(1, min(hot_rows, 500_000)) // max(1, n_rows)))
        return moving_mean(df.withColumn("_width_us", F.lit(width).cast("long")), value, order, by, n, out, "blocked",
                           ts, bucket_seconds).drop("_width_us")
    if strategy == "window":
        w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(n - 1), 0)
        return df.withColumn(out, F.avg(value).over(w))
    if strategy == "auto":
        from packetlens.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        t_us = F.unix_micros(F.col(ts or order[0]).cast("timestamp"))
        hot = (df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.max(t_us) - F.min(t_us) + 1).alias("_span"))
               .where(F.col("_n") > hot_rows)
               .select(*by, F.greatest(F.lit(1), F.ceil(F.col("_span") * max(1, hot_rows // 4) / F.col("_n")))
                       .cast("long").alias("_width_us"))
               .checkpoint(eager=True))
        if hot.isEmpty():
            return moving_mean(df, value, order, by, n, out, "window")
        cold = df.join(F.broadcast(hot.select(*by)), by, "left_anti")
        warm = df.join(F.broadcast(hot), by, "inner")
        return (moving_mean(cold, value, order, by, n, out, "window")
                .unionByName(moving_mean(warm, value, order, by, n, out, "blocked", ts, bucket_seconds)
                             .drop("_width_us")))
    keys = list(by or [])
    t = ts or order[0]
    # Bucket width: per key (``_width_us``, sized from its rate) when present, else fixed.
    if "_width_us" in df.columns:
        bk = F.floor(F.unix_micros(F.col(t).cast("timestamp")) / F.col("_width_us"))
    else:
        bk = F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / int(bucket_seconds))
    d = df.withColumn("_bk", bk.cast("long"))
    counts = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select(*keys, "_bk", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    # null-safe: rows without a time are a bucket of their own, the first one
    named = {c: f"_off_{i}" for i, c in enumerate([*keys, "_bk"])}
    offs = offs.withColumnsRenamed(named)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in named.items()]
    d = d.join(offs, same).drop(*named.values())
    d = d.withColumn("_i", F.col("_off") - 1 + F.row_number().over(
        Window.partitionBy(*keys, "_bk").orderBy(*order)))
    d = d.withColumn("_blk", F.floor(F.col("_i") / n).cast("long"))
    d = d.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("_g", F.col("_blk") + F.col("_copy"))
    w = Window.partitionBy(*keys, "_g").orderBy("_i").rowsBetween(-(n - 1), 0)
    res = d.withColumn(out, F.avg(value).over(w)).where(F.col("_copy") == 0)
    return res.drop("_bk", "_off", "_i", "_blk", "_copy", "_g")


def keep_last(df: DataFrame, order: list[str], by: list[str] | None = None, n: int = 200) -> DataFrame:
    """Newest ``n`` rows per key (Spark applies the limit per map partition first)."""
    w = Window.partitionBy(*(by or [])).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows by the given order (descending), ties broken by it."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def recent_alerts(df: DataFrame, order: list[str], label: str = "label", n: int = 15,
                  score: str = "final_score") -> DataFrame:
    """T2 + R6: newest ``n`` ATTACK rows with their severity."""
    return newest(df.where(_is_attack(label)), order, n).withColumn("severity", severity(score))


def feed_union(feeds: dict[str, DataFrame]) -> DataFrame:
    """Union of feeds by column name, tagged with a ``source`` column."""
    out = None
    for name, d in feeds.items():
        d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def port_class(df: DataFrame, port: str = "port") -> DataFrame:
    """Left join of rows to the broadcast (port, class) table."""
    from packetlens.functions.columns import BRUTEFORCE_PORTS, SQLINJECT_PORTS
    spark = df.sparkSession
    classes = spark.createDataFrame(
        [(p, "bruteforce") for p in BRUTEFORCE_PORTS] + [(p, "database") for p in SQLINJECT_PORTS],
        "class_port int, port_class string")
    j = df.join(F.broadcast(classes), df[port] == classes["class_port"], "left").drop("class_port")
    return j.withColumn("port_class", F.coalesce("port_class", F.lit("other")))


def log_records(df: DataFrame, ts: str = "ts") -> DataFrame:
    """P9 + P10 + P8 + P11: the display projection of scored rows.

    Time as %H:%M:%S, probabilities as "x.y%", score as "0.000", absent
    fields as their defaults ('?' for endpoints, ports and protocol, 0 for
    other numbers).
    """
    from packetlens.functions.columns import clock_text, col_or, pct_text, proto_name, score_text, verdict_display
    cols = set(df.columns)

    def get(c, default):
        return col_or(c, default) if c in cols else F.lit(default)

    return df.select(
        clock_text(ts).alias("Time"),
        get("src_ip", "?").alias("Src IP"),
        (F.coalesce(F.col("dst_port").cast("string"), F.lit("?")) if "dst_port" in cols else F.lit("?")).alias("Dst Port"),
        (F.when(F.col("proto").isNull(), "?").otherwise(proto_name("proto")) if "proto" in cols else F.lit("?")).alias("Proto"),
        get("pkt_len", 0).alias("Pkt Len"),
        pct_text(get("ml_prob", 0.0)).alias("ML Prob"),
        pct_text(get("dl_score", 0.0)).alias("DL Score"),
        score_text(get("final_score", 0.0)).alias("Score"),
        get("label", "NORMAL").alias("Verdict"),
        verdict_display(get("label", "NORMAL")).alias("Display"),
    )
