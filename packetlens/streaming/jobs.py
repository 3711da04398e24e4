"""Streaming scoring, counters, timeline and alerts (ST4-ST8), and runners.

Stateless chains (ST4, ST7) are the batch column operators applied to a
streaming DataFrame. Counters (ST5) are a streaming aggregate published per
micro-batch as a complete table; the timeline (ST6) is an event-time
tumbling window with a watermark (append mode emits closed buckets only, late
rows are dropped and counted, ST8). ``stream_detect`` is the live job: packets in any
order -> tracked flows -> saved model -> gate -> verdicts, counters, alerts and late
packets, each micro-batch published once.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetlens.functions.columns import DDOS_RATE, PORTSCAN_RATE, attack_type, severity
from packetlens.operators.flows import KEEP
from packetlens.operators.scoring import ensemble_live, live_gate
from packetlens.schemas import PACKET
from packetlens.session import scratch_path
from packetlens.streaming.flows import track_flows
from packetlens.streaming.sink import BatchLog


def land(df: DataFrame, name: str) -> str:
    """Write a batch DataFrame as files of a landing folder (the stream's input)."""
    path = scratch_path(df.sparkSession, f"landing-{name}")
    df.write.mode("error").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """S3 + S4: a file stream with a fixed schema; ``max_files`` bounds each micro-batch."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_append(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> tuple[str, StreamingQuery]:
    """Run to the end of the available input into a parquet sink; returns its path. Called
    again with the same ``base`` it goes on where it ended."""
    base = base or scratch_path(stream.sparkSession, f"sink-{name}")
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start(os.path.join(base, "data")))
    q.awaitTermination()
    return os.path.join(base, "data"), q


def run_batches(stream: DataFrame, base: str, tables: Callable[[DataFrame], dict[str, DataFrame]],
                views: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None,
                mode: str = "append") -> tuple[BatchLog, StreamingQuery]:
    """S4 + S5: run to the end of the available input, each micro-batch published once in the
    tables of ``base``. Called again with the same ``base`` it goes on where it ended."""
    log = BatchLog(stream.sparkSession, os.path.join(base, "tables"))
    q = (stream.writeStream.outputMode(mode).foreachBatch(lambda batch, i: log.publish(i, tables(batch), views))
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return log, q


def run_complete(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Run an aggregate in complete mode; each micro-batch publishes the whole table,
    which replaces the one before at once. Returns the newest."""
    base = scratch_path(stream.sparkSession, f"table-{name}")
    log, q = run_batches(stream, base, lambda batch: {name: batch}, mode="complete")
    return log.read(name, newest_only=True), q


def land_in_files(packets: DataFrame, name: str, files: int) -> str:
    """A landing folder of ``files`` files that hold the rows in no order: every file
    spans the whole time."""
    path = scratch_path(packets.sparkSession, f"landing-{name}")
    packets.repartition(files, F.xxhash64("packet_id")).write.parquet(path)
    return path


def land_batches(df: DataFrame, name: str, batches: int, by: Column | None = None) -> tuple[str, int]:
    """A landing folder for ``batches`` micro-batches, and how many files one of them takes: as many
    as ``df`` has partitions, so that files don't grow with the table and a micro-batch is
    written and read by many tasks. Rows are dealt by a hash of ``by``, else in turn."""
    each = max(1, df.rdd.getNumPartitions())
    path = scratch_path(df.sparkSession, f"landing-{name}")
    df.repartition(batches * each, *[] if by is None else [F.xxhash64(by)]).write.parquet(path)
    return path, each


def land_flush(spark: SparkSession, path: str, after: datetime.datetime) -> None:
    """Add a marker packet at ``after`` to a landing folder of packets: it moves the watermark on,
    so that everything that still waits is released. Its conversation has one packet
    and never emits."""
    row = (-1, after, 0.0, "0.0.0.0", "255.255.255.255", 0, 0, 17, 0, 5, None, None)
    spark.createDataFrame([row], PACKET).coalesce(1).write.mode("append").parquet(path)


def stream_detect(packets: DataFrame, model_path: str, base: str, delay_seconds: float, ddos_rate: float = DDOS_RATE,
                  scan_rate: float = PORTSCAN_RATE, gate: bool = True, **options) -> tuple[BatchLog, StreamingQuery]:
    """The live job (S3, ST1, M7, R5, R1, ST5, ST7, ST8): tables ``tracked``, ``verdicts``, ``counters``
    (per attack type, to be added up over batches), ``alerts`` and ``late``. The model is loaded
    once, when the job starts."""
    from packetlens.operators.models import load_hybrid
    from packetlens.plans.detection import detect, with_type
    model = load_hybrid(packets.sparkSession, model_path)

    def verdicts(t: dict[str, DataFrame]) -> DataFrame:
        return detect(with_type(t["tracked"].where("kind = 'flow'").drop("kind"), ddos_rate, scan_rate), model, gate)

    return run_batches(track_flows(packets, ("flow",), delay_seconds, **options), base, lambda batch: {"tracked": batch}, {
        "verdicts": verdicts,
        "counters": lambda t: stream_counters(t["verdicts"]),
        "alerts": lambda t: stream_alerts(t["verdicts"]),
        "late": lambda t: t["tracked"].where("kind = 'late'").select(*KEEP)})


def total_counters(counters: DataFrame) -> DataFrame:
    """Counters of all batches, from those of each."""
    names = ("total_packets", "total_attacks", "total_normal")
    return counters.groupBy("attack_type").agg(*[F.sum(c).alias(c) for c in names])


def stream_scores(scored: DataFrame, gate: bool = True) -> DataFrame:
    """ST4: live ensemble -> gate -> attack type, row by row on the stream."""
    out = ensemble_live(scored)
    if gate:
        out = live_gate(out)
    return out.withColumn("attack_type", attack_type("port", "rate"))


def stream_counters(scores: DataFrame) -> DataFrame:
    """ST5: session counters per attack type (complete mode)."""
    a = F.col("label") == "ATTACK"
    return scores.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.sum(a.cast("long")).alias("total_attacks"),
        F.sum((~a).cast("long")).alias("total_normal"))


def stream_timeline(scores: DataFrame, ts: str = "ts", bucket: str = "7 days",
                    delay: str = "7 days") -> DataFrame:
    """ST6 + ST8: attack / normal counts per closed event-time bucket."""
    a = F.col("label") == "ATTACK"
    return (scores.withWatermark(ts, delay)
            .groupBy(F.window(ts, bucket).alias("w"))
            .agg(F.sum(a.cast("long")).alias("attacks"), F.sum((~a).cast("long")).alias("normal"))
            .select(F.col("w.start").alias("bucket_start"), "attacks", "normal"))


def stream_alerts(scores: DataFrame) -> DataFrame:
    """ST7: ATTACK rows with severity, appended; newest-N is read from the sink."""
    return scores.where(F.col("label") == "ATTACK").withColumn("severity", severity("final_score"))
