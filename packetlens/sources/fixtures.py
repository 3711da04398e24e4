"""Adapters from the shared test tables to the engine's input shapes.

* ``packets_from_events``  events   -> PACKET rows (flow features, timelines, streams)
* ``scored_from_lineitem`` lineitem -> scored flow rows (rules, ensembles, counters)
* ``vectors_from_embeddings`` embeddings -> feature vectors with a benign flag
* ``doc_predictions``      labels x documents -> truth / prediction / score
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Destination port per service number 0..7 of the events adapter.
SERVICE_PORTS = [80, 443, 22, 3306, 53, 3389, 8080, 5432]
# Destination port per l_partkey % 12 of the lineitem adapter.
LINEITEM_PORTS = [22, 23, 21, 3389, 5900, 3306, 5432, 1433, 1521, 80, 443, 53]

EPOCH_2024_US = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_since_2024(ts: Column) -> Column:
    return (F.unix_micros(ts) - F.lit(EPOCH_2024_US)) / F.lit(1e6)


def packets_from_events(events: DataFrame) -> DataFrame:
    """events -> PACKET. A flow is (user_id, svc) with svc = props.k % 8.

    Rows of type view/click whose id is divisible by 3 are replies: source
    and destination swap. Port and window values are derived from the ids.
    """
    svc = F.get_json_object("props", "$.k").cast("int") % 8
    # exploded from one element: later filters stay above, so that a text is parsed once, not at each reference
    e = events.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(svc)).alias("svc"))
    is_reply = F.col("event_type").isin("view", "click") & (F.col("event_id") % 3 == 0)
    client_ip = F.concat(F.lit("10.0."), (F.col("user_id") / 256).cast("bigint").cast("string"),
                         F.lit("."), (F.col("user_id") % 256).cast("string"))
    client_port = (F.lit(40000) + F.col("user_id") % 20000).cast("int")
    server_ip = F.concat(F.lit("192.168.0."), F.col("svc").cast("string"))
    server_port = F.element_at(F.array(*[F.lit(p) for p in SERVICE_PORTS]), F.col("svc") + 1)
    proto = F.when(F.col("svc") == 4, F.lit(17)).otherwise(F.lit(6))
    return e.select(
        F.col("event_id").alias("packet_id"),
        F.col("ts"),
        seconds_since_2024(F.col("ts")).alias("ts_s"),
        F.when(is_reply, server_ip).otherwise(client_ip).alias("src_ip"),
        F.when(is_reply, client_ip).otherwise(server_ip).alias("dst_ip"),
        F.when(is_reply, server_port).otherwise(client_port).cast("int").alias("src_port"),
        F.when(is_reply, client_port).otherwise(server_port).cast("int").alias("dst_port"),
        proto.cast("int").alias("proto"),
        (F.lit(40) + F.floor(F.col("value") * 3).cast("int")).cast("int").alias("pkt_len"),
        F.lit(5).cast("int").alias("ip_ihl"),
        F.when(proto == 6, F.lit(5) + F.col("event_id") % 4).cast("int").alias("tcp_dataofs"),
        ((F.col("event_id") * 7919) % 65536).cast("int").alias("tcp_window"),
    )


def scored_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """lineitem -> scored flow rows: rate, port, dl_error, ml_prob, ts.

    ``+ 0.0`` clears the negative zeros present in discount and tax.
    """
    port = F.element_at(F.array(*[F.lit(p) for p in LINEITEM_PORTS]),
                        (F.col("l_partkey") % 12).cast("int") + 1)
    return lineitem.select(
        F.col("l_extendedprice").alias("rate"),
        port.cast("int").alias("port"),
        (F.col("l_discount") * 5 + 0.0).alias("dl_error"),
        (F.col("l_tax") * 12.5 + 0.0).alias("ml_prob"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def vectors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """embeddings -> (vec_id, x array<double>, label, benign)."""
    return embeddings.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("x"),
        "label",
        (F.col("label") < 5).alias("benign"),
    )


def doc_predictions(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """labels x documents -> (doc_id, truth, prediction, score)."""
    d = documents.select("doc_id", "n_chars")
    return labels.join(d, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("int").alias("truth"),
        (F.col("n_chars") > 2000).cast("int").alias("prediction"),
        F.col("n_chars").cast("double").alias("score"),
    )


def flows_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """lineitem -> a labelled flow table in the shape of a flow CSV.

    Some of the 30 model columns are present (two with +-inf / NaN from
    IEEE division by a zero discount, one with nulls), the rest are missing;
    ``Flow ID`` is an extra column and ``Label`` the string label.
    """
    from packetlens.functions.columns import ieee_divide

    port = F.element_at(F.array(*[F.lit(p) for p in LINEITEM_PORTS]),
                        (F.col("l_partkey") % 12).cast("int") + 1)
    return lineitem.select(
        F.col("l_orderkey").alias("Flow ID"),
        F.col("l_linenumber").alias("line"),
        port.cast("int").alias("Destination Port"),
        ieee_divide("l_quantity", F.col("l_discount") + 0.0).alias("Fwd Packets/s"),
        ieee_divide("l_tax", F.col("l_discount") + 0.0).alias("Down/Up Ratio"),
        F.col("l_quantity").alias("Total Fwd Packets"),
        F.col("l_extendedprice").alias("Total Length of Fwd Packets"),
        ieee_divide("l_extendedprice", "l_quantity").alias("Fwd Packet Length Mean"),
        F.col("l_linenumber").alias("Init_Win_bytes_forward"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 1000).alias("Fwd IAT Total"),
        F.when(F.col("l_linestatus") == "O", F.lit("BENIGN")).otherwise(F.lit("DDoS")).alias("Label"),
    )
