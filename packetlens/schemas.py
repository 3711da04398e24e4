"""Schemas of the engine's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import types as T

# The 30 model feature columns, in model order.
FEATURES = [
    'Down/Up Ratio', 'Bwd IAT Mean', 'Flow IAT Std', 'Fwd Packets/s',
    'Min Packet Length', 'Fwd Packet Length Std', 'Packet Length Mean',
    'Bwd Packet Length Mean', 'Avg Bwd Segment Size', 'Bwd Packet Length Max',
    'Fwd Header Length', 'Destination Port', 'Fwd IAT Mean',
    'Average Packet Size', 'Subflow Bwd Packets', 'Bwd Packet Length Min',
    'Init_Win_bytes_backward', 'Subflow Fwd Packets', 'Fwd IAT Max',
    'Fwd Header Length.1', 'Init_Win_bytes_forward', 'Total Fwd Packets',
    'Fwd IAT Std', 'act_data_pkt_fwd', 'Fwd Packet Length Max',
    'Fwd IAT Total', 'Subflow Fwd Bytes', 'Total Length of Fwd Packets',
    'Fwd Packet Length Mean', 'Avg Fwd Segment Size',
]

# One row per captured packet (engine input).
PACKET = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_s", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("pkt_len", T.IntegerType()),
    T.StructField("ip_ihl", T.IntegerType()),
    T.StructField("tcp_dataofs", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
])

# Scored prediction record (live path).
PREDICTION = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("dl_score", T.DoubleType()),
    T.StructField("ml_prob", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("pkt_len", T.IntegerType()),
])

ATTACK_TYPES = ["DDoS", "PortScan", "BruteForce", "SQLInject", "Other"]


def fcol(name: str) -> str:
    """Backtick-quote a column name holding '.', '/' or spaces."""
    return "`" + name.replace("`", "``") + "`"
