"""packetlens: network-flow intrusion detection expressed as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a column
expression) with the detection constants as keyword defaults, so the same
code runs in batch and, where Spark allows it, in Structured Streaming.
"""

from packetlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
