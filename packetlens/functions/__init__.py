"""Column-level functions (all JVM-side expressions)."""

from packetlens.functions.columns import *  # noqa: F401,F403
