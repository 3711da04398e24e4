"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "packetlens", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and skew-join handling on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Sessions reused from a caller keep their own settings; pin the time
    # zone because event-time buckets and `ts_s` depend on it.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``packetlens`` importable in the Python workers (executors).

    Python-backed operators (the stateful streaming flow tracker) pickle
    references to this package; workers started elsewhere cannot import it
    from the driver's ``sys.path``. The package is zipped once per session in
    the driver's own scratch folder; ``addPyFile`` sends it to the executors.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_packetlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    dest = os.path.join(tempfile.mkdtemp(prefix="packetlens-zip-"), f"packetlens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(dest, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(dest)
    sc._packetlens_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names, or what was
    given to ``setCheckpointDir`` (a shared file system). Only in local mode,
    when neither is set, a private folder under the system temp dir is created
    and registered; elsewhere that is an error, as executors couldn't see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="packetlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one job's output."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def write_once(df, name: str, **options):
    """Write ``df`` to a fresh folder of the shared checkpoint folder and read it
    back: later passes read the files, and lost executors repeat one step only.
    The folder is removed when the session's JVM ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def cluster_settings(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized from the input volume (apply with ``get_spark(extra=...)``).

    Shuffle partitions target ~256 MB each (at least 2 per core), so window
    and aggregate partitions fit in executor memory; AQE coalesces small
    ones and splits skewed join partitions above 5x the median.
    """
    cores = executors * cores_per_executor
    parts = max(2 * cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
