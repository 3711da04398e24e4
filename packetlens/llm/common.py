"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.session import checkpoint_dir, scratch_path, ship_package

# A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# A side is broadcast only if it was counted and holds at most so many rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Rows go to Python workers in Arrow batches of about so many bytes (Spark's default: 10,000 rows or 64 MB).
# A batch is held by the JVM, outside its heap, and by the worker, and the next beside it.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for the executors, bounded batches; safe to call again."""
    checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)


def bound_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to ``BATCH_BYTES``; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read, so lost executors
    never force the steps before it to run again. The folder is removed when
    the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes; null: 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        n = F.octet_length(value) + 8
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NumericType):
            n = F.size(value) * 8 + 8
        else:
            n = F.aggregate(value, F.lit(8).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        n = value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        n = sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        n = F.lit(8)
    return F.coalesce(n.cast("long"), F.lit(8).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it is counted to hold
    at most ``rows`` rows and ``most_bytes`` bytes; otherwise unchanged, for a
    shuffled join."""
    each = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words, null text: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """Every input column under one struct ``row``, so that an operator's own
    columns never clash with them; ``unpacked`` restores them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in columns])
