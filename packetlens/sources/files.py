"""File sources and sinks: labelled flow CSV, packet tables, model threshold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.operators.clean import valid_split
from packetlens.schemas import PACKET, fcol

CORRUPT = "_corrupt_record"


def dedupe_names(names: list[str]) -> list[str]:
    """Strip names and suffix repeats with .1, .2, ... (as pandas names them)."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        n = raw.strip()
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def flow_csv_schema(header: list[str], label: str = "Label") -> T.StructType:
    """All columns double except the label (string); names stripped and de-duplicated."""
    return T.StructType([T.StructField(n, T.StringType() if n == label else T.DoubleType())
                         for n in dedupe_names(header)])


def read_flow_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  label: str = "Label") -> DataFrame:
    """S1 + S2: labelled flow CSV with an explicit, position-based schema.

    Without a schema, only the header line is read to build one. Numbers that
    do not parse are null (the row's raw text is kept in ``_corrupt_record``
    for quarantine); ``Infinity`` / ``-Infinity`` / ``NaN`` read as doubles.
    """
    if schema is None:
        first = spark.read.text(path).limit(1).first()
        header = next(iter(__import__("csv").reader([first[0]])))
        schema = flow_csv_schema(header, label)
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full).option("header", True).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("positiveInf", "Infinity").option("negativeInf", "-Infinity")
            .csv(path))


def split_flow_csv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P7 for flow CSVs: (well-formed rows, malformed rows with their raw text and reason).

    The CSV reader judges a row by the fields it parses, which are those in use.
    The condition therefore refers to every column (any hash meets its bound).
    """
    all_read = F.hash(*[F.col(fcol(c)) for c in df.columns]) >= F.lit(-2**31)
    good, bad = valid_split(df, F.col(CORRUPT).isNull() & all_read)
    return good.drop(CORRUPT), bad


def write_flow_csv(df: DataFrame, path: str, pad: str = " ") -> None:
    """Write a flow table as CSV with header names padded like the published files."""
    df.toDF(*[pad + c for c in df.columns]).write.option("header", True).csv(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """S3: packet table (parquet) with the PACKET schema."""
    return spark.read.schema(PACKET).parquet(path)


def read_threshold(spark: SparkSession, path: str, default: float = 0.5) -> float:
    """``{"threshold": x}`` file -> float (one small JSON document)."""
    rows = spark.read.option("multiLine", True).json(path).select("threshold").limit(1).collect()
    return float(rows[0][0]) if rows else default


def write_threshold(spark: SparkSession, path: str, value: float) -> None:
    """The threshold as a JSON text file, as ``read_threshold`` reads it."""
    spark.createDataFrame([(threshold_json(value),)], "value string").coalesce(1).write.text(path)


def threshold_json(value: float) -> str:
    return json.dumps({"threshold": value})


def write_scores(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S5 (batch): scored rows to parquet, optionally partitioned (e.g. by day)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


__all__ = ["read_flow_csv", "write_flow_csv", "flow_csv_schema", "dedupe_names", "read_packets",
           "read_threshold", "write_threshold", "threshold_json", "write_scores"]
