"""Feature projection, imputation and row cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.functions.columns import is_finite
from packetlens.schemas import FEATURES, fcol


def drop_label(df: DataFrame, label: str = "Label") -> DataFrame:
    """P6."""
    return df.drop(label)


def feature_projection(df: DataFrame, keep: list[str] | None = None,
                       features: list[str] = FEATURES, fill_nulls: bool = True) -> DataFrame:
    """The model columns in model order, as double.

    Unknown columns are dropped, missing ones are 0.0, nulls and values that
    do not parse as numbers are 0.0 (null without ``fill_nulls``, for P5 to drop).
    ``keep`` columns (row ids) are carried.
    """
    have = set(df.columns)
    cols = []
    for name in features:
        if name in have:
            c = F.col(fcol(name)).try_cast("double")
            c = F.coalesce(c, F.lit(0.0)) if fill_nulls else c
        else:
            c = F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*[F.col(fcol(k)) for k in (keep or [])], *cols)


def impute_nonfinite(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """+-inf, NaN and null -> 0.0 (the live scorer's cleaning)."""
    return df.withColumns({c: F.when(is_finite(F.col(fcol(c))), F.col(fcol(c))).otherwise(F.lit(0.0))
                           for c in columns})


def drop_nonfinite(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """P5: drop rows with any +-inf / NaN / null in ``columns`` (the batch scorer's cleaning).

    Row identity columns stay attached, so outputs remain aligned with inputs.
    """
    cond = F.lit(True)
    for c in columns:
        cond = cond & is_finite(F.col(fcol(c)))
    return df.where(cond)


def valid_split(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with a reason) instead of silent drops."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", F.lit("malformed"))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows by an explicit order."""
    return df.orderBy(*[F.col(fcol(c)) for c in order]).limit(n)
