"""Physical-plan checks: count exchanges, broadcasts and scans' pushed filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """Executed plan text (final adaptive plan after the query has run once)."""
    return df._jdf.queryExecution().executedPlan().toString()


def count_exchanges(df: DataFrame, kind: str = "hashpartitioning") -> int:
    return len(re.findall(rf"Exchange {kind}", physical_plan(df)))


def broadcast_joins(df: DataFrame) -> int:
    p = physical_plan(df)
    return p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def summary(df: DataFrame) -> dict:
    """Shuffle / broadcast / pushdown facts of a query's plan."""
    p = physical_plan(df)
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", p)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", p)),
        "single_partition_exchanges": p.count("Exchange SinglePartition"),
        "broadcast_joins": p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin"),
        "sort_merge_joins": p.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow\b", p)),
        "pushed_filters": re.findall(r"PushedFilters: \[([^\]]*)\]", p),
    }
