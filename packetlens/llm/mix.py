"""Mixing sources to target weights along a time-varying curriculum.

1. Targets: a source's share of the token budget follows the integral of its
   weight schedule over training; targets stop at ``max_epochs`` times the
   source's size and the excess goes to the others by weight (water filling,
   solved in closed form over the per-source totals).
2. Order within a source: by a hash of the row, read as a chain of copies
   (first all first copies, then all second ones). A document's place in the
   chain is a prefix sum of sizes in two levels: within (source, hash bucket),
   and over the bucket totals. Buckets hold about sqrt(rows of the source)
   documents, so neither level grows faster than that and a source with a third
   of all rows is spread over its buckets.
3. Cut: whole documents are taken from the chain up to the target; then the one
   document of the last pass that closes the remaining gap best.
4. Positions: the cumulative demand of a source up to time t is its target times
   the integral of its schedule up to t. Inverting it at the middle of a copy's
   words gives that copy's position in [0, 1]; sorting all copies by position
   gives the training order.

Defined results: null text has size 0; a null source is a source of its own,
last in order; empty sources get target 0; documents of size 0 are never taken;
repeated rows are documents like any other (in the mixed corpus their copies
carry the columns of one of them); texts of any length are counted whole; the
input's columns are kept under ``row``, so none can clash; an empty table gives an
empty result. Everything is computed from row contents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packetlens.llm.common import materialise, n_words, packed, small, unpacked

# Weight over time as (time, weight) knots, linear in between. Each schedule's
# mean is the weight that the mix asks for: the heaviest sources start strong
# and fade, the lightest ones rise.
SCHEDULES = {
    5.0: [(0.0, 7.0), (1.0, 3.0)],
    2.0: [(0.0, 2.0), (1.0, 2.0)],
    1.0: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
}


def integrate(knots: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float, float, float, float]]]:
    """Total integral, and per piece: its start and end time, weight at its
    start, slope, and the share of the integral before it."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), before))
        before += (t1 - t0) * (w0 + w1) / 2
    return before, pieces


def order_key(key: Column, text: Column) -> Column:
    """60 hash bits of a row: the order of its source's chain."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), text), 256), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``source, source_size, docs, weight, target`` from rows of ``source, size``.

    One row per source: the windows below run over the list of sources, which a
    mix always names one by one.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(w) for w in weights])
    per = per.select("*", F.get(table, at % len(weights)).alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    # Water filling: by rising cap / weight, a source is capped while its cap is
    # at most its share of what the capped ones before it leave.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select("*",
                     (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_tokens"),
                     (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"))
    per = per.withColumn("free", F.col("cap") * F.col("left_weight") > F.col("weight") * F.col("left_tokens"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("left_tokens").alias("t"),
                                                 F.col("left_weight").alias("w")))).over(whole)
    per = per.withColumn("first", first)
    target = F.when(F.col("free"), F.col("weight") * F.col("first.t") / F.col("first.w")).otherwise(F.col("cap"))
    return per.select("source", "source_size", "docs", "weight", target.alias("target"))


def _invert(share: Column, weight: Column, schedules: dict[float, list[tuple[float, float]]]) -> Column:
    """Time at which the source has asked for ``share`` of its whole demand."""
    out = F.lit(None).cast("double")
    for w, knots in schedules.items():
        total, pieces = integrate(knots)
        asked = share * F.lit(total)
        time = F.lit(float(knots[-1][0]))
        for t0, t1, w0, slope, before in reversed(pieces):
            rest = F.greatest(asked - before, F.lit(0.0))
            # w0 * d + slope / 2 * d * d = rest
            d = rest * 2 / (w0 + F.sqrt(F.greatest(rest * (2 * slope) + w0 * w0, F.lit(0.0))))
            time = F.when(asked < before + (t1 - t0) * (2 * w0 + slope * (t1 - t0)) / 2, d + t0).otherwise(time)
        out = F.when(weight == w, time).otherwise(out)
    return out


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             schedules: dict[float, list[tuple[float, float]]] | None = None, share: float = 1.5,
             max_epochs: int = 2, bucket_rows: int = 2048) -> DataFrame:
    """One row per document: ``id, h, source, size, source_size, target, taken,
    copies, positions`` (one position per copy, in [0, 1])."""
    schedules = schedules or SCHEDULES
    weights = list(schedules)
    slim = materialise(docs.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        order_key(F.col(key), F.col(text)).alias("h")), "mix-sizes")
    sources = materialise(source_targets(slim, weights, share, float(max_epochs)), "mix-sources")
    buckets = F.ceil(F.col("docs") / F.greatest(F.lit(float(bucket_rows)), F.sqrt("docs"))).cast("long")
    facts = small(sources, 10_000).select(F.col("source").alias("s"), "source_size", "weight", "target", buckets.alias("buckets"))
    rows = slim.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the hash's upper 32 bits scaled to the bucket count: buckets follow the hash order
    high = F.shiftright("h", 28)
    rows = rows.withColumn("bucket", F.shiftright(high * F.col("buckets"), 32))

    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                           F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    starts = small(materialise(starts, "mix-buckets"), 100_000)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    # whole passes over the source, then a part of one
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - full * F.col("source_size")
    placed = materialise(placed.select("*", full.alias("full"), rest.alias("rest"),
                                       (F.col("start") + F.col("size") <= rest).alias("in_part")), "mix-placed")
    # the one document beyond the part's end that closes the gap best, if any does
    part = placed.groupBy("source").agg(F.sum(F.when(F.col("in_part"), F.col("size")).otherwise(0)).alias("got"))
    part = small(part.select(F.col("source").alias("s"), "got"), 10_000)
    spare = (placed.where("not in_part and size > 0").join(part, F.col("source").eqNullSafe(F.col("s")))
             .withColumn("miss", F.abs(F.col("rest") - F.col("got") - F.col("size")))
             .where(F.col("miss") < F.col("rest") - F.col("got")))
    closer = spare.groupBy("source").agg(F.min(F.struct("miss", "start", "h", "id")).alias("c"))
    closer = small(materialise(closer.select(F.col("source").alias("s"), "c"), "mix-closer"), 10_000)
    joined = placed.join(closer, F.col("source").eqNullSafe(F.col("s")), "left")
    is_closer = F.coalesce((F.col("start") == F.col("c.start")) & (F.col("h") == F.col("c.h"))
                           & F.col("id").eqNullSafe(F.col("c.id")), F.lit(False))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.col("full") + F.when(F.col("in_part") | is_closer, 1).otherwise(0)).cast("int")
    out = joined.withColumn("copies", copies)
    # the middle of copy k, as a share of the source's demand
    middle = lambda k: F.least((F.col("start") + F.col("size") / 2 + k * F.col("source_size")) / F.col("target"), F.lit(1.0))
    positions = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _invert(middle(k), F.col("weight"), schedules)))
    return out.select("id", "h", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "copies", F.coalesce(positions, F.array().cast("array<double>")).alias("positions"))


def training_order(copies: DataFrame, position: str = "position", tie: str = "id") -> DataFrame:
    """Rows (one per copy) in the order of training: ranges over all partitions, sorted inside."""
    return copies.repartitionByRange(F.col(position), F.col(tie)).sortWithinPartitions(position, tie)


def mix_decisions(docs: DataFrame, **options) -> DataFrame:
    """One row per document, in the order of its first position (documents that
    the mix leaves out come last)."""
    out = plan_mix(docs, **options)
    first = F.when(F.col("copies") > 0, F.get("positions", F.lit(0))).otherwise(F.lit(2.0))
    return training_order(out.select(
        F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken", "copies", "positions",
        first.alias("first_position")), "first_position", "doc_id")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mixed corpus: a document once per copy, in training order, with the columns of the input."""
    plan = plan_mix(docs, key=key, text=text, **options).where("copies > 0").select("id", "h", "positions")
    plan = materialise(plan, "mix-plan")
    row = packed(docs).select("row", F.col("row")[key].alias("k"), order_key(F.col("row")[key], F.col("row")[text]).alias("rh"))
    # equal rows have equal keys: of such rows one is kept and joined to the plan's rows of them all
    repeated = materialise(plan.groupBy("id", "h").count().where("count > 1").select("id", "h"), "mix-repeated")
    of = lambda left, right: left.eqNullSafe(right)

    def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        joined = rows.join(small(plan), of(F.col("k"), F.col("id")) & (F.col("rh") == F.col("h")))
        return joined.select("row", "id", F.explode("positions").alias("position"))

    if repeated.isEmpty():
        out = placed(row, plan)
    else:
        again = small(repeated.select(F.col("id").alias("i"), F.col("h").alias("g")))
        in_rows, in_plan = of(F.col("k"), F.col("i")) & (F.col("rh") == F.col("g")), of(F.col("id"), F.col("i")) & (F.col("h") == F.col("g"))
        once = row.join(again, in_rows, "left_semi").dropDuplicates(["k", "rh"])
        out = placed(row.join(again, in_rows, "left_anti"), plan.join(again, in_plan, "left_anti")).unionByName(
            placed(once, materialise(plan.join(again, in_plan, "left_semi"), "mix-repeated-plan")))
    return unpacked(training_order(out), docs.columns)
