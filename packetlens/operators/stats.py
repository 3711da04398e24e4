"""Exact quantiles, classification metrics and error attribution, distributed.

No step gathers a whole column in one task or on the driver:

* ``exact_quantile`` reads the values twice: a mergeable quantile sketch (KLL) gives a
  narrow band around the rank, then one pass counts what lies below the band and
  ranks the distinct values inside it. If the sketch missed, the band is widened, so
  the result is exact; only two numbers reach the driver.
* ``evaluate_all`` reads the scored rows of any number of models once: one grouped
  histogram (model, score) holds the confusion counts and gives the areas under the
  curves, with a two-level prefix sum: bucket totals (a few thousand rows) and a
  window inside each bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.schemas import fcol


def _finite(c: Column) -> Column:
    from packetlens.functions.columns import is_finite
    return is_finite(c)


def _materialise(x: DataFrame, name: str) -> DataFrame:
    """Write the single value column once to the shared checkpoint folder; the
    selection rounds then scan it (with range filters pushed to parquet)
    instead of recomputing the upstream job, and survive executor loss."""
    from packetlens.session import scratch_path
    path = scratch_path(x.sparkSession, name)
    x.write.parquet(path)
    return x.sparkSession.read.parquet(path)


def _band(x: DataFrame, at: float, eps: float, size: int) -> tuple:
    """Rows, least and greatest value, and values about ``eps`` (a share of the rows)
    below and above the rank ``at``: one pass."""
    k = F.lit(size)
    sketched = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("z"), F.kll_sketch_agg_double("x", k).alias("s"))
    lo = F.col("a") if at <= eps else F.kll_sketch_get_quantile_double("s", F.lit(at - eps))
    hi = F.col("z") if at + eps >= 1 else F.kll_sketch_get_quantile_double("s", F.lit(at + eps))
    return tuple(sketched.select("n", "a", "z", F.when(F.col("n") > 0, lo), F.when(F.col("n") > 0, hi)).first())


def _ranked_inside(x: DataFrame, lo: float, hi: float, ranks: list[int]) -> list[float] | None:
    """The values at the 0-based ``ranks`` if they lie in ``lo .. hi``, else None: one pass
    that counts what is below the band and each distinct value inside."""
    cells = (x.where(F.col("x") <= hi).groupBy(F.when(F.col("x") >= lo, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    # the band's distinct values alone come together here; null (below) sorts first
    upto = F.sum("c").over(Window.orderBy(F.col("v").asc_nulls_first()))
    run = cells.select("v", upto.alias("upto"), (upto - F.col("c")).alias("before"))
    hit = lambda k: F.min(F.when((F.col("before") <= k) & (F.col("upto") > k), F.col("v")))
    got = run.where("v is not null").agg(*[hit(k).alias(f"r{i}") for i, k in enumerate(ranks)]).first()
    return None if None in tuple(got) else [float(v) for v in got]


def exact_quantile(df: DataFrame, col: str, q: float, with_count: bool = False, max_local: int = 2_000_000, bins: int = 4096):
    """Linear-interpolation quantile (``percentile`` / ``quantile_cont``), exact.

    ``bins`` is the sketch's size, which sets the width of the band. A band of more than
    ``max_local`` rows is sketched again before its values are ranked."""
    x = _materialise(df.select(F.col(fcol(col)).cast("double").alias("x")).where(_finite(F.col("x"))),
                     "quantile-values")
    size = max(8, min(bins, 65_535))
    eps = 3 * 2.3 / size ** 0.9      # three times the sketch's usual error in rank
    n, least, most, lo, hi = _band(x, q, eps, size)
    if n == 0:
        return (None, 0) if with_count else None
    pos = q * (n - 1)
    k = int(math.floor(pos))
    ranks = [k, k + 1] if (pos != k and k + 1 < n) else [k]
    width, rows = eps, 2 * eps * n
    while rows > max_local and lo < hi:
        below = x.where(F.col("x") < lo).count()
        inside = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        m, _, _, a, z = _band(inside, min(max((k - below) / max(inside.count(), 1), 0.0), 1.0), eps, size)
        if (a, z) == (lo, hi):
            break
        lo, hi, rows = a, z, 2 * eps * m
    while (got := _ranked_inside(x, lo, hi, ranks)) is None:
        width *= 4       # the sketch missed: a wider band, in the end all values
        lo, hi = _band(x, q, width, size)[3:] if width < 1 else (least, most)
    value = got[0] if len(got) == 1 else got[0] + (pos - k) * (got[1] - got[0])
    return (value, n) if with_count else value


def calibrate_threshold(errors: DataFrame, err: str = "dl_error", q: float = 0.9,
                        benign: str | None = None) -> DataFrame:
    """One-row table with the q-quantile of the (benign) errors."""
    src = errors.where(F.col(benign)) if benign else errors
    v, n = exact_quantile(src, err, q, with_count=True)
    spark = errors.sparkSession
    return spark.createDataFrame([(v, n)], "threshold double, n bigint")


def _histogram(df: DataFrame, truth: str, prediction: str | None, score: str | None, by: list[str]) -> DataFrame:
    """One row for each ``by`` and distinct score with its counts, written once: the
    only pass over the scored rows. A hot score collapses in the partial aggregate."""
    from packetlens.session import write_once
    t = F.col(truth) == 1
    p = F.col(prediction) == 1 if prediction else F.lit(None).cast("boolean")
    s = F.col(score).cast("double") if score else F.lit(None).cast("double")
    n = lambda c: F.sum(c.cast("long"))
    return write_once(df.groupBy(*by, s.alias("s")).agg(
        F.count(F.lit(1)).alias("n"), n(t & p).alias("tp"), n(~t & p).alias("fp"), n(~t & ~p).alias("tn"), n(t & ~p).alias("fn"),
        F.sum(F.col(truth).cast("long")).alias("pos"), F.sum((1 - F.col(truth)).cast("long")).alias("neg")), "score-histogram")


def _areas(cells: DataFrame, by: str, buckets: int) -> dict:
    """Area under each model's ROC curve (ties count one half), exact, from its histogram."""
    cells = cells.where(F.col("s").isNotNull())
    probs = [i / buckets for i in range(1, buckets)]
    facts = cells.groupBy(by).agg(F.percentile_approx("s", probs, 10 * buckets).alias("q"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()
    bucket, areas = F.lit(None).cast("double"), {}
    for i, r in enumerate(facts):    # a row a model
        areas[r[by]] = None
        splits = [float("-inf")] + sorted({float(v) for v in r["q"]}) + [float("inf")]
        cells = Bucketizer(splits=splits, inputCol="s", outputCol=f"_b{i}").transform(cells)
        bucket = F.when(F.col(by).eqNullSafe(F.lit(r[by])), F.col(f"_b{i}")).otherwise(bucket)
    b = cells.withColumn("b", bucket)
    per_bucket = b.groupBy(by, "b").agg(F.sum("neg").alias("bn"))
    # bounded: at most `buckets` rows a model
    earlier = Window.partitionBy(by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(F.col(by).alias("_m"), F.col("b").alias("_k"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("base"))
    w = Window.partitionBy(by, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    run = b.join(F.broadcast(before), F.col(by).eqNullSafe(F.col("_m")) & (F.col("b") == F.col("_k"))).withColumn(
        "below", F.col("base") + F.coalesce(F.sum("neg").over(w), F.lit(0)))
    won = {r[by]: r["u"] for r in run.groupBy(by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)).alias("u")).collect()}
    return areas | {r[by]: float(won[r[by]]) / (float(r["P"]) * float(r["N"])) for r in facts if r["P"] and r["N"]}


def auc(df: DataFrame, truth: str = "truth", score: str = "score", buckets: int = 1024) -> float | None:
    """Area under the ROC curve (ties count one half), exact."""
    cells = _histogram(df.withColumn("_all", F.lit(0)), truth, None, score, ["_all"])
    return _areas(cells, "_all", buckets).get(0)


def _metrics(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts and ratios from the histogram, one row for each ``by``."""
    c = cells.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(k).alias(k) for k in ("tp", "fp", "tn", "fn")])
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return c.select(
        *by, "n", "tp", "fp", "tn", "fn",
        F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.try_divide(2 * prec * rec, prec + rec).alias("f1"))


def evaluate(df: DataFrame, truth: str = "truth", prediction: str = "prediction",
             score: str | None = "score") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and AUC in one row."""
    cells = _histogram(df.withColumn("_all", F.lit(0)), truth, prediction, score, ["_all"])
    a = _areas(cells, "_all", 1024).get(0) if score else None
    return _metrics(cells, []).withColumn("auc", F.lit(a).cast("double"))


def evaluate_all(df: DataFrame, model: str = "model", truth: str = "truth", prediction: str = "prediction",
                 score: str = "score") -> DataFrame:
    """M14 for every model of a long table (model, truth, prediction, score): a row each."""
    cells = _histogram(df, truth, prediction, score, [model])
    areas = _areas(cells, model, 1024)
    a = F.lit(None).cast("double")
    for name, value in areas.items():
        a = F.when(F.col(model).eqNullSafe(F.lit(name)), F.lit(value).cast("double")).otherwise(a)
    return _metrics(cells, [model]).withColumn("auc", a)


def error_share_topk(df: DataFrame, residuals: list[str], k: int = 3,
                     keep: list[str] | None = None) -> DataFrame:
    """Per row, the k features with the largest share of the squared error.

    ``residuals`` are per-feature residual columns (x - reconstruction); the
    share is r^2 / sum(r^2) (0 when the row has no error). Ties are broken by
    feature name. One output row per (input row, rank).
    """
    keys = [F.col(fcol(c)) for c in (keep or [])]
    # squares and their sum are columns: inside the shares' conditions every share would add them up anew
    df = df.select(*keys, F.array(*[F.col(fcol(c)) * F.col(fcol(c)) for c in residuals]).alias("_sq"))
    df = df.withColumn("_total", F.aggregate("_sq", F.lit(0.0), lambda a, v: a + v))
    sq, total = [F.col("_sq")[i] for i in range(len(residuals))], F.col("_total")
    # (0 - share, name) ascending = share descending, ties by name; built-in
    # sort_array, no lambda comparator in the per-row path.
    items = F.array(*[F.struct(
        (F.lit(0.0) - F.coalesce(F.try_divide(s, total), F.lit(0.0))).alias("neg"),
        F.lit(c).alias("feature")) for s, c in zip(sq, residuals)])
    ranked = F.slice(F.sort_array(items, asc=True), 1, k)
    out = df.select(*keys, F.posexplode(ranked).alias("pos", "item"))
    return out.select(*keys, (F.col("pos") + 1).alias("rank"),
                      F.col("item.feature").alias("feature"),
                      (F.lit(0.0) - F.col("item.neg")).alias("share"))
