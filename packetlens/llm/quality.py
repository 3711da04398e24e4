"""Quality rules with adaptive thresholds (native).

Per document a fixed base rule, then rules whose limits come from the corpus: for
every (language, source) a mergeable quantile sketch of each metric gives a lower
and an upper quantile, and a value beyond ``upper + spread * (upper - lower)`` (for
some metrics also below the mirrored limit) rejects the document. Quartiles serve
metrics whose bulk varies; metrics that are 0 for nearly all documents, with a
thin tail of honest values, use the 99th percentile. In a group that hardly varies
the distance to the limit is a tenth of the quantile and ``ROOM`` thousandths, so
that trifles reject nothing; there are no other cutoffs.

The sketch of a metric is a log-linear histogram of its value in thousandths:
64 to 128 buckets per power of two, so a quantile is off by at most 1/64 of its
value. Buckets are integers made by shifts, so sketches merge by adding counts
and don't depend on how rows are dealt out. The limit of a small group leans on its
language's, and that on the corpus's: a limit of ``n`` documents has the weight ``n``,
the wider one the weight ``prior``.

Metrics of a document: word length, symbols per word, repeated lines per line,
repeated words per word, and the share of upper-case letters.

Defined results: null text has no words and fails the base rule, as does any
text of under ``min_words`` words; null language or source is a group of its
own; repeated rows are judged alike; an empty table gives an empty result;
texts of any length are read whole; the input's columns are kept under ``row``, so
none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packetlens.llm.common import let, materialise, packed, small, unpacked, words

_SPACE = " \t\n\x0b\f\r"
_WINDOW = 8

ROOM = 10  # thousandths

# metric: (numerator, denominator, upper quantile in hundredths, spread, both sides)
METRICS = {
    "word_length": ("word_chars", "n_words", 75, 4, True),
    "symbols": ("n_symbols", "n_words", 75, 4, False),
    "repeated_lines": ("n_dup_lines", "n_lines", 99, 1, False),
    "repeated_words": ("n_repeat_words", "n_words", 99, 1, False),
    "upper_case": ("n_upper", "word_chars", 75, 4, False),
}


def repeat_words(ws: Column) -> Column:
    """Words of the array that lie in an 8-word window found twice or more."""
    def of_windows(h: Column) -> Column:
        # (digest, start) in order: equal digests are neighbours
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, covered)).otherwise(F.lit(0))

    def covered(s: Column) -> Column:
        hash_at = lambda k: F.get(s, k)["h"]
        again = F.filter(s, lambda x, k: (x["h"] == hash_at(k + 1)) | ((k > 0) & (x["h"] == hash_at(k - 1))))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), union_length)

    def union_length(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda x, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(_WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    # a window's digest by doubling: of one word, then of two, four and eight
    def doubled(step: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    eight = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda one: let(
        doubled(1)(one), lambda two: let(doubled(2)(two), doubled(4))))
    windows = F.slice(eight, F.lit(1), F.size(ws) - (_WINDOW - 1))
    return F.when(F.size(ws) <= _WINDOW, F.lit(0)).otherwise(let(windows, of_windows)).cast("long")


def base_metrics(text: Column) -> Column:
    """Struct of the counts of one whole text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        (F.length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        repeat_words(ws).alias("n_repeat_words")))


def base_failed(m: Column, min_words: int = 20, max_repeat: int = 30) -> Column:
    return (m["n_words"] < min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * max_repeat)


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (input columns), ``lang``, ``source`` and ``m`` (the counts)."""
    null = F.lit(None).cast("string")
    col = lambda c: F.col("row")[c].cast("string") if c in docs.columns else null
    return packed(docs).select("row", col("lang").alias("lang"), col("source").alias("source"),
                               base_metrics(F.col("row")[text]).alias("m"))


def thousandths(m: Column, metric: str) -> Column:
    """The metric in thousandths, rounded down; null without a denominator."""
    top, bottom = METRICS[metric][:2]
    return F.when(m[bottom] > 0, F.floor(m[top] * 1000 / m[bottom]))


def bucket(v: Column) -> Column:
    """Least value of the bucket: exact below 128, then the seven leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, metric, b, n``: the counts of every sketch."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), thousandths(F.col("m"), k).alias("v")) for k in METRICS]))
    return (measured.select("lang", "source", values.alias("x")).where("x.v is not null")
            .groupBy("lang", "source", F.col("x.metric").alias("metric"), bucket(F.col("x.v")).alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def _by_metric(place: int) -> Column:
    """The parameter of the row's metric."""
    return F.element_at(F.create_map(*[x for k, v in METRICS.items() for x in (F.lit(k), F.lit(v[place]))]), F.col("metric"))


def _limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to ``keys``; of each, its quantiles (the least bucket that reaches
    the share), the limits ``lo`` and ``hi`` that they give, and its documents."""
    merged = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    ranked = merged.select("*", F.sum("n").over(w.orderBy("b")).alias("upto"), F.sum("n").over(w).alias("total"))
    reached = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("b")))
    q = ranked.groupBy(*keys, "metric").agg(reached(25).alias("lower"), reached(_by_metric(2)).alias("upper"), F.max("total").alias("total"))
    reach = lambda c: F.greatest((F.col("upper") - F.col("lower")) * _by_metric(3), F.expr(f"{c} div 10")) + ROOM
    return q.select("*", F.greatest(F.lit(0), F.col("lower") - reach("lower")).alias("lo"), (F.col("upper") + reach("upper")).alias("hi"))


def thresholds(sketch: DataFrame, prior: int = 20) -> DataFrame:
    """``lang, source`` and a struct of limits ``lo``, ``hi`` per metric."""
    whole = _limits(sketch.withColumn("all", F.lit(1)), ["all"]).drop("all")
    out = sketch.select("lang", "source", "metric").distinct()
    for name, df in (("own", _limits(sketch, ["lang", "source"])), ("wider", _limits(sketch, ["lang"])), ("whole", whole)):
        keys = [c for c in ("lang", "source", "metric") if c in df.columns]
        side = df.select(*[F.col(c).alias(f"{name}_{c}") for c in keys], F.struct("lo", "hi", "total").alias(name))
        out = out.join(side, [F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in keys], "left")

    def blended(end: str) -> Column:
        wider = f"((wider.{end} * wider.total + whole.{end} * {prior}) div (wider.total + {prior}))"
        return F.expr(f"(own.{end} * own.total + {wider} * {prior}) div (own.total + {prior})")

    limits = out.select("lang", "source", "metric", F.when(_by_metric(4), blended("lo")).alias("lo"), blended("hi").alias("hi"))
    return limits.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(
        F.struct("metric", F.struct("lo", "hi")))).alias("limits"))


def _inside(m: Column, limits: Column) -> Column:
    ok = F.lit(True)
    for k in METRICS:
        v, at = thousandths(m, k), F.get(F.array(F.try_element_at(limits, F.lit(k))), F.lit(0))
        ok = ok & F.coalesce((v <= at["hi"]) & (v >= F.coalesce(at["lo"], F.lit(-1))), F.lit(True))
    return ok


def judge(measured: DataFrame, prior: int = 20) -> DataFrame:
    """``measured`` (materialised) with ``base_failed`` and ``kept``."""
    passed = measured.select("lang", "source", "m").where(~base_failed(F.col("m")))
    limits = materialise(thresholds(sketches(passed), prior), "quality-limits")
    limits = small(limits, 10_000).select(F.col("lang").alias("l"), F.col("source").alias("s"), "limits")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    failed = base_failed(F.col("m"))
    kept = ~failed & F.coalesce(_inside(F.col("m"), F.col("limits")), F.lit(True))
    return joined.select("row", "m", failed.alias("base_failed"), kept.alias("kept"))


def quality_decisions(docs: DataFrame, **options) -> DataFrame:
    """One row per document with its counts and verdict; texts aren't carried."""
    measured = with_metrics(docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]))
    slim = materialise(measured.withColumn("row", F.col("row").dropFields("text")), "quality-metrics")
    return judge(slim, **options).select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of the input."""
    measured = materialise(with_metrics(docs), "quality-documents")
    return unpacked(judge(measured, **options).where("kept"), docs.columns)
