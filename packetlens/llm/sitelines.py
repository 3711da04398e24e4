"""Line dedup by site-relative frequency (native).

A line of a page is boilerplate if more than ``ratio`` of its host's pages contain it,
and at least ``least`` of them. Pages are told apart by their whole text (SHA-256), so copies of
one page are one page and don't make its lines boilerplate. Lines are compared
after trimming ASCII white space, by the first 16 bytes of their SHA-256; lines
without a word are never counted or dropped.

Plan: a page is reduced to its distinct line digests, one row a (host, page), with
map-side combining, and written once. The digests are counted per ``(host, line)``,
again combined before the shuffle, so a line on a third of all pages costs one row
a task. A host's boilerplate has at most ``lines per page / ratio`` lines (each
fills more than ``ratio`` of its pages), which bounds the one array per host that goes
back to its pages; it is broadcast only if the arrays' counted bytes allow it.

Defined results: null text stays null with no lines, and all null texts of a host are
one page; a null host is a host of its own; in hosts of fewer than ``least`` different
pages every line stays; a line repeated inside a page counts once for that page and
all its occurrences go; repeated rows are judged alike; texts of any length are
read whole; a page of boilerplate alone becomes empty and stays a row; the input's columns are kept
under ``row``, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import materialise, packed, small, unpacked

_BLANK = " \t\n\x0b\f\r"


def _digest(line: Column) -> Column:
    """16-byte digest of the trimmed line; null if it has no word."""
    trimmed = F.btrim(line, F.lit(_BLANK))
    return F.when(trimmed != "", F.substring(F.unhex(F.sha2(trimmed, 256)), 1, 16))


def _digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), _digest)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least: int) -> DataFrame:
    """``host, pages, lines``: per host its number of different pages and the
    digests of the lines found on more than ``ratio`` of them (and on ``least``)."""
    src = pages.select(F.col(host).alias("host"), F.col(text).alias("body"))
    digests = F.array_distinct(F.filter(_digests(F.col("body")), lambda d: d.isNotNull()))
    page = F.substring(F.unhex(F.sha2(F.col("body"), 256)), 1, 16)
    once = materialise(src.select("host", page.alias("page"), digests.alias("lines")).groupBy("host", "page")
                       .agg(F.any_value("lines").alias("lines")), "site-pages")
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = materialise(once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-pages")
    totals = small(totals.where(F.col("pages") >= least))
    # the join drops nearly all rows before the last aggregate
    common = (counts.where(F.col("n") >= least).alias("c")
              .join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
              .where(F.col("n") > F.col("pages") * F.lit(ratio)))
    return common.groupBy("c.host", "pages").agg(F.collect_list("line").alias("lines"))


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text",
                    ratio: float = 0.01, least: int = 5) -> DataFrame:
    """``row`` (the input row), ``cleaned`` (text without boilerplate lines),
    ``n_lines`` and ``n_dropped`` for every input row."""
    common = materialise(boilerplate(pages, host, text, ratio, least), "site-lines")
    joined = packed(pages).alias("p").join(
        small(common).alias("b"), F.col("p.row")[host].eqNullSafe(F.col("b.host")), "left")
    body = F.col("row")[text]
    keep = F.filter(F.split(body, "\n"),
                    lambda x: ~F.coalesce(F.array_contains(F.col("lines"), _digest(x)), F.lit(False)))
    n = F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n"))).cast("long")
    kept = F.when(F.col("lines").isNull(), F.when(body.isNotNull(), F.split(body, "\n"))).otherwise(keep)
    return (joined.select("row", n.alias("n_lines"), kept.alias("kept_lines"))
            .select("row", F.array_join("kept_lines", "\n").alias("cleaned"), "n_lines",
                    (F.col("n_lines") - F.coalesce(F.size("kept_lines"), F.lit(0))).cast("long").alias("n_dropped")))


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with their text replaced by the cleaned one (same columns)."""
    text = options.get("text", "text")
    out = drop_site_lines(docs, **options)
    row = F.col("row").withField(text, F.col("cleaned"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.length("cleaned").cast(kind))
                            .otherwise(F.col("row")["n_chars"]))
    return unpacked(out.select(row.alias("row")), docs.columns)
