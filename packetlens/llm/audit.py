"""Source divergence audit as an Arrow compute pipeline.

How far do the sources of a language differ in their words, and which words stand
out in a source? Three steps:

1. partial counts, inside ``mapInArrow`` and with Arrow kernels alone:
   ``ascii_lower``, ``split_pattern_regex`` on what isn't part of a term,
   ``dictionary_encode``, then a hash ``group_by`` of (text, term) and one of
   (language, source, term), which gives occurrences and documents. A task merges
   its tables as it goes and hands on what exceeds ``MERGE_ROWS`` rows;
2. one shuffle by (language, term) merges them into columnar shards: Parquet rows
   of a term with the counts of its sources, kept if ``min_docs`` documents of the
   language hold the term. A term on a third of all rows arrives as one row a
   source and task, and its row holds at most one entry a source;
3. divergences: each task lays blocks of its terms out as a (source, term) matrix of
   smoothed probabilities and sums absolute differences of sources, and keeps each
   source's largest excesses over the language. Sums of tasks are added; the tasks'
   largest are ranked once more.

All arithmetic is on integers: a probability is in billionths, rounded down by
long division in three steps of a thousand, which is exact while a language
has under 9.2e15 terms. The groups with their totals go to every task: as many
rows as there are (language, source) groups, the square root of the pairs that the
result lists for them; a task's sums need 8 bytes a pair.

Defined results: null text, language and source read as ''; a language of one
source has no ``pair`` rows; a language without kept terms has pairs of value 0
and no ``term`` rows; repeated rows are documents like any other; texts of any length
are read whole (up to ``SLICE_BYTES`` of texts at a time, or one text); ties are
ranked by the item's UTF-8 bytes; an empty table gives an empty result; other
columns of the input are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from packetlens.llm.common import materialise

# What separates terms: ASCII other than letters.
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMOOTHING = 5
SLICE_BYTES = 4 << 20  # texts split at once
MERGE_ROWS = 400_000  # partial counts a task holds before it hands them on
_BLOCK = 1 << 20  # cells of a (source, term) matrix


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``SLICE_BYTES`` of text, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _counted(rows: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of a few texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(rows.column(2)), pattern=NOT_TERM)
    found = pa.table({"text": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
    found = found.filter(pc.not_equal(found["term"], ""))
    encoded = pc.dictionary_encode(found["term"].combine_chunks())
    by_text = pa.table({"text": found["text"], "term": encoded.indices}).group_by(["text", "term"]).aggregate([([], "count_all")])
    at = by_text["text"]
    groups = pa.table({"lang": rows.column(0).take(at.combine_chunks()), "source": rows.column(1).take(at.combine_chunks()),
                       "term": by_text["term"], "n": by_text["count_all"]})
    out = groups.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({"lang": out["lang"], "source": out["source"], "term": encoded.dictionary.take(out["term"].combine_chunks()),
                     "n": out["n_sum"], "docs": out["n_count"]})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch, 2):
            held.append(_counted(part))
            rows += held[-1].num_rows
            if rows > MERGE_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > MERGE_ROWS // 2:
                    yield from held[0].to_batches(64_000)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(64_000)


def term_shards(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """``lang, term, counts``: each kept term with its (source, n) in the language."""
    parts = docs.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    merged = (parts.repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (merged.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.collect_list("source").alias("sources"), F.collect_list("n").alias("counts"))
            .where(F.col("docs") >= min_docs).drop("docs"))


def billionths(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * count / total)`` for ``0 <= count <= total < 9.2e15``."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


class Language:
    """One language's sources, and the sums and largest excesses of a task."""

    def __init__(self, sources: list[str], totals: list[int], terms: int, top: int):
        self.sources, self.terms, self.top = pa.array(sources, pa.string()), terms, top
        self.totals = np.array(totals, np.int64)
        self.sums = np.zeros((len(sources), len(sources)), np.int64)
        self.largest: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> None:
        step = max(1, _BLOCK // len(self.sources))
        for at in range(0, len(terms), step):
            self.add_block(terms.slice(at, step), sources.slice(at, step), counts.slice(at, step))

    def add_block(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> None:
        n = np.zeros((len(self.sources), len(terms)), np.int64)
        column = pc.list_parent_indices(sources).to_numpy(zero_copy_only=False)
        row = pc.index_in(pc.list_flatten(sources), value_set=self.sources).to_numpy(zero_copy_only=False)
        n[row, column] = pc.list_flatten(counts).to_numpy(zero_copy_only=False)
        own = billionths(n + SMOOTHING, (self.totals + SMOOTHING * self.terms)[:, None])
        overall = billionths(n.sum(axis=0) + SMOOTHING, self.totals.sum() + SMOOTHING * self.terms)
        excess = np.where(n > 0, own - overall, 0)
        for i in range(len(own)):
            if i + 1 < len(own):
                self.sums[i, i + 1:] += np.abs(own[i + 1:] - own[i]).sum(axis=1)
            self.keep_largest(i, excess[i], terms)

    def keep_largest(self, i: int, excess: np.ndarray, terms: pa.Array) -> None:
        best = self.largest[i]
        least = -best[-1][0] if len(best) >= self.top else 1
        at = np.flatnonzero(excess >= least)
        if len(at) > self.top:
            at = at[excess[at] >= np.partition(excess[at], -self.top)[-self.top]]  # ties stay
        if len(at):
            named = terms.take(pa.array(at)).to_pylist()
            best = sorted([*best, *((-int(excess[k]), t.encode()) for k, t in zip(at, named))])
            self.largest[i] = best[:self.top]


def _divergences(groups: dict[str, tuple[list[str], list[int], int]], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Language] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                rows = batch.filter(pc.equal(batch.column(0), lang))
                if lang not in held:
                    held[lang] = Language(*groups[lang], top)
                held[lang].add(rows.column(1), rows.column(2), rows.column(3))
        for lang, x in held.items():
            names = x.sources.to_pylist()
            for i, source in enumerate(names):
                part = ["pair"] * (len(names) - 1 - i) + ["term"] * len(x.largest[i])
                items = names[i + 1:] + [t.decode() for _, t in x.largest[i]]
                values = [*x.sums[i, i + 1:].tolist(), *(-v for v, _ in x.largest[i])]
                if part:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part),
                         pa.array(items, pa.string()), pa.array(values, pa.int64())],
                        names=["lang", "source", "part", "item", "value"])
    return run


def source_divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                       min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has a row for each
    other source of the language, part ``term`` the ``top`` terms of largest excess."""
    spark = docs.sparkSession
    src = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                        for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    shards = materialise(term_shards(src, min_docs).select("lang", "term", "sources", "counts"), "audit-shards")

    entries = shards.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    totals = entries.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    kept = shards.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = materialise(src.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
                         .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")),
                         "audit-groups")
    by_lang: dict[str, tuple[list[str], list[int], int]] = {}
    for r in groups.orderBy("lang", "source").collect():  # as many rows as groups
        known = by_lang.setdefault(r.lang, ([], [], r.terms))
        known[0].append(r.source)
        known[1].append(r.total)

    found = shards.mapInArrow(_divergences(by_lang, top), "lang string, source string, part string, item string, value long")
    found = materialise(found, "audit-parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    # languages without a kept term have no shard: their sources differ by 0
    bare = groups.where("terms = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.unionByName(zero).select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", place.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
