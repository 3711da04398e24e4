"""URL filter by a Bloom filter cascade over the corpus's hosts (native).

Level 1 holds the listed keys; level 2 the unlisted keys of the corpus that
level 1 lets through; level 3 the listed keys that level 2 lets through; and so
on until no false positive is left. A key of the universe is listed if the
first level that rejects it is an even one (or, if none does, the number of
levels is odd). The answer is exact for every key of the universe, and judging
a page is a handful of bit tests on array literals: no join, no list of keys.

A filter is an array of 64-bit words made with ``bit_or`` over (word, mask)
rows. It grows with the number of *listed* keys (``bits_per_key`` each) and not
with the corpus; beyond ``max_bits`` a filter isn't sent to every task and the
same question is answered by a left join on the key instead.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged like the key ''; null keys of a list list nothing; repeated rows are judged alike; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import materialise, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``host/path`` as written: fits the host, its subdomains and urls whose
    path starts with the rule's."""
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest ends outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` is a one-row frame with an array of 64-bit words."""
    words: DataFrame
    bits: int
    hashes: int
    seed: int


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits)) for i in range(hashes)]


def _build(keys: DataFrame, n: int, seed: int, bits_per_key: int, hashes: int) -> Level:
    bits = max(64, -(-n * bits_per_key // 64) * 64)
    at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    parts = keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(mask).alias("mask"))
    # a dense array of bits / 64 entries, bounded by max_bits: the parts and a zero for
    # every word are added up and laid out in order, in time linear in the words
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    every = parts.unionByName(zeros).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    laid = every.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w"))
    words = laid.select(F.col("w.mask").alias("words"))
    return Level(materialise(words, "bloom-level"), bits, hashes, seed)


def _passes(key: Column, level: Level) -> Column:
    """Whether the filter lets the key through."""
    words = level.words.scalar()
    test = F.lit(True)
    for at in _positions(key, level.bits, level.hashes, level.seed):
        test = test & (F.getbit(F.get(words, (at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return test


def build_cascade(universe: DataFrame, bits_per_key: int = 10, hashes: int = 5,
                  max_bits: int = 1 << 28) -> list[Level] | None:
    """``universe``: materialised ``key, listed`` rows, distinct keys. None if
    the first filter would need more than ``max_bits``."""
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[Level] = []
    n = inside.count()
    while n:
        if n * bits_per_key > max_bits:
            return None
        level = _build(inside, n, len(levels) + 1, bits_per_key, hashes)
        levels.append(level)
        # the keys that must not pass, but do, are the next level's content
        fooled = materialise(outside.where(_passes(F.col("key"), level)), "bloom-fooled")
        inside, outside, n = fooled, inside, fooled.count()
    return levels


def listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key of the universe."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(~_passes(key, levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def domains(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def labels(host: Column) -> Column:
    """The labels of the host."""
    return F.split(host, r"\.")


def marked(hosts: DataFrame, keys: DataFrame, keys_of: Callable[[Column], Column]) -> DataFrame:
    """``key, listed`` for every distinct ``key`` of ``hosts``: listed if one of
    its ``keys_of`` is in the one column of ``keys`` (of any number of rows)."""
    on_list = keys.select(F.translate(F.col(f"`{keys.columns[0]}`"), _UPPER, _LOWER).alias("k")).where("k is not null").distinct()
    on_list = small(materialise(on_list.withColumn("hit", F.lit(True)), "url-list"))
    asked = hosts.select("key", F.explode(F.array_distinct(keys_of(F.col("key")))).alias("k"))
    return asked.join(on_list, "k", "left").groupBy("key").agg(F.max(F.coalesce("hit", F.lit(False))).alias("listed"))


def judge_urls(pages: DataFrame, is_listed: Column | DataFrame, rules: list[Rule], key: str = "page_id",
               url: str = "url", keys_of: Callable[[Column], Column] = domains, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page. ``is_listed`` is the
    list, a frame with one column of keys: a host is on it if one of its
    ``keys_of`` is (by default the host and its parent domains). Or it is a
    predicate on the columns ``host`` and ``path``, asked once per distinct host."""
    src = pages.select(F.col(key).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if isinstance(is_listed, DataFrame):
        universe = marked(src.select(F.col("host").alias("key")).distinct(), is_listed, keys_of)
    else:
        universe = src.groupBy(F.col("host").alias("key")).agg(F.max(is_listed).alias("listed"))
    universe = materialise(universe, "url-keys")
    levels = build_cascade(universe, **options)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    if levels is None:
        src = src.join(universe.where("listed").withColumnRenamed("key", "host"), "host", "left")
        member = F.coalesce("listed", F.lit(False))
    else:
        member = listed(F.col("host"), levels)
    return src.select("page_id", "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.when(member, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
