"""Exact dedup by skew-safe combining (native).

Equal texts are found in three steps, each of which compares whole texts:

1. locally: the map side of ``groupBy(digest, salt, text)`` keeps one row per
   distinct text of a task before anything is shuffled;
2. salted: the shuffle of that aggregate merges the rows of one
   ``(digest, salt)``; only digests above ``hot_rows`` rows carry more than one
   salt, so a group with a third of the corpus is spread over its salts;
3. globally: the salt winners (at most ``salts`` rows per text) are merged by
   ``(digest, text)``.

The digest (SHA-256) deals the rows out; the text itself is part of every
grouping key. Winners then return to their members over the digest alone, and
over digest and text for digests that hold more than one text. The winners of hot
digests go back by broadcast (there are at most ``MOST_HOT`` of them), so the members of a large
group stay where they are; only the others are shuffled.

Defined results: null text counts as empty; repeated rows are members like any
other (both count in ``group_size``, both are ``kept`` if they carry the largest
id); a null id never wins against a number, and a group of null ids has a null
``keep_id`` and keeps its rows; an empty table gives an empty result; other
columns of the input are not read, so none can clash; texts of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import materialise, small


MOST_HOT = 100_000  # digests that count as hot


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 hot_rows: int = 5_000, salts: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    src = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    src = src.withColumn("digest", F.unhex(F.sha2(F.col("body"), 256)))
    ids = materialise(src.select("id", "digest"), "exact-ids")

    # digests of more than hot_rows rows, and of so many that at most MOST_HOT exist
    hot_rows = max(hot_rows, ids.count() // MOST_HOT)
    hot = materialise(ids.groupBy("digest").count().where(F.col("count") > hot_rows)
                      .select("digest", F.lit(True).alias("hot")), "exact-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0))
    salted = (src.join(small(hot), "digest", "left")
              .groupBy("digest", salt.alias("salt"), F.coalesce("hot", F.lit(False)).alias("hot"), "body")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    winners = salted.groupBy("digest", "hot", "body").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    by_digest = materialise(
        winners.groupBy("digest", "hot").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                             F.max("group_size").alias("group_size")), "exact-winners")
    lone = by_digest.where("texts = 1").drop("texts")
    out = ids.join(small(hot.select("digest")), "digest", "left_anti").join(lone.where("not hot").drop("hot"), "digest")
    out = out.unionByName(ids.join(small(lone.where("hot").drop("hot")), "digest"))
    clash = by_digest.where("texts > 1").select("digest")
    if not clash.isEmpty():
        # different texts under one digest: members go back by text as well
        named = winners.join(clash, "digest")
        out = out.unionByName(src.join(named, ["digest", "body"]).select(*out.columns))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
