"""The pipeline against a brute-force version: the stages' SQL in DuckDB, all
pairs in Python for near duplicates, and the tokenizers library for the ids."""

import collections
import re
import struct

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from packetlens.llm import bpe
from packetlens.llm.oracle import SQL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def one_per_class(docs: pd.DataFrame) -> pd.DataFrame:
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = WORDS.findall(t)
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return docs[[find(i) == i for i in docs.doc_id]]


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer
    con = duckdb.connect()

    def sql(name, docs):
        con.register("documents", docs)
        return con.sql(SQL[name]).df()

    docs = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()
    docs = docs[docs.doc_id.isin(sql("op3_adaptive_quality", docs).query("kept").doc_id)]
    cleaned = sql("op7_site_lines", docs).set_index("doc_id")
    docs = docs.assign(text=docs.doc_id.map(cleaned.text),
                       n_chars=[len(cleaned.text[i]) if cleaned.n_dropped[i] else n for i, n in zip(docs.doc_id, docs.n_chars)])
    docs = one_per_class(docs)
    copies = sql("op1_curriculum_mix", docs).set_index("doc_id").copies
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = collections.Counter()
    for r in docs.itertuples():
        ids = tuple(lib.encode(r.text, add_special_tokens=False).ids)
        if copies[r.doc_id]:
            want[r.doc_id, r.text, r.lang, r.source, r.n_chars, ids] += int(copies[r.doc_id])

    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = struct.unpack(f"<{r.n_tokens}I", r.token_ids)
        got[r.doc_id, r.text, r.lang, r.source, r.n_chars, ids] += 1
    assert got == want and 100 < sum(got.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0)]])
def test_pipeline_on_little(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == docs.columns
        assert out.count() <= len(rows)


def test_line_dedup_stage_drops_lines(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(SQL["op7_site_lines"]).df()
    got = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert dict(zip(want.doc_id, want.text)) == {r.doc_id: r.text for r in got.select("doc_id", "text").collect()}
    assert want.n_dropped.sum() == 164 and (want.n_dropped > 0).sum() == 128


def test_all_corpus_queries_are_registered():
    """The entry skips the corpus operators where they are absent; here they are present."""
    import __spark_entry__
    names = __spark_entry__.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert {"op1_curriculum_mix", "op3_adaptive_quality", "op11_source_audit", "op12_segment_negatives"} <= set(__spark_entry__.oracle_sql())
