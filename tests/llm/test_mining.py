"""Source audit, hard negatives and token counts against brute force and the library."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.llm import audit, heapbpe, negatives

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


# ---- op11

def audited(rows, min_docs, top):
    """The audit of (lang, source, text) rows, term by term in plain integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        terms = TERM.findall(text.translate(ASCII_LOWER))
        docs.update({(lang, t) for t in terms})
        n.update((lang, source, t) for t in terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), c in docs.items() if g == lang and c >= min_docs]
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        whole = sum(total.values())
        p = lambda c, of: 1 + 10**9 * (c + 5) // (of + 5 * len(kept))
        for s in sources:
            pairs = [(-sum(abs(p(n[lang, s, t], total[s]) - p(n[lang, o, t], total[o])) for t in kept), o.encode()) for o in sources - {s}]
            more = [(p(sum(n[lang, o, t] for o in sources), whole) - p(n[lang, s, t], total[s]), t.encode()) for t in kept if n[lang, s, t]]
            terms = sorted(x for x in more if x[0] < 0)[:top]
            out |= {(lang, s, part, item.decode(), -v, k) for part, found in (("pair", sorted(pairs)), ("term", terms))
                    for k, (v, item) in enumerate(found, 1)}
    return out


def audit_rows(rng, n):
    words = [f"w{c}" for c in "abcdefghijklmnop"] + ["Über", "ÄB", "日本", "İx", "it's", "x1y", "\x00z"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "c", "", None, "ß"])
        k = rng.choice([0, 1, 5, 60])
        rows.append((lang, source, " ".join(rng.choices(words, [1 + 3 * (source == "a")] * 8 + [1] * (len(words) - 8), k=k))))
    return rows + [("en", "a", None), ("xx", "only", ""), ("xx", "other", None), ("fr", "alone", "un deux"), ("en", "long", "wa " * 40_000)]


@pytest.mark.parametrize("merge_rows,slice_bytes,block", [(1_000_000, 4 << 20, 1 << 20), (20, 200, 7)])
def test_audit_is_exact(spark, monkeypatch, merge_rows, slice_bytes, block):
    for name, value in (("MERGE_ROWS", merge_rows), ("SLICE_BYTES", slice_bytes), ("_BLOCK", block)):
        monkeypatch.setattr(audit, name, value)
    rows = audit_rows(random.Random(11), 400)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value long, term string").repartition(5)
    for min_docs, top in ((30, 50), (3, 4)):
        got = [tuple(r) for r in audit.source_divergences(d, min_docs=min_docs, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == audited(rows, min_docs, top)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "lang string, source string, text string")
    assert audit.source_divergences(d).collect() == []
    one = spark.createDataFrame([("en", "a", "x"), ("en", "a", "x")], "lang string, source string, text string")
    assert audit.source_divergences(one, min_docs=2).collect() == []  # one source: as the language, no term stands out


def test_billionths_of_large_counts():
    count, total = np.array([0, 1, 7 * 10**11, 9 * 10**15 - 1]), np.array([3, 3, 10**12 + 7, 9 * 10**15])
    assert audit.billionths(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]


# ---- op12

def mined(rows, positives=5, negatives=10):
    """Brute force over (id, label, vector) rows."""
    ok = {}
    for i, label, v in sorted((r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1])):
        ok.setdefault(i, (label, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (label, v) in ok.items():
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j) for j, (_, w) in ok.items() if j != i)
        for ps, j in [x for x in scored if ok[x[1]][0] == label][:positives]:
            fit = [(s, k) for s, k in scored if ok[k][0] != label and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out |= {(i, j, r, k, -ps, -s) for r, (s, k) in enumerate(fit, 1)}
    return out


def vector_rows(rng, n, dim):
    centres = rng.normal(0, 0.5, (6, dim)) + rng.normal(0, 1, (6, 1))
    rows = []
    for i in range(n):
        c = int(rng.integers(6))
        v = centres[c] + rng.normal(0, 0.3, dim)
        rows.append((i, c if rng.random() < 0.8 else int(rng.integers(6)), v.astype("float32").astype(float).tolist()))
    hot = rows[0][2]
    rows += [(n + i, i % 3, hot) for i in range(60)]  # one vector many times: ties
    rows += [(10_000, 1, [0.0] * dim), (10_100, 2, [-x for x in hot]), (10_200, None, hot), (10_300, 1, None), (None, 1, hot),
             (10_400, 1, [None, *hot[1:]]), (10_500, 1, [float("nan"), *hot[1:]]), (10_600, 2, [float("-inf"), *hot[1:]]),
             (10_700, 4, hot[:7]), (10_800, 4, []), (-100, 0, hot), (10_900, 99, hot), rows[0], (0, 77, hot)]
    return rows


@pytest.mark.parametrize("dim,block_bytes,sparse,cells", [(64, 4 << 20, 0.05, 1 << 22), (100, 600, 1.0, 300), (5, 300, 0.0, 50)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, dim, block_bytes, sparse, cells):
    for name, value in (("BLOCK_BYTES", block_bytes), ("SPARSE", sparse), ("CELLS", cells)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows(np.random.default_rng(dim), 420, dim)
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank int, key string")
    got = [tuple(r) for r in negatives.hard_negatives(d, F.col("vec_id") % 100 == 0).collect()]
    want = mined(rows)
    assert len(got) == len(set(got)) and set(got) == want and len({r[0] for r in want}) > 4


def test_hard_negatives_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(d, F.col("vec_id") % 100 == 0).collect() == []
    lone = spark.createDataFrame([(100, 1, [1.0]), (1, 2, [1.0]), (2, 1, [1e9])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(lone, F.col("vec_id") % 100 == 0).collect() == []  # no positive takes part


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    v = (np.repeat(rng.normal(0, 90, (400, 4)), 16, axis=1) + rng.normal(0, 8, (400, 64))).astype("<i4")
    x = negatives.Vectors(np.arange(400), np.zeros(400, np.int64), v, *negatives.summaries(v))
    score = v.astype(np.int64) @ v.T.astype(np.int64)
    for level, w in enumerate(negatives.WIDTHS):
        near, reach = w * x.means[level] @ x.means[level].T, x.devs[level] @ x.devs[level].T
        assert (np.abs(score - near) <= reach * (1 + 1e-9) + 0.5).all()
    top = np.sort(score, axis=0)[-5]
    r, a, s = negatives.remaining(x, x, top, np.full(400, 2**60), np.ones((400, 400), bool))
    assert {(i, j) for i, j in zip(*np.nonzero(score >= top))} <= set(zip(r, a)) and (s == score[r, a]).all()
    assert len(r) < 0.2 * 400 * 400  # most pairs never get an exact score


# ---- op13

PARTS = ["a", "the", " ", "  ", "\n", "\t", "▁", "日", "本", "ſ", "\x00", "😀", "é", "<s>", "</s>", "<0x0A>", "<unk>", "ing", "tion", " of",
         "    ", "00", "\r\n", "​", "́", "ﬁ", "　", "�", "’.", "».", "s.", "(s", "http://", "}}", "Ünï"]


def test_heap_counts_equal_the_library(spark, monkeypatch):
    import sentencepiece
    monkeypatch.setattr(heapbpe, "KNOWN", 50)  # forgets again and again
    rng = random.Random(13)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", " ", "\n", "a" * 60_000, " " * 3000, "ab " * 30_000, "x" + " " * 777 + "y", "本" * 5000, "same", "same"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, n_bytes long")
    sp = sentencepiece.SentencePieceProcessor(model_file=heapbpe.model_path())
    want = {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in enumerate(texts)}
    assert {r[0]: tuple(r[1:]) for r in heapbpe.document_token_counts(d).collect()} == want
    kept = heapbpe.token_counts(d)
    assert kept.columns == ["row", "n_bytes", "n_tokens"] and kept.select("row.*").columns == d.columns
    assert heapbpe.document_token_counts(d.limit(0)).collect() == []


def test_merges_are_initial_symbols_minus_tokens():
    ranks = {p: i for i, p in enumerate(["ab", "abab", "ba", "a", "b"])}
    assert heapbpe.merges("ababab", ranks) == 4  # ab ab ab, then the left two
    assert heapbpe.merges("bab", ranks) == 1 and heapbpe.merges("", ranks) == 0
    assert heapbpe.initial_symbols("aéb", ranks) == 4
