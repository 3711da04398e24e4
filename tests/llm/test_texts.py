"""Joins, tokens, chats, archives and the classifier against brute force."""

import collections
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlens.llm import bpe, chat, grade, nearjoin, warc
from packetlens.llm import grade as grade_module
from packetlens.llm.common import BATCH_BYTES
from packetlens.session import scratch_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def near_fixture(rng):
    base = [[f"b{g}w{i}" for i in range(120)] for g in range(6)]
    rows = []
    for g, b in enumerate(base):
        for k in range(40 if g == 0 else 6):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + " common passage of six words here" for _ in range(60)]
    rows += [rows[0]] * 5 + ["", None, "one two", "one two", "one\ttwo", "a b c d e"]
    return list(enumerate(rows))


@pytest.mark.parametrize("bucket_rows,block_rows,leaf", [(4096, 1024, 200), (8, 4, 4)])
def test_near_join_matches_all_pairs(spark, monkeypatch, bucket_rows, block_rows, leaf):
    monkeypatch.setattr(nearjoin, "LEAF", leaf)
    rows = near_fixture(random.Random(3))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, links long, digest long")
    got = {r.doc_id: r for r in nearjoin.near_classes(d, bucket_rows=bucket_rows, block_rows=block_rows).collect()}
    sets = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links, root = collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (r.class_id, r.n_links, r.n_shingles) for i, r in got.items()} == {i: (find(i), links[i], len(sets[i])) for i in sets}
    out = nearjoin.one_per_class(d, bucket_rows=bucket_rows, block_rows=block_rows)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted({find(i) for i in sets})


def test_near_join_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, t), (1, t), (None, t + " more"), (None, None), (7, None)], "doc_id long, text string")
    got = sorted(map(str, nearjoin.near_classes(d).select("doc_id", "class_id", "n_links").collect()))
    assert got == sorted(map(str, [*[f"Row(doc_id={a}, class_id={b}, n_links={c})" for a, b, c in
                                     ((1, 1, 2), (1, 1, 2), (None, 1, 2), (None, None, 0), (7, 7, 0))]]))
    assert sorted(str(r.doc_id) for r in nearjoin.one_per_class(d).collect()) == ["1", "7", "None"]
    assert nearjoin.near_classes(d.limit(0)).count() == 0 and nearjoin.one_per_class(d.limit(0)).count() == 0


def test_recall_counts_both_filters():
    assert nearjoin.missed(4, loose=0.66) > 1e-4 > nearjoin.missed(4)
    with pytest.raises(ValueError):
        nearjoin.runs_for(0.9999, 0.6)


def test_runs_and_components(spark):
    assert nearjoin.runs_for(0.9999) == 4
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (200, 300), (5, 5)]
    e = spark.createDataFrame([(bytes([0, a // 256, a % 256]), bytes([0, b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    groups = collections.defaultdict(set)
    for r in nearjoin.components(e).collect():
        groups[bytes(r.root)].add(r.node[1] * 256 + r.node[2])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), [100, 200, 300]]


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.tokenizer_path(), "rb") as f:
        return bpe.TrieEncoder(f.read())


def test_tokens_match_the_library(encoder, monkeypatch):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(1)
    parts = [*"abcdefghij ETAOIN  \n\n\t'sd0123.,!?-_=<>|éßñ漢한", "\u0301", "\U0001f600", "'ll", "the", " and", "ing", " ²½", "<|endoftext|>", "\ua7ce", "\x1c", "\x85"]
    texts = ["", "   ", "a" * 2000, " " * 900, "x<|endoftext|> y", *["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(800)]]

    def check():
        for t, x in zip(texts, encoder.encode(texts), strict=True):
            ids = lib.encode(t, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(x) // 4}I", x)) == ids
            assert encoder.decode(x) == lib.decode(ids, skip_special_tokens=False)

    check()
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 7)     # texts cut into many chunks
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 30)    # memos that keep starting anew
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 50)
    check()


def test_encode_texts_keeps_columns(spark, encoder):
    d = spark.createDataFrame([(1, None, 9, "r"), (2, "", 9, "r"), (3, "long " * 40_000, 9, "r"), (3, "a\nb", None, None)],
                              "doc_id long, text string, ids long, row string")
    got = bpe.encode_texts(d).select("row.*", F.col("ids").alias("x"), "decoded").collect()
    assert [(r.doc_id, r.row, r.decoded) for r in got] == [(1, "r", ""), (2, "r", ""), (3, "r", "long " * 40_000), (3, None, "a\nb")]
    assert [len(r.x) // 4 for r in got][:2] == [0, 0]
    out = bpe.encoded_documents(d.withColumn("n_tokens", F.lit(0)))
    assert out.columns == ["doc_id", "text", "ids", "row", "token_ids", "n_tokens"]
    assert bpe.encoded_documents(d.limit(0)).count() == 0


def test_encoding_gets_small_batches_with_one_text(spark, encoder):
    """A worker's batches have bounded bytes, and a carried text goes to it once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        d = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, F.concat(F.repeat(F.lit("word "), 1000), "id")).alias("text"))
        out = bpe.encode_texts(d)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "body" not in plan
        assert "body" in bpe.encode_texts(d, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

        got = d.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 2 * BATCH_BYTES
        whole = {r.doc_id: (r.x, r.decoded) for r in out.select("row.doc_id", F.col("ids").alias("x"), "decoded").collect()}
        slim = {r.doc_id: (r.x, r.decoded) for r in bpe.encode_texts(d, keep=["doc_id"]).select("row.doc_id", F.col("ids").alias("x"), "decoded").collect()}
        assert whole == slim and len(whole) == 3000 and whole[0] == (b"", "") and whole[7][1] == "word " * 1000 + "7"
        spark.conf.set(key, "1m")     # a lower limit stays
        bpe.encode_texts(d)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<", "", None, "é" * 3000, "<|im_end|>\n", "\ue000 <|"]
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "")
    rows = [(1, i, "assistant" if i % 2 else "user\n\\n<|", t, 0) for i, t in enumerate(texts)]
    rows += [(None, 0, None, "x", 0), (2, 0, "assistant", "same", 0), (2, 0, "assistant", "same", 0)]
    rows += [(3, i, "assistant", f"turn {i}", 0) for i in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    import hashlib
    got = {r.conv_id: r for r in chat.conversation_digests(d, lookback=8).collect()}
    for conv in (1, None, 2, 3):
        own = [r for r in rows if r[0] == conv]
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.conversation_digests(d.limit(0)).count() == 0


def test_templates_that_rewrite_history():
    def last_only(turns):  # shows reasoning of the last turn only
        return "[BOS]" + "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('#')[-1]};" for i, (r, t) in enumerate(turns))

    turns = [("u", "hi"), ("a", "why#yes"), ("u", "more"), ("a", "so#no")]
    text, seen = "", []
    for k, (gain, back, a, b) in enumerate(chat.render_spans(iter(turns), last_only, 64)):
        text = (text[:-back] if back else text) + gain
        assert text == last_only(turns[:k + 1])
        seen.append((back > 0, gain[a:b] if a >= 0 else None))
    assert [x for x, _ in seen] == [False, False, True, False] and seen[3][1] == "so#no"


def test_long_conversations_are_rendered_whole(spark):
    def moving(turns):  # system prompt before the last user turn, reasoning of earlier turns stripped, turns counted
        at = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=0)
        body = [f"{i}/{r}:{t if i >= at else t.split('#')[-1]};" for i, (r, t) in enumerate(turns) if i]
        return "".join(body[:at - 1] + [f"[{turns[0][1]}]"] + body[at - 1:]) if at else "".join(body)

    turns = [("system", "be brief"), ("user", "go")] + [("tool" if i % 90 else "user", f"why{i}#so{i}") for i in range(2, 200)]
    d = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    text = ""
    for k, r in enumerate(chat.format_conversations(d, moving).orderBy("n").collect()):
        text = (text[:-r.back] if r.back else text) + r.gain
        assert text == moving(turns[:k + 1])
    with pytest.raises(ValueError):
        chat.format_conversations(d, moving, lookback=64)
    with pytest.raises(ValueError):
        list(chat.render_spans(iter(turns), moving, 64))


@chat.local(reach=2)
def newest_marked(turns):  # a mark that the next turn takes away, and the role two turns before
    return "[BOS]" + "".join(f"{turns[i - 2][0] if i > 1 else ''}|{t}" + ("*" if i == len(turns) - 1 else "") for i, (_, t) in enumerate(turns))


def test_long_conversations_in_blocks(spark):
    rows = [(c, t, f"r{k % 7}", f"t{k}") for c in (1, None) for k, t in enumerate([None, None, *range(0, 90, 3), *[90] * 5, *range(91, 130), 2**62])]
    rows += [(2, k, "r", f"t{k}") for k in range(5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (newest_marked, chat.turn_template):
        got = collections.defaultdict(list)
        for r in chat.format_conversations(d, template, learn_from=("r", "r3"), block_turns=8).orderBy("conv_id", "n").collect():
            got[r.conv_id].append((r.n, r.gain, r.back))
        for conv in (1, None, 2):
            own = sorted(((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows if r[0] == conv))
            want = chat.render_spans(((r[2], r[3]) for r in own), template)
            assert got[conv] == [(n, gain, back) for n, (gain, back, *_) in enumerate(want)]
    # no task renders all turns of the long conversation
    parts = chat._in_blocks(d.select("conv_id", "turn", "role", "text"), 2, 8).groupBy("conv_id", "blk").count().collect()
    assert max(r["count"] for r in parts) <= 8 + 2


def test_lookback_of_local_templates_is_exact():
    turns = [(f"r{i}", f"t{i}") for i in range(50)]
    whole = list(chat.render_spans(iter(turns), newest_marked))
    assert list(chat.render_spans(iter(turns), newest_marked, 6)) == whole
    with pytest.raises(ValueError):
        list(chat.render_spans(iter(turns), newest_marked, 5))


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(1, "http://a b/é\r\nX: y", big), (2, None, big), (3, "u", ""), (4, "u", None), (5, "u", "x" * 999), (6, "u", "x" * 999),
            (7, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "z" * 5000), (9, "u", big + "!"), (9, "u", big + "!")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, id string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path, segment_bytes=4096, records_per_file=3)
    records = warc.read_archive(spark, path)
    stored = collections.Counter(bytes(r.payload) for r in records.where("type = 'response'").collect())
    assert stored[big.encode()] == 1 and stored[(big + "!").encode()] == 2 and stored[b"y" * 1000] == 2 and stored[b""] == 2
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_index(records).collect())
    size = len(big.encode())
    assert got == collections.Counter([(1, size, "revisit", 2), (2, size, "response", None), (3, 0, "response", None), (4, 0, "response", None),
                                       (5, 999, "response", None), (6, 999, "response", None), (7, 1000, "revisit", 8),
                                       *[(8, 1000, "response", None)] * 2, (None, 5000, "response", None), *[(9, size + 1, "response", None)] * 2])
    empty = scratch_path(spark, "warc-empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.page_index(warc.read_archive(spark, empty)).count() == 0


def test_chunk_framing():
    for n in (0, 1, 4095, 4096, 4097, 9000):
        assert warc.dechunked(warc.chunked(b"a\r\n" * n)) == b"a\r\n" * n
    with pytest.raises(ValueError):
        warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nabc", "sha1:X")


def test_ordinal_model_on_held_out_rows():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(900):
        bad, dull = rng.random() < 0.2, rng.random() < 0.3
        x = set(rng.integers(1000, 5000, 30).tolist())
        x |= {int(v) for v in rng.integers(0, 5, 2)} if bad else set()
        x |= {int(v) for v in rng.integers(10, 15, 2)} if dull else set()
        rows.append(np.array(sorted(x)))
        grades.append(2 - int(bad) - int(dull))
    w, cuts = grade.fit_ordinal(rows[:700], np.array(grades[:700]), 2)
    assert cuts[0] < cuts[1]
    s = np.array([w[r].sum() for r in rows[700:]])
    tail = grade._sigmoid(s - cuts[1])
    assert ((tail >= 0.5) == (np.array(grades[700:]) == 2)).mean() > 0.95
    assert not grade.fit_ordinal([], np.array([], int), 2)[0].any()


def test_graded_documents(spark):
    good, bad = "the quiet river runs past the old mill {} and on", "you awful fool {} you awful fool"
    rows = [(i, (good if i % 3 else bad).format(f"n{i}"), 1) for i in range(300)] + [(900, None, 1), (901, "", 1), (None, good, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(250, None, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in grade.graded_documents(d, labels).collect()}
    assert len(got) == 303 and all(got[i].kept == bool(i % 3) for i in range(200, 300))
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    assert grade.graded_documents(d.limit(0), labels.limit(0)).count() == 0


def test_bpe_words_of_few_letters_match_the_library():
    """Repeated letters make merges of equal rank and merges across word parts."""
    import random

    from tokenizers import Tokenizer

    from packetlens.llm import bpe
    rng = random.Random(3)
    texts = ["".join(rng.choices("aest é\n'1-", k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [c * n for c in "ae -=é" for n in range(1, 70)]
    with open(bpe.tokenizer_path(), "rb") as f:
        encoder = bpe.TrieEncoder(f.read())
    library = Tokenizer.from_file(bpe.tokenizer_path())
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text


def test_ordinal_fit_against_plain_descent():
    """The penalised loss of ``fit_ordinal`` isn't above that of a slow, independent descent."""
    rng = np.random.default_rng(6)
    n, d, l1 = 300, 12, 6e-4
    x = rng.random((n, d)) < 0.3
    true = rng.normal(0, 2, d)
    noisy = x @ true + rng.logistic(0, 1, n)
    grade = (noisy > np.quantile(noisy, 0.3)).astype(int) + (noisy > np.quantile(noisy, 0.7))

    def loss(w, cuts):
        tail = 1 / (1 + np.exp(-(x @ w)[:, None] + cuts))
        full = np.column_stack([np.ones(n), tail, np.zeros(n)])
        chance = full[np.arange(n), grade] - full[np.arange(n), grade + 1]
        return -np.log(np.maximum(chance, 1e-12)).mean() + l1 * np.abs(w).sum()

    w, cuts = np.zeros(d), np.array([-0.8, 0.8])
    rate = 1.0
    for _ in range(4000):      # numeric slopes, halving the step where the loss rises
        at = np.append(w, cuts)
        slope = np.array([(loss(*np.split(at + e, [d])) - loss(*np.split(at - e, [d]))) / 2e-5 for e in np.eye(d + 2) * 1e-5])
        new = at - rate * slope
        if loss(*np.split(new, [d])) < loss(w, cuts):
            w, cuts = np.split(new, [d])
        else:
            rate /= 2
            if rate < 1e-7:
                break
    weights, got = grade_fit = grade_module.fit_ordinal([np.flatnonzero(r) for r in x], grade, 2, steps=3000, l1=l1)
    assert loss(weights[:d], got) <= loss(w, cuts) + 1e-3 and grade_fit[1][0] < grade_fit[1][1]
    assert np.abs(weights[:d] - w).max() < 0.2 and not weights[d:].any()


def test_scores_do_not_depend_on_neighbours(spark):
    rng = np.random.default_rng(1)
    model = (rng.normal(0, 1, grade_module.FEATURES), np.array([-1.0, 1.0]))
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 999, i % 40))) for i in range(200)] + [(900, None), (901, ""), (902, "z " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: tuple(r) for r in grade_module.score(d.coalesce(1), model).collect()}
    b = {r.doc_id: tuple(r) for r in grade_module.score(d.repartition(7).sortWithinPartitions(F.desc("doc_id")), model).collect()}
    assert a == b and len(a) == 203


def test_spans_next_to_the_marker():
    """A template without separators, and texts that hold the marker's character."""
    glued = chat.local(reach=0)(lambda turns: "".join(t for _, t in turns))
    turns = [("u", "a\ue000"), ("a", "\ue000b"), ("a", "\ue0000\ue000"), ("a", ""), ("a", "x" * 200_000)]
    spans = list(chat.render_spans(iter(turns), glued))
    assert [(g[s:e], back) for g, back, s, e in spans] == [(t, 0) for _, t in turns]
