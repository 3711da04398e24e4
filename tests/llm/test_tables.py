"""Operators on rows of documents and pages: edge cases and brute-force twins."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from packetlens.llm import exact, mix, quality, sitelines, urlfilter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, host string, row string, kept boolean"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, "h", "x", True) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    return docs(spark, [(1, None, "en", "a"), (2, "", None, "a"), (3, prose, "en", None), (3, prose, "en", None),
                        (None, prose, None, None), (4, LONG, "en", "b"), (5, "a b c " * 50, "en", "b"), (6, prose + " end", "en", "a")])


def test_exact_groups(spark, odd):
    for hot in (1, 1000):
        got = exact.exact_groups(odd, hot_rows=hot, salts=3).collect()
        assert len(got) == 8
        want = collections.defaultdict(list)
        for r in odd.collect():
            want[r.text or ""].append(r.doc_id)
        for ids in want.values():
            keep = max((i for i in ids if i is not None), default=None)
            mine = [g for g in got if g.keep_id == keep and g.group_size == len(ids)]
            assert len(mine) == len(ids) and all(g.kept == (g.doc_id == keep) for g in mine)
        assert {g.text_sha256 for g in got} == {hashlib.sha256(t.encode()).hexdigest() for t in want}
    assert exact.exact_groups(odd.limit(0)).count() == 0


def test_digest_clash_is_settled_by_content(spark, odd, monkeypatch):
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("00" * 32))
    got = exact.exact_groups(odd)
    assert sorted(r.group_size for r in got.collect()) == [1, 1, 1, 2, 2, 3, 3, 3]


def repeat_words(text):
    w = WORDS.findall(text)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(hit)


def test_quality_counts_and_columns(spark, odd):
    texts = ["", "a b c", "x " * 30, "one two three four five six seven eight nine " * 3, "l1 a\n\nl1 a\nl2 #$\n \x0b\nl1 a", LONG, None,
             "p q r s t u v w x y p q r s t u v w z"]
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in quality.quality_decisions(d).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(t))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 20 or 100 * want[4] > 30 * len(w))
        assert not (g.base_failed and g.kept)
    kept = quality.kept_documents(odd)
    # document 4's words are twice as long as those of the other documents
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "6", "None"]
    assert quality.kept_documents(odd.limit(0)).count() == 0


def test_quality_limits_follow_the_group(spark):
    plain = [(i, " ".join(f"abcde{j % 7}" if j % 9 else f"f{i}x{j}" for j in range(60)), "en", "s") for i in range(300)]
    loud = [(1000 + i, " ".join(f"ab{i}c{j}" + "*" * 3 for j in range(60)), "en", "s") for i in range(3)]
    usual = [(2000 + i, " ".join(f"ab{i}c{j}" + "*" * 3 for j in range(60)), "en", "code") for i in range(300)]
    got = {r.doc_id: r.kept for r in quality.quality_decisions(docs(spark, plain + loud + usual)).collect()}
    assert not any(got[1000 + i] for i in range(3))       # far from its own source
    assert all(got[2000 + i] for i in range(300))         # usual in its source


def test_sketches_merge(spark):
    d = docs(spark, [(i, "word " * (i % 50 + 1), "en", f"s{i % 3}") for i in range(120)])
    m = quality.with_metrics(d)
    one = quality._limits(quality.sketches(m), ["lang"]).orderBy("metric").collect()
    whole = quality._limits(quality.sketches(m.withColumn("source", F.lit("x"))), ["lang"]).orderBy("metric").collect()
    assert one == whole


def test_quality_production_limits_decide(spark):
    """Sources of near-identical pages keep trifles; a junk text goes in each; the spread and the group matter."""
    def text(i, word, extra=""):
        return " ".join(f"{word}{(i * 7 + j) % 90}" for j in range(60)) + extra
    same = [(i, text(0, "abcd") + f" x{i % 3}", "en", "same") for i in range(100)]
    wide = [(1000 + i, " ".join("abcdefghij"[:2 + (i + j) % 9] + str((i * 3 + j) % 60) for j in range(60 + i % 5)), "en", "wide") for i in range(100)]
    long = [(2000 + i, text(i, "abcdefghijklm"), "de", "long") for i in range(100)]
    junk = [(5000 + k, text(k, "abcdefghijklm"), "en", "same") for k in range(3)] + [(6000, text(1, "ab###"), "en", "wide")]
    got = {r.doc_id: r.kept for r in quality.quality_decisions(docs(spark, same + wide + long + junk)).collect()}
    assert all(got[r[0]] for r in same + wide + long) and not any(got[r[0]] for r in junk)  # long words are usual in "long" only


def test_quality_small_group_leans_on_its_language(spark):
    usual = [(i, " ".join(f"word{(i * 7 + j) % 90}" for j in range(60)), "en", "s") for i in range(200)]
    lone = [(900, " ".join(f"ab###{j}" for j in range(60)), "en", "tiny"), (901, " ".join(f"word{j}" for j in range(60)), "en", "tiny2")]
    got = {r.doc_id: r.kept for r in quality.quality_decisions(docs(spark, usual + lone)).collect()}
    assert not got[900] and got[901] and all(got[i] for i in range(200))


def test_site_lines(spark, odd):
    rows = [(i, f"menu\nown line {i}\n\n  menu \nrare" if i < 30 else f"own {i}\nshared", "en", "a" if i < 40 else None) for i in range(60)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in sitelines.drop_site_lines(d, ratio=0.5).select("row.doc_id", "cleaned", "n_lines", "n_dropped").collect()}
    assert got[0].cleaned == "own line 0\n" and (got[0].n_lines, got[0].n_dropped) == (5, 3)   # menu twice, rare once
    assert got[35].cleaned == "own 35\nshared"          # 10 of 40 pages
    assert got[50].cleaned == "own 50"                  # null host: all 20 pages
    out = sitelines.cleaned_documents(d, ratio=0.5)
    assert out.columns == d.columns and out.where("doc_id = 0").first().n_chars == len("own line 0\n")
    few = {r.doc_id: r.text for r in sitelines.cleaned_documents(odd).collect()}
    assert few[1] is None and few[2] == "" and few[4] == LONG
    assert sitelines.cleaned_documents(odd.limit(0)).count() == 0


def test_site_lines_of_small_and_large_hosts(spark):
    """With production parameters: a host of five pages is judged, copies of a page are one page."""
    small_host = [(i, f"nav bar\nbody {i}", "en", "five") for i in range(5)]
    four = [(100 + i, f"nav bar\nbody {i}", "en", "four") for i in range(4)]
    copies = [(200 + i, "one\ntwo\nthree", "en", "copied") for i in range(300)] + [(600 + i, f"text {i}", "en", "copied") for i in range(20)]
    large = [(1000 + i, f"{'footer' if i % 90 == 0 else 'own ' + str(i)}\n{'odd line' if i < 5 else 'more ' + str(i)}", "en", "large") for i in range(900)]
    got = {r.doc_id: r.text for r in sitelines.cleaned_documents(docs(spark, small_host + four + copies + large)).collect()}
    assert all(got[i] == f"body {i}" for i in range(5)) and all(got[100 + i] == four[i][1] for i in range(4))
    assert all(got[r[0]] == r[1] for r in copies)
    for i, text, *_ in large:  # 10 of 900 pages hold the footer, 5 the odd line
        assert got[i] == (text.split("\n")[1] if i % 90 == 10 else text)


def test_exact_groups_hot_text(spark):
    """Half of all rows share one text: its members aren't shuffled on the way back."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    out = exact.exact_groups(d, hot_rows=100)
    assert out.where("group_size = 2000 and keep_id = 3998").count() == 2000 and out.where("kept").count() == 251
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2


def test_broadcast_is_counted_in_bytes(spark):
    from packetlens.llm.common import small
    d = spark.range(10).select("id", F.array_repeat(F.lit("x" * 100), 100).alias("a"), F.struct(F.lit(b"12")).alias("s"), F.lit(None).cast("map<string,int>").alias("m"))
    hinted = lambda x: "strategy=broadcast" in x.join(d, "id")._jdf.queryExecution().analyzed().toString()
    assert hinted(small(d, most_bytes=200_000)) and not hinted(small(d, most_bytes=50_000)) and not hinted(small(d, rows=9))
    assert hinted(small(d.limit(0)))


def test_filter_build_is_linear(spark):
    import time
    keys = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    began = time.time()
    level = urlfilter._build(keys, 300_000, 1, 10, 5)
    assert time.time() - began < 60
    asked = spark.range(600_000).select(F.concat(F.lit("k"), "id").alias("key")).where(urlfilter._passes(F.col("key"), level))
    assert 300_000 <= asked.count() < 310_000 and keys.join(asked, "key").count() == 300_000


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed")).cache()
    levels = urlfilter.build_cascade(keys, bits_per_key=2, hashes=1)
    assert len(levels) > 2
    assert keys.select((urlfilter.listed(F.col("key"), levels) == F.col("listed")).alias("ok")).where("not ok").count() == 0
    assert urlfilter.build_cascade(keys, max_bits=64) is None
    assert urlfilter.build_cascade(keys.where("not listed")) == []


def test_urls(spark):
    urls = {1: "http://A.Example.NET/en/x?q=/y", 2: "https://example.net/de/", 3: "ftp://b.org/fr/p", 4: "http://xorg/fr/",
            5: "nothing", 6: None, 7: "http://bad.example.com/de/1#x", 8: "x://y.net", 9: "http://spam.org?u=http://z.net/", 10: ""}
    pages = spark.createDataFrame([(*kv, "clash") for kv in [*urls.items(), (1, urls[1])]], "page_id long, url string, host string")
    rules = [urlfilter.Rule("net/", "block"), urlfilter.Rule("example.net/en/", "allow"),
             urlfilter.Rule("example.com/de/", "block"), urlfilter.Rule("org/fr/", "allow")]
    for bits in (1 << 20, 1):
        got = urlfilter.judge_urls(pages, F.col("host").startswith("spam"), rules, max_bits=bits).collect()
        by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
        assert len(got) == 11
        assert by == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"),
                      3: ("b.org", "/fr/p", "org/fr/", "allow"), 4: ("xorg", "/fr/", None, "allow"), 5: ("", "", None, "allow"),
                      6: ("", "", None, "allow"), 7: ("bad.example.com", "/de/1", "example.com/de/", "block"),
                      8: ("y.net", "", None, "allow"), 9: ("spam.org", "", None, "block"), 10: ("", "", None, "allow")}
    assert urlfilter.judge_urls(pages.limit(0), F.lit(False), rules).count() == 0


def test_urls_against_a_long_list(spark):
    hosts = [f"h{i}.net" for i in range(300)] + ["a.b.h3.net", "xh3.net", "h3.net.org", "", "B.H4.Net"]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    keys = spark.range(20_000).select(F.concat(F.lit("H"), F.col("id") * 3, F.lit(".net")).alias("a.key"))
    keys = keys.unionByName(keys.limit(5)).union(spark.createDataFrame([(None,)], "k string"))
    listed = {f"h{3 * i}.net" for i in range(20_000)}
    want = {i: "block" if any(h.lower().split(".", k)[-1] in listed for k in range(4)) else "allow" for i, h in enumerate(hosts)}
    for bits in (1 << 20, 1):
        got = urlfilter.judge_urls(pages, keys, [], max_bits=bits).collect()
        assert len(got) == len(hosts) and {r.page_id: r.verdict for r in got} == want
    by_label = urlfilter.judge_urls(pages, spark.createDataFrame([("b",), ("h7",)], "k string"), [], keys_of=urlfilter.labels)
    assert {r.page_id for r in by_label.where("verdict = 'block'").collect()} == {7, 300, 304}


def test_mix(spark, odd):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", ["a", "b", "c", None][0 if i % 2 else i // 2 % 4]) for i in range(600)]
    d = docs(spark, rows)
    got = mix.mix_decisions(d, bucket_rows=16).collect()
    assert len(got) == 600 and sorted(r.first_position for r in got) == [r.first_position for r in got]
    size = collections.Counter()
    for i, t, _, s in rows:
        size[s] += t.count("w")
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    free, left, target = set(size), 1.5 * sum(size.values()), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        free -= set(over)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in size)
    again = mix.mix_decisions(d.repartition(7), bucket_rows=16).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    out = mix.mixed_documents(odd)
    assert out.columns == odd.columns and out.where("text is null or text = ''").count() == 0
    assert mix.mixed_documents(odd.limit(0)).count() == 0 and mix.mix_decisions(odd.limit(0)).count() == 0


def test_curriculum_positions_follow_the_schedule(spark):
    total, pieces = mix.integrate([(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)])
    assert total == 1.0 and [p[4] for p in pieces] == [0.0, 0.375]
    t = spark.createDataFrame([(0.0,), (0.375,), (0.5,), (1.0,)], "s double")
    got = [r[0] for r in t.select(mix._invert(F.col("s"), F.lit(1.0), mix.SCHEDULES)).collect()]
    assert got == pytest.approx([0.0, 0.5, 0.61803398875, 1.0])
