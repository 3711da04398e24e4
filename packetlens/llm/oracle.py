"""DuckDB SQL with the same rows as the registered corpus queries."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
              source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0) AS lt,
              sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS lw
       FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * lw > weight * lt AS free FROM s2),
s4 AS (SELECT source, source_size, weight,
              CASE WHEN free THEN weight * (SELECT arg_min(lt, cap / weight) FROM s3 WHERE free)
                   / (SELECT arg_min(lw, cap / weight) FROM s3 WHERE free) ELSE cap END AS target FROM s3),
p AS (SELECT d.*, source_size, weight, target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
q AS (SELECT *, target - whole * source_size AS rest, start + size <= target - whole * source_size AS in_part FROM p),
g AS (SELECT source, coalesce(sum(size) FILTER (WHERE in_part), 0) AS got FROM q GROUP BY source),
c AS (SELECT q.source, arg_min(start, abs(rest - got - size) * 1e9 + start) AS best
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
      WHERE NOT in_part AND size > 0 AND abs(rest - got - size) < rest - got GROUP BY q.source),
t AS (SELECT q.*, CASE WHEN size = 0 THEN 0
                  ELSE whole + CASE WHEN in_part OR start IS NOT DISTINCT FROM best THEN 1 ELSE 0 END END AS copies
      FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source),
u AS (SELECT *, least((start + size / 2.0::DOUBLE) / target, 1.0) AS share FROM t)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
  CASE WHEN copies > 0 THEN CAST(floor(1000000 * CASE
    WHEN weight = 5 THEN CASE WHEN share * 5 < 5 THEN share * 5 * 2 / (7 + sqrt(greatest(share * 5 * -8 + 49, 0))) ELSE 1 END
    WHEN weight = 2 THEN CASE WHEN share * 2 < 2 THEN share * 2 * 2 / (2 + sqrt(4.0::DOUBLE)) ELSE 1 END
    WHEN share < 0.375 THEN share * 2 / (0.5::DOUBLE + sqrt(share * 2 + 0.25::DOUBLE))
    WHEN share < 1 THEN (share - 0.375) * 2 / (1 + sqrt((share - 0.375) * 2 + 1)) + 0.5
    ELSE 1 END) AS BIGINT) END AS position_ppm
FROM u
"""

_METRICS = [("word_length", "word_chars", "n_words", 75, 4, True), ("symbols", "n_symbols", "n_words", 75, 4, False),
            ("repeated_lines", "n_dup_lines", "n_lines", 99, 1, False),
            ("repeated_words", "n_repeat_words", "n_words", 99, 1, False), ("upper_case", "n_upper", "word_chars", 75, 4, False)]

_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{k}' AS metric, {top} * 1000 // {bottom} AS v, {share} AS share, {spread} AS spread, {both} AS both_sides, base_failed "
    f"FROM m WHERE {bottom} > 0" for k, top, bottom, share, spread, both in _METRICS)


def _limits(keys: str) -> str:
    """Limits from the quantiles of the merged sketches of ``keys``."""
    by = f"{keys}metric, share, spread"
    return f"""(SELECT {keys}metric, total, greatest(0, lower - greatest((upper - lower) * spread, lower // 10) - 10) AS lo,
              upper + greatest((upper - lower) * spread, upper // 10) + 10 AS hi
       FROM (SELECT {by}, any_value(total) AS total, min(b) FILTER (upto * 100 >= total * 25) AS lower,
                    min(b) FILTER (upto * 100 >= total * share) AS upper
             FROM (SELECT {by}, b, CAST(sum(count(*)) OVER (PARTITION BY {by} ORDER BY b) AS BIGINT) AS upto,
                          CAST(sum(count(*)) OVER (PARTITION BY {by}) AS BIGINT) AS total FROM b GROUP BY {by}, b)
             GROUP BY {by}))"""


def _leaning(end: str) -> str:
    """A group's limit leans on its language's, and that on the corpus's."""
    return f"(o.{end} * o.total + ((l.{end} * l.total + w.{end} * 20) // (l.total + 20)) * 20) // (o.total + 20)"


_OP3 = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(8) AS x(k) WHERE c > 1 GROUP BY doc_id),
m0 AS (SELECT a.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
              CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
              CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
              CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
              CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_upper,
              CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
       FROM a LEFT JOIN r ON a.doc_id = r.doc_id),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
v AS ({_VALUES}),
b AS (SELECT lang, source, metric, share, spread, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b
      FROM v WHERE NOT base_failed),
q AS (SELECT o.lang, o.source, o.metric, {_leaning('lo')} AS lo, {_leaning('hi')} AS hi
      FROM {_limits('lang, source, ')} o JOIN {_limits('lang, ')} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric
      JOIN {_limits('')} w ON o.metric = w.metric),
bad AS (SELECT DISTINCT doc_id FROM v JOIN q ON v.metric = q.metric AND v.lang IS NOT DISTINCT FROM q.lang
        AND v.source IS NOT DISTINCT FROM q.source WHERE v > hi OR (both_sides AND v < lo))
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept
FROM m LEFT JOIN bad ON m.doc_id = bad.doc_id
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT DISTINCT source, text FROM d),
x AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y, {_BLANK})), lambda y: y <> ''))) AS line FROM o),
c AS (SELECT source, line, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM o GROUP BY source),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
      WHERE n >= 5 AND n > pages * 0.01 GROUP BY c.source),
e AS (SELECT doc_id, ls, list_filter(ls, lambda y: NOT coalesce(list_contains(bad, trim(y, {_BLANK})), false)) AS good
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(good), 0) AS BIGINT) AS n_dropped, array_to_string(good, chr(10)) AS text
FROM e
"""

_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"


def _rule(value: int) -> str:
    longest_first = [("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"),
                     ("org/fr/", "org", "/fr/", "allow"), ("net/", "net", "/", "block")]
    return " ".join(f"WHEN {_FITS.format(h=r[1], p=r[2])} THEN '{r[value]}'" for r in longest_first)


_OP9 = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_rule(0)} END AS rule,
       CASE {_rule(3)} WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""

_OP10 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_P = "1 + (1000000000::HUGEINT * ({c} + 5)) // ({n} + 5 * v)"

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total, (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v
      FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(total)::BIGINT AS total FROM s GROUP BY lang),
lt AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_P.format(c='coalesce(c.n, 0)', n='s.total')} AS p,
             {_P.format(c='lt.n', n='l.total')} AS q
      FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
      JOIN l ON l.lang = s.lang JOIN lt ON lt.lang = k.lang AND lt.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR rank <= 50
"""

_OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

SQL = {
    "op1_curriculum_mix": _OP1,
    "op3_adaptive_quality": _OP3,
    "op7_site_lines": _OP7,
    "op9_bloom_cascade": _OP9,
    "op10_exact_dedup": _OP10,
    "op11_source_audit": _OP11,
    "op12_segment_negatives": _OP12,
}
