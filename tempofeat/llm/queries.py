"""The registered queries of this subpackage, and DuckDB SQL where it can tell the same."""

from __future__ import annotations

from tempofeat.llm import licences, quality_rules, url_filter
from tempofeat.llm.decontamination import op4_suffix_decontamination
from tempofeat.llm.licences import op10_licence_scan
from tempofeat.llm.ngram_join import op6_ngram_jaccard_join
from tempofeat.llm.packing import op8_cost_packing
from tempofeat.llm.quality_classifier import op7_subword_quality
from tempofeat.llm.quality_rules import op1_quality_rules
from tempofeat.llm.sharding import op3_feistel_shards
from tempofeat.llm.token_counts import op9_token_counts
from tempofeat.llm.toxicity import op5_string_kernel_toxicity
from tempofeat.llm.url_filter import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_url_filter,
        op3_feistel_shards,
        op4_suffix_decontamination,
        op5_string_kernel_toxicity,
        op6_ngram_jaccard_join,
        op7_subword_quality,
        op8_cost_packing,
        op9_token_counts,
        op10_licence_scan,
    )
}


def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _canonical(text: str) -> str:
    words = rf"string_split(trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\p{{L}}\p{{N}}_]*(portions )?(copyright\b|©|\(c\)\s|all rights reserved).*$', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    out = f"' ' || array_to_string(list_transform({words}, lambda w: coalesce(eq.m[w], w)), ' ') || ' '"
    for phrase, same in licences.PHRASES.items():
        out = f"replace({out}, ' {phrase} ', ' {same} ')"
    return f"trim({out})"


_MEASURES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / (n_lines + 5)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
def _bucket(x: str) -> str:
    """The lower edge of the sketch bucket of x."""
    arms = " ".join(f"WHEN {x} < {bound!r}::DOUBLE THEN floor({x} / {width!r}::DOUBLE) * {width!r}::DOUBLE" for bound, width in quality_rules.WIDTHS[:-1])
    last = quality_rules.WIDTHS[-1][1]
    return f"CASE {arms} ELSE floor({x} / {last!r}::DOUBLE) * {last!r}::DOUBLE END"


_FENCES = ", ".join(f"quantile_disc({_bucket(m)}, 0.25) FILTER (NOT base_failed) AS a_{m}, quantile_disc({_bucket(m)}, 0.75) FILTER (NOT base_failed) AS b_{m}" for m in _MEASURES)
_INSIDE = " AND ".join(f"coalesce({m} BETWEEN a_{m} - 3.0::DOUBLE * greatest(b_{m} - a_{m}, {least}::DOUBLE) AND b_{m} + 3.0::DOUBLE * greatest(b_{m} - a_{m}, {least}::DOUBLE), true)" for m, least in quality_rules.MEASURES.items())

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op4_suffix_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))) AS win, 10 AS size FROM item WHERE len(w) >= 10
  UNION ALL SELECT item_id, w, len(w) FROM item WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT size FROM windows),
keyed AS (SELECT item_id, size, array_to_string(win, ' ') AS k FROM windows),
found AS (
  SELECT p.rid, p.pos, p.size, keyed.item_id FROM (
    SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS k
    FROM d, sizes WHERE len(w) >= size) p JOIN keyed USING (size, k)),
words AS (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS word FROM found),
hit AS (SELECT rid, count(*) AS n_hit FROM words GROUP BY rid),
spans AS (SELECT rid, string_agg(a || '-' || b, ' ' ORDER BY a) AS hit_spans FROM (
  SELECT rid, min(word) - 1 AS a, max(word) AS b FROM (SELECT rid, word, word - row_number() OVER (PARTITION BY rid ORDER BY word) AS run FROM words) GROUP BY rid, run) GROUP BY rid),
lists AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid),
runs AS (SELECT rid, max(size) AS longest FROM (
  SELECT rid, max(pos) - min(pos) + max(size) AS size FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY rid, item_id, slope ORDER BY pos) AS run FROM (
      SELECT DISTINCT f.rid, f.pos, f.size, f.item_id, f.pos - i.pos AS slope FROM found f JOIN (
        SELECT item_id, size, k, pos FROM (
          SELECT item_id, 10 AS size, unnest(range(1, len(w) - 8)) AS pos, array_to_string(list_slice(w, pos, pos + 9), ' ') AS k FROM item WHERE len(w) >= 10
          UNION ALL SELECT item_id, len(w), 1, array_to_string(w, ' ') FROM item WHERE len(w) BETWEEN 1 AND 9)) i
      ON f.item_id = i.item_id AND f.size = i.size
      JOIN d ON d.rid = f.rid AND array_to_string(list_slice(d.w, f.pos, f.pos + f.size - 1), ' ') = i.k))
  GROUP BY rid, item_id, slope, run) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest_match, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN hit USING (rid) LEFT JOIN spans USING (rid) LEFT JOIN lists USING (rid) LEFT JOIN runs USING (rid)
""",
    "op1_quality_rules": rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT rid, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, x, y, z) > 1),
repeats AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
base AS (
  SELECT s.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _MEASURES.items())} FROM base),
g AS (
  SELECT lang, source, grouping(lang) AS gl, grouping(source) AS gs, count(*) FILTER (NOT base_failed) AS n, {_FENCES}
  FROM m GROUP BY GROUPING SETS ((lang, source), (lang), ())),
own AS (SELECT lang, source, n AS own_n FROM g WHERE gl = 0 AND gs = 0),
of_lang AS (SELECT lang, n AS lang_n FROM g WHERE gl = 0 AND gs = 1),
lev AS (
  SELECT m.*, CASE WHEN own_n >= 100 THEN 'source' WHEN lang_n >= 100 THEN 'lang' ELSE 'all' END AS level
  FROM m JOIN own ON m.lang IS NOT DISTINCT FROM own.lang AND m.source IS NOT DISTINCT FROM own.source
  JOIN of_lang ON m.lang IS NOT DISTINCT FROM of_lang.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept, level AS fence_level
FROM lev JOIN g ON (level = 'source' AND gl = 0 AND gs = 0 AND lev.lang IS NOT DISTINCT FROM g.lang AND lev.source IS NOT DISTINCT FROM g.source)
  OR (level = 'lang' AND gl = 0 AND gs = 1 AND lev.lang IS NOT DISTINCT FROM g.lang) OR (level = 'all' AND gl = 1 AND gs = 1)
""",
    "op2_url_filter": f"""
WITH r(host, path, action) AS (VALUES {_values(url_filter.RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (
  SELECT p.rid, r.host || r.path AS rule, r.action FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action = 'block' DESC) = 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)
""",
    "op10_licence_scan": f"""
WITH eq AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in licences.EQUIVALENT.items())}}} AS m),
known AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({_canonical("text")}) AS digest, licence FROM (VALUES {_values(licences.KNOWN.items())}) k(licence, text), eq) GROUP BY digest),
d AS (SELECT doc_id, nullif(sha256({_canonical("text")}), sha256('')) AS digest FROM documents, eq)
SELECT doc_id, digest, licence, licence IS NOT NULL AS is_licence FROM d LEFT JOIN known USING (digest)
""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL) p
  JOIN sizes sa ON sa.rid = a JOIN sizes sb ON sb.rid = b WHERE c / (sa.n + sb.n - c) >= 0.8),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS rid, min(doc_id) AS class_id FROM reach JOIN d ON d.rid = b GROUP BY a),
numbers AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, doc_id = coalesce(class_id, doc_id) AS is_first
FROM d LEFT JOIN classes USING (rid) LEFT JOIN numbers USING (rid)
""",
}
