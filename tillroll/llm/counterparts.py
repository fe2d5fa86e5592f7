"""SQL (DuckDB) that says what the queries must return, where SQL can say it."""

from __future__ import annotations

from tillroll.llm.licences import TEMPLATES

_BREAK = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_BREAK}'), lambda x: x <> '')"


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES)


def _bigrams(text: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {words} AS w))"


OP2 = f"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, generate_subscripts(l, 1) AS unit, unnest(l) AS body FROM lines
  UNION ALL SELECT doc_id, 0, text FROM lines WHERE len(l) > 1),
cut AS (SELECT doc_id, unit, {_bigrams('body')} AS g FROM units),
templates AS (SELECT name, {_bigrams('body')} AS t FROM (VALUES {_TEMPLATE_ROWS}) v(name, body)),
scored AS (
  SELECT doc_id, unit, name, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM cut JOIN templates ON len(g) >= 0.6 * len(t) AND len(g) <= 1.6 * len(t))
SELECT doc_id, unit::INT AS unit, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice
FROM scored WHERE 100 * dice >= 80 GROUP BY doc_id, unit
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
wins AS (SELECT doc_id, i, w[i:i + 4] AS win FROM starts),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '{_BREAK}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (SELECT len(l) - len(list_distinct(l)) FROM (
      SELECT list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 2 * n_dup_lines > len(string_split(text, chr(10)))
    OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))
    OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\\pL'))) > 6 * n_words
    OR (n_words >= 50 AND 10 * len(list_distinct(w)) < n_words)) AS kept
FROM judged
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(key: str, source: str) -> str:
    """Distinct five-word shingles of each row, or the whole of a shorter text."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
      SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
      FROM (SELECT {key}, {_words(_LOWER)} AS w FROM {source}) WHERE len(w) > 0)"""


OP6 = f"""
WITH items AS ({_shingles('item_id', 'benchmark')}), docs AS ({_shingles('doc_id', 'documents')}),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM items)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM docs JOIN sized USING (s)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
again AS (
  SELECT doc_id, i FROM starts
  QUALIFY row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS text, count(gone.p) AS n_removed
  FROM places LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN origin END AS refers_to
FROM best
"""

OP9 = f"""
WITH RECURSIVE s AS ({_shingles('doc_id', 'documents')}),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT reach.a AS doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY reach.a
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS h FROM d),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

COUNTERPARTS = {
    "op2_licence_scan": OP2, "op3_quality_rules": OP3, "op6_decontamination": OP6, "op7_substring_dedup": OP7,
    "op8_warc_round_trip": OP8, "op9_ngram_jaccard_join": OP9,
    "op11_fill_in_middle": OP11,
}
