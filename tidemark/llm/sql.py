"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_BLOCK = [
    "ads", "adserver", "doubleclick", "banner", "casino", "poker", "betting", "porn", "xxx", "escort", "viagra", "torrent", "warez", "login", "signin", "logout",
    "register", "checkout", "cart", "password", "wp-login.php", "wp-admin", "cgi-bin", "phpmyadmin", "xmlrpc.php", "sitemap.xml", "robots.txt",
]
_WORD = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
_BLOCKING = [(f"^{w}^", _WORD.format(w.replace(".", r"\."))) for w in _BLOCK]
_BLOCKING.append(("^tracking^*^pixel^", _WORD.format("tracking") + ".*" + _WORD.format("pixel").replace("(^|[^a-z0-9])", "([^a-z0-9]|$)", 1)))
#: The greatest of the blocking patterns that match.
_BLOCKED = ", ".join(f"CASE WHEN regexp_matches(lower(url), '{regex}') THEN '{glob}' END" for glob, regex in _BLOCKING)

URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
named AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
fits AS (
  SELECT *, '.' || host AS dotted FROM named),
ruled AS (
  SELECT *, CASE
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM fits),
matched AS (
  SELECT *, CASE
    WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(lower(url), '(^|[^a-z0-9])login([^a-z0-9]|$).*([^a-z0-9]|$)help([^a-z0-9]|$)') THEN '^login^*^help^'
    ELSE greatest({_BLOCKED}) END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern = '^login^*^help^' THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       url, pattern
FROM matched
"""

SUBSTRING_DEDUP = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
least AS (SELECT win, min(doc_id) AS lo FROM grams GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM grams JOIN least USING (win) WHERE lo < doc_id),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = words.r AND gone.p = words.p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

SOURCE_DIVERGENCE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
terms AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS MATERIALIZED (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
totals AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p
  FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(all_n) + any_value(v))::HUGEINT AS q
  FROM counts JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM counts GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

SQL: dict[str, str] = {
    "op2_url_filter": URL_FILTER,
    "op4_decontamination": DECONTAMINATION,
    "op11_substring_dedup": SUBSTRING_DEDUP,
    "op13_source_divergence": SOURCE_DIVERGENCE,
}
