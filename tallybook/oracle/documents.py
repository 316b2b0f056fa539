"""DuckDB twins of the JSON and document jobs."""

PAIRS = """
WITH c AS (SELECT c_custkey AS k, c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS bal, '"' || c_mktsegment || '"' AS seg, c_nationkey FROM customer),
b AS (SELECT *, '[' || (k % 5) || ', ' || (k % 3) || ', 7]' AS scores, '[9, ' || (k % 3) || ']' AS scores2,
  '[{"t": "a", "n": ' || (k % 2) || '}, {"t": "b", "n": null}]' AS tags,
  '{"segment": ' || seg || ', "place": {"nation": ' || c_nationkey || ', "home": true}}' AS profile FROM c),
d AS (SELECT k, '{"name": "' || c_name || '", "balance": ' || bal || ', "profile": ' || profile || ', "scores": ' || scores || ', "tags": ' || tags
    || ', "meta__old": 1, "empty": {}}' AS actual,
  CASE k % 7
    WHEN 1 THEN '{"name": "' || c_name || '", "balance": ' || (bal + 1) || ', "profile": ' || profile || ', "scores": ' || scores || ', "tags": ' || tags || ', "meta__old": 1, "empty": {}, "extra": "x"}'
    WHEN 2 THEN '{"name": "' || c_name || '", "balance": ' || bal || ', "profile": {"segment": ' || seg || '}, "scores": ' || scores || ', "tags": ' || tags || ', "meta__old": 2, "empty": {}}'
    WHEN 3 THEN '{"name": "' || c_name || '", "balance": ' || bal || ', "profile": ' || profile || ', "scores": ' || scores2 || ', "tags": ' || tags || ', "meta__old": 1, "empty": {"now": 5}}'
    WHEN 4 THEN '{"name": "' || c_name || '", "balance": ' || bal || ', "profile": ' || seg || ', "scores": ' || scores || ', "tags": ' || tags || ', "meta__old": 1, "empty": []}'
    WHEN 5 THEN '{"name": "' || c_name || '", "balance": ' || bal || ', "profile": ' || profile || ', "scores": ' || scores || ', "tags": ' || tags || ', "empty": {}, "top__x": 5, "more": {"a": 1, "b__old": 2, "c": [1, {"d": "e"}]}}'
    WHEN 6 THEN '{}' END AS p0 FROM b),
pairs AS (SELECT k, CAST(actual AS JSON) AS actual, CAST(coalesce(p0, actual) AS JSON) AS predicted FROM d),
an AS (SELECT k, fullkey, path, key, type NOT IN ('OBJECT', 'ARRAY') AS leaf, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE coalesce(CAST(atom AS VARCHAR), 'null') END AS label
  FROM pairs, json_tree(pairs.actual)),
pn AS (SELECT k, fullkey, path, key, type NOT IN ('OBJECT', 'ARRAY') AS leaf, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE coalesce(CAST(atom AS VARCHAR), 'null') END AS label
  FROM pairs, json_tree(pairs.predicted)),
changed AS (SELECT k, a.fullkey FROM an a JOIN pn p USING (k, fullkey) WHERE a.label <> p.label),
added AS (SELECT k, count(*) AS n FROM pn WHERE leaf AND (k, fullkey) NOT IN (SELECT k, fullkey FROM an)
  AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.k = pn.k AND starts_with(pn.fullkey, c.fullkey) AND substr(pn.fullkey, length(c.fullkey) + 1, 1) IN ('.', '['))
  AND NOT (contains(coalesce(key, ''), '__') AND (k, path) NOT IN (SELECT k, fullkey FROM an)) GROUP BY 1),
deleted AS (SELECT k, count(*) AS n FROM an WHERE leaf AND (k, fullkey) NOT IN (SELECT k, fullkey FROM pn)
  AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.k = an.k AND starts_with(an.fullkey, c.fullkey) AND substr(an.fullkey, length(c.fullkey) + 1, 1) IN ('.', '['))
  AND NOT (contains(coalesce(key, ''), '__') AND (k, path) NOT IN (SELECT k, fullkey FROM pn)) GROUP BY 1),
fields AS (SELECT k, count(*) FILTER (leaf AND NOT contains(fullkey, '__')) AS n FROM an GROUP BY 1),
modified AS (SELECT k, count(*) AS n FROM changed GROUP BY 1),
diff AS (SELECT f.k AS doc_id, CAST(f.n AS INT) AS total_fields, CAST(coalesce(a.n, 0) AS INT) AS additions, CAST(coalesce(d.n, 0) AS INT) AS deletions,
  CAST(coalesce(m.n, 0) AS INT) AS modifications FROM fields f LEFT JOIN added a USING (k) LEFT JOIN deleted d USING (k) LEFT JOIN modified m USING (k))
"""

#: The table of a best alignment, a row per step: the score of equal elements (1000000 each) and replaced ones (1 each).
LISTS = """
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, a, CASE doc_id % 5 WHEN 0 THEN a WHEN 1 THEN list_concat(['put in front'], a) WHEN 2 THEN a[2:] WHEN 3 THEN list_concat(a[-1:], a[:-2])
  ELSE list_concat(list_transform(a, lambda x, i: CASE WHEN i = 2 THEN '* ' || x ELSE x END), ['appended']) END AS p FROM d),
steps AS (
  SELECT doc_id, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: 0) AS s FROM e
  UNION ALL
  SELECT doc_id, i + 1, list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j])) FROM (
    SELECT s.doc_id, s.i, list_transform(range(1, len(s) + 1), lambda j: CASE WHEN j = 1 THEN s[1]
      ELSE greatest(s[j], s[j - 1] + CASE WHEN p[j - 1] = a[s.i + 1] THEN 1000000 ELSE 1 END) END) AS best
    FROM steps s JOIN e USING (doc_id) WHERE s.i < len(a)) x),
score AS (SELECT doc_id, a, p, s[-1] // 1000000 AS equal_, s[-1] % 1000000 AS replaced FROM steps JOIN e USING (doc_id) WHERE i = len(a)),
both_ AS (SELECT doc_id, 'aligned' AS mode, len(a) + 1 AS total_fields, len(p) - equal_ - replaced AS additions, len(a) - equal_ - replaced AS deletions, replaced AS modifications FROM score
  UNION ALL SELECT doc_id, 'position', len(a) + 1, greatest(len(p) - len(a), 0), greatest(len(a) - len(p), 0),
    len(list_filter(range(1, least(len(a), len(p)) + 1), lambda j: a[j] <> p[j])) FROM e)
SELECT doc_id, mode, CAST(total_fields AS INT) AS total_fields, CAST(additions AS INT) AS additions, CAST(deletions AS INT) AS deletions, CAST(modifications AS INT) AS modifications,
  CAST(additions + deletions + modifications AS INT) AS total, round(greatest(0.0::DOUBLE, 1 - CAST(additions + deletions + modifications AS DOUBLE) / total_fields), 4) AS score FROM both_"""

UPDATES = """
WITH lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') AS "publicationDate", lang AS workload, source AS item, 'f' || i AS feature,
  ls[i + 1] AS description, CASE WHEN i % 2 = 0 THEN 'New' WHEN i % 7 = 5 THEN 'Retired' ELSE 'Update' END AS status,
  array_to_string(list_slice(string_split(ls[i + 1], ' '), 1, 3), '|') AS tasks FROM lines, unnest(range(len(ls))) t(i))
"""



def card_text(pattern: str) -> str:
    """Visible text of the first match."""
    x = f"trim(regexp_replace(regexp_extract_all(card, '{pattern}', 1)[1], '<[^>]*>', '', 'g'))"
    for entity, sign in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("middot", "chr(183)"), ("copy", "chr(169)"), ("amp", "'&'")):
        x = f"regexp_replace({x}, '&{entity};?', {sign}, 'g')"  # the standard reads these names without a semicolon too
    return x


CARDS = f"""
WITH c AS (SELECT page_id, 0 AS card_number, regexp_extract(html, '(?s)(<html.*)', 1) AS card FROM pages)
SELECT page_id, card_number, {card_text('(?s)<title>(.*?)</title>')} AS product_name, {card_text('(?s)<h1>(.*?)</h1>')} AS idea, {card_text('(?s)<li>(.*?)</li>')} AS votes,
  {card_text('<html lang="([^"]*)"')} AS date, {card_text('<meta charset="([^"]*)"')} AS state, {card_text('(?s)<footer>(.*?)</footer>')} AS user_id,
  {card_text('(?s)<!--(.*?)-->')} AS like_count, {card_text('(?s)<div class="ad">(.*?)</div>')} AS description,
  string_split(string_split(regexp_extract_all(card, '<a[^>]*href="([^"]*)"', 1)[1], '/')[-1], '=')[-1] AS idea_id FROM c"""


def page_text(pattern: str) -> str:
    """The same of the whole page."""
    return card_text(pattern).replace("(card,", "(html,")


ENTRIES = f"""
WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cards FROM pages),
c AS (SELECT page_id, html, CAST(i AS INT) AS card_number, cards[i + 1] AS card FROM p, unnest(range(len(cards))) t(i))
SELECT page_id, card_number, {page_text('(?s)<title>(.*?)</title>')} AS product_name, {page_text('(?s)<h1>(.*?)</h1>')} AS idea, {card_text('(?s)^(.*)$')} AS votes,
  {page_text('<html lang="([^"]*)"')} AS date, {page_text('<meta charset="([^"]*)"')} AS state, {page_text('(?s)<footer>(.*?)</footer>')} AS user_id,
  {page_text('(?s)<!--(.*?)-->')} AS like_count, {page_text('(?s)<div class="ad">(.*?)</div>')} AS description,
  string_split(string_split(regexp_extract_all(card, '<a[^>]*href="([^"]*)"', 1)[1], '/')[-1], '=')[-1] AS idea_id FROM c"""

ORACLES = {
    "js_field_count": PAIRS + """
SELECT k AS doc_id, CAST(count(*) FILTER (leaf AND NOT contains(fullkey, '__')) AS INT) AS total_fields FROM pn GROUP BY 1""",
    "js_diff": PAIRS + "SELECT * FROM diff",
    "js_accuracy": PAIRS + """
SELECT *, additions + deletions + modifications AS total,
  round(greatest(0.0::DOUBLE, 1 - coalesce(CAST(additions + deletions + modifications AS DOUBLE) / NULLIF(total_fields, 0), 0.0::DOUBLE)), 4) AS score FROM diff""",
    "js_list_diff": LISTS,
    "js_flatten_updates": UPDATES + "SELECT * FROM u",
    "js_crosstab": UPDATES + """
SELECT workload, count(*) FILTER (status = 'New') AS new_updates, count(*) FILTER (status = 'Update') AS changed_updates,
  count(*) FILTER (status NOT IN ('New', 'Update')) AS other_updates FROM u GROUP BY 1""",
    "js_chat_messages": """
SELECT doc_id, CAST(p AS INT) AS place, CASE p WHEN 0 THEN 'system' ELSE 'user' END AS role, CASE p WHEN 0 THEN 'system' ELSE 'user' END AS name,
  CASE p WHEN 0 THEN 'List the product updates in this text as JSON.' ELSE text END AS content FROM documents, range(2) r(p)""",
    "js_flatten_items": """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS type, c_name AS name, 'Active' AS state,
  CASE WHEN c_custkey % 5 <> 0 THEN 'Creator ' || (c_custkey % 11) END AS display_name, CASE WHEN c_custkey % 5 <> 0 THEN 'u' || (c_custkey % 11) END AS creator_id,
  'w' || c_nationkey AS workspace_id, CAST(NULL AS VARCHAR) AS capacity_id,
  CASE WHEN c_custkey % 3 = 0 THEN '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS last_updated_date FROM customer""",
    "js_completion_content": "SELECT conv_id, turn, role, CAST(length(text) AS INT) AS chars FROM conversations",
    "doc_keyword_search": """
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)
SELECT DISTINCT doc_id, source FROM l, unnest(range(len(ls))) t(i) WHERE i % 2 = 0 AND contains(ls[i + 1], 'the')""",
    "doc_html_cards": CARDS,
    "doc_html_entries": ENTRIES,
    "doc_regex_connection": """
SELECT c_custkey AS expression_id, CASE WHEN c_custkey % 4 <> 0 THEN 'srv-' || c_nationkey || '.example.com' END AS server,
  CASE WHEN c_custkey % 4 <> 0 THEN 'db_' || lower(c_mktsegment) END AS database FROM customer""",
}
