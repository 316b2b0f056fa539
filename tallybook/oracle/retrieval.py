"""DuckDB twins of the retrieval evaluation."""

SPACE = " || ".join(f"chr({code})" for code in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def stripped(x: str) -> str:
    return f"trim(replace({x}, chr(0), ' '), {SPACE})"


def words(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


CORPUS = f"""
WITH docs AS (SELECT doc_id, {stripped('text')} AS text, {words('text')} AS plain, embedding AS v FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
items AS (SELECT item_id AS query_id, string_split({words('text')}, ' ') AS w FROM benchmark),
passages AS (SELECT DISTINCT query_id, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS p FROM items, range(1, 100000) r(i) WHERE i <= greatest(len(w) - 7, 1)),
gold AS (SELECT DISTINCT query_id, doc_id FROM docs, passages WHERE contains(' ' || plain || ' ', ' ' || p || ' ')),
pairs AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id FROM docs UNION SELECT query_id, doc_id FROM gold),
cand AS (SELECT query_id, doc_id, text, v FROM pairs JOIN docs USING (doc_id) WHERE query_id IN (SELECT query_id FROM gold))
"""


def dot(dims: int) -> str:
    return f"""round(list_sum(list_transform(range(1, {dims + 1}), lambda i: CAST(cand.v[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6)"""


SCORES = CORPUS + f""",
toks AS (SELECT query_id, doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1) AS ws FROM cand),
terms AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1)) AS term FROM benchmark),
corp AS (SELECT query_id, count(*) AS n, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS avgdl FROM toks GROUP BY 1),
df AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, unnest(list_distinct(ws)) AS term FROM toks) GROUP BY 1, 2),
idf AS (SELECT query_id, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df JOIN corp USING (query_id)),
low AS (SELECT query_id, 0.25::DOUBLE * avg(idf) AS eps FROM idf GROUP BY 1),
wt AS (SELECT query_id, term, CASE WHEN idf < 0 THEN eps ELSE idf END AS w FROM terms JOIN idf USING (query_id, term) JOIN low USING (query_id)),
tf AS (SELECT query_id, doc_id, len, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(ws) AS len, unnest(ws) AS term FROM toks) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS bm25
  FROM tf JOIN wt USING (query_id, term) JOIN corp USING (query_id) GROUP BY 1, 2),
scores AS (SELECT cand.query_id AS query_id, cand.doc_id AS doc_id, coalesce(bm25, 0.0::DOUBLE) AS bm25, {dot(64)} AS dense, {dot(32)} AS dense_small
  FROM cand LEFT JOIN bm ON bm.query_id = cand.query_id AND bm.doc_id = cand.doc_id LEFT JOIN embeddings q ON q.vec_id = cand.query_id),
scaled AS (SELECT query_id, doc_id,
  CASE WHEN max(dense) OVER p - min(dense) OVER p <= 1e-8 THEN 0.0::DOUBLE ELSE (dense - min(dense) OVER p) / (max(dense) OVER p - min(dense) OVER p) END AS dense,
  CASE WHEN max(bm25) OVER p - min(bm25) OVER p <= 1e-8 THEN 0.0::DOUBLE ELSE (bm25 - min(bm25) OVER p) / (max(bm25) OVER p - min(bm25) OVER p) END AS bm25
  FROM scores WINDOW p AS (PARTITION BY query_id)),
top AS (SELECT query_id, doc_id, dense AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id DESC) AS INT) AS place FROM scores WHERE dense IS NOT NULL QUALIFY place <= 3),
small AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense_small DESC, doc_id DESC) AS INT) AS place FROM scores WHERE dense_small IS NOT NULL QUALIFY place <= 3),
hits AS (SELECT query_id, max(CASE WHEN g.doc_id IS NOT NULL AND place = 1 THEN 1 ELSE 0 END) AS hit_at_1, max(CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit_at_3
  FROM top LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1),
small_hits AS (SELECT query_id, max(CASE WHEN g.doc_id IS NOT NULL AND place = 1 THEN 1 ELSE 0 END) AS hit_at_1, max(CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit_at_3
  FROM small LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1),
mixed AS (SELECT a / 10.0::DOUBLE AS alpha, query_id, doc_id, a / 10.0::DOUBLE * coalesce(dense, 0.0::DOUBLE) + (1.0::DOUBLE - a / 10.0::DOUBLE) * bm25 AS s FROM scaled, range(11) r(a)),
mtop AS (SELECT alpha, query_id, doc_id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY s DESC, doc_id DESC) AS place FROM mixed QUALIFY place <= 3),
mhits AS (SELECT alpha, query_id, max(CASE WHEN g.doc_id IS NOT NULL AND place = 1 THEN 1 ELSE 0 END) AS hit_at_1, max(CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit_at_3
  FROM mtop LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1, 2),
sweep AS (SELECT alpha, count(*) AS queries, round(CAST(100 * sum(hit_at_1) AS DOUBLE) / count(*), 1) AS recall_at_1, round(CAST(100 * sum(hit_at_3) AS DOUBLE) / count(*), 1) AS recall_at_3
  FROM mhits GROUP BY 1),
best AS (SELECT * FROM sweep ORDER BY recall_at_1 DESC, recall_at_3 DESC, abs(alpha - 0.5::DOUBLE), alpha LIMIT 1),
summary AS (SELECT 'dense 64' AS system, * FROM hits UNION ALL SELECT 'dense 32', * FROM small_hits),
recall AS (SELECT system, count(*) AS queries, round(CAST(100 * sum(hit_at_1) AS DOUBLE) / count(*), 1) AS recall_at_1, round(CAST(100 * sum(hit_at_3) AS DOUBLE) / count(*), 1) AS recall_at_3
  FROM summary GROUP BY 1)
"""

ORACLES = {
    "ir_gold_ids": """
WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [(doc_id % 4) || 'a', (doc_id % 5) || 'b', 'x1', (doc_id % 13) || 'c'] END AS r,
  CASE WHEN doc_id % 6 = 0 THEN [] ELSE [(doc_id % 7) || 'c', '12', 'c3'] END AS u FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(r) > 0 THEN r ELSE u END) AS s FROM k),
n AS (SELECT DISTINCT doc_id, TRY_CAST(regexp_extract(s, '^(\\d+)', 1) AS BIGINT) AS i FROM g WHERE regexp_matches(s, '^\\d'))
SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS gold_doc_ids FROM n GROUP BY 1""",
    "ir_clean_docs": f"""
SELECT doc_id, {stripped("' ' || chr(9) || chr(0) || text || chr(160) || chr(10) || ' '")} AS document FROM documents""",
    "ir_seeded_sample": """
SELECT * FROM (SELECT doc_id, lang, source FROM documents ORDER BY sha256(doc_id || ':42'), doc_id LIMIT 80) ORDER BY doc_id""",
    "ir_corpus_stats": CORPUS + """
, q AS (SELECT query_id, count(*) AS n, sum(length(text)) AS c FROM cand GROUP BY 1)
SELECT count(*) AS examples, CAST(sum(n) AS DOUBLE) / count(*) AS avg_candidates, CAST(sum(c) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS avg_chars FROM q""",
    "ir_bm25": SCORES + "SELECT query_id, doc_id, bm25 FROM scores",
    "ir_bm25_topk": SCORES + """
SELECT query_id, doc_id, bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id DESC) AS INT) AS place FROM bm QUALIFY place <= 3""",
    "ir_dense_scores": SCORES + "SELECT query_id, doc_id, dense FROM scores",
    "ir_minmax": SCORES + "SELECT * FROM scaled",
    "ir_topk": SCORES + "SELECT * FROM top",
    "ir_hit_metrics": SCORES + "SELECT * FROM hits",
    "ir_recall_summary": SCORES + "SELECT * FROM recall",
    "ir_alpha_sweep": SCORES + "SELECT * FROM sweep",
    "ir_best_alpha": SCORES + "SELECT * FROM best",
    "ir_system_comparison": SCORES + """
SELECT * FROM recall UNION ALL SELECT 'dense 64 + BM25 (alpha=' || format('{:.1f}', alpha) || ')', queries, recall_at_1, recall_at_3 FROM best""",
    "ir_improved_examples": SCORES + """
SELECT h.query_id, m.hit_at_1 AS hybrid_hit, h.hit_at_1 AS dense_hit, m.hit_at_1 > h.hit_at_1 AS improved
FROM mhits m JOIN hits h USING (query_id) WHERE alpha = (SELECT alpha FROM best) ORDER BY improved DESC, 1 LIMIT 3""",
}
