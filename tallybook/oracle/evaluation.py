"""DuckDB twins of the answer evaluation."""

NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?(?:[kmb]\b|%)?"


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '`+', ' ', 'g'), "
        rf"'[^\p{{L}}\p{{N}}_\s.%/-]', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all(replace(lower(strip_accents({x})), '$', ''), '{NUMBER}')"


def read(t: str) -> str:
    return (
        f"(CAST(regexp_replace({t}, '[,%kmb]', '', 'g') AS DOUBLE) * CASE WHEN ends_with({t}, 'k') THEN 1000.0::DOUBLE "
        f"WHEN ends_with({t}, 'm') THEN 1000000.0::DOUBLE WHEN ends_with({t}, 'b') THEN 1000000000.0::DOUBLE ELSE 1.0::DOUBLE END)"
    )


def values(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({tokens(x)}, lambda t: CASE WHEN ends_with(t, '%') "
        f"THEN [{read('t')}, {read('t')} / 100.0::DOUBLE] ELSE [{read('t')}] END)))"
    )


def distinct_count(x: str) -> str:
    return f"len(list_distinct(list_transform({tokens(x)}, lambda t: {read('t')})))"


CASES = """
WITH people AS (SELECT *, c_custkey AS k, c_custkey % 6 AS kind, (c_custkey // 6) % 4 AS turn, CAST(c_acctbal AS DECIMAL(12,2)) AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
near AS (SELECT *, CAST(bal * CASE turn WHEN 1 THEN 1.005 WHEN 2 THEN 1.050 ELSE 1.000 END AS DECIMAL(14,2)) AS nb FROM people),
cases AS (SELECT k, 'q' || k AS question_id, CASE WHEN k % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split,
  CASE WHEN kind = 3 THEN 'single_entity' ELSE 'scalar' END AS slice, CASE WHEN kind = 3 THEN 'single_entity' ELSE 'scalar' END AS expected_shape,
  'What is known about ' || c_name || '?' AS question,
  CASE kind WHEN 0 THEN CAST(bal AS VARCHAR) WHEN 1 THEN '$' || format('{:,.2f}', CAST(bal AS DOUBLE)) WHEN 2 THEN 'No results'
    WHEN 3 THEN n_name WHEN 4 THEN (k % 100) || '%' ELSE 'Recurring revenue is $' || (k % 9 + 1) || ',400,000.' END AS expected,
  CASE WHEN turn = 3 AND kind < 2 THEN 'I was unable to find data.' ELSE CASE kind
    WHEN 0 THEN 'The balance is ' || CAST(nb AS VARCHAR) || ' in total'
    WHEN 1 THEN 'It comes to $' || format('{:,.2f}', CAST(nb AS DOUBLE)) || '.'
    WHEN 2 THEN ['No matching records were found.', 'no  résults', 'There are 7 of them.', 'Nothing.'][turn + 1]
    WHEN 3 THEN [lower(n_name), 'The nation is ' || n_name, 'NATION_0', 'I do not know'][turn + 1]
    WHEN 4 THEN ['The rate is ' || format('{:.2f}', (k % 100) / 100.0::DOUBLE), (k % 100) || ' % of all', 'about ' || ((k + 7) % 100) || '%', 'between 3 and 400'][turn + 1]
    ELSE ['MRR is $' || (k % 9 + 1) || '.4M.', 'MRR is ' || (k % 9 + 1) || '.4 million', 'MRR is 3.1k', 'MRR is $1.4M and retention is 71%'][turn + 1] END END AS actual,
  ['pass', 'Failed', 'TRUE', 'n/a', 'incorrect'][k % 5 + 1] AS sdk FROM near)
"""

SCORED = CASES + f""",
nums AS (SELECT *, {values('expected')} AS ev, {distinct_count('expected')} AS en, {values('actual')} AS av, {distinct_count('actual')} AS an,
  {norm('expected')} AS want, {norm('actual')} AS got FROM cases),
compared AS (SELECT *, CASE WHEN en <> 1 OR len(av) = 0 THEN NULL
  WHEN len(list_filter(av, lambda a: len(list_filter(ev, lambda e: abs(a - e) <= greatest(abs(e) * 0.01::DOUBLE, 0.01::DOUBLE))) > 0)) > 0 THEN true
  WHEN an = 1 THEN false END AS numeric_match FROM nums),
verdicts AS (SELECT *, CASE WHEN want = got THEN 'exact_match'
  WHEN want = 'no results' AND regexp_matches(got, 'no results|no matching|no records|unable to find|could not find') THEN 'no_results_match'
  WHEN expected_shape = 'scalar' AND numeric_match THEN 'numeric_match'
  WHEN expected_shape = 'scalar' AND NOT numeric_match THEN 'numeric_mismatch' END AS why FROM compared)
"""

FULL = """'{"verdict": "' || ['yes', 'No, wrong entity', ' YES ', 'maybe'][c_custkey % 4 + 1] || '", "reason_code": "r' || (c_custkey % 3)
  || '", "numeric_match": true, "entity_match": "no", "rank_match": 1, "time_scope_match": null, "measure_match": "n/a", "notes": "n {' || c_custkey || '}"}'"""


def flag(name: str) -> str:
    word = f"lower(trim(json_extract_string(js, '$.{name}')))"
    return f"CASE WHEN {word} IN ('true', 'yes', '1') THEN true WHEN {word} IN ('false', 'no', '0') THEN false END AS {name}"


JUDGE = f"""
full_reply AS (SELECT c_custkey AS k, c_name, {FULL} AS f FROM customer),
raw AS (SELECT k, 'What is known about ' || c_name || '?' AS question, CASE k % 7 WHEN 1 THEN '```json' || chr(10) || f || chr(10) || '```'
  WHEN 2 THEN 'Sure, here it is: ' || f || ' Hope this helps.' WHEN 3 THEN '{{"reason_code": "none_given"}}' WHEN 4 THEN '{{broken ' || f
  WHEN 5 THEN 'I cannot judge this.' ELSE chr(10) || f END AS reply FROM full_reply),
body AS (SELECT *, regexp_extract(reply, '(?s)\\{{.*\\}}') AS b FROM raw),
js AS (SELECT question, CASE WHEN b <> '' AND json_valid(b) THEN CAST(b AS JSON) END AS js FROM body),
judge AS (SELECT question, js IS NOT NULL AS parse_ok,
  CASE WHEN js IS NOT NULL THEN CASE WHEN starts_with(lower(trim(coalesce(json_extract_string(js, '$.verdict'), 'none'))), 'yes') THEN 'yes'
    WHEN starts_with(lower(trim(coalesce(json_extract_string(js, '$.verdict'), 'none'))), 'no') THEN 'no' ELSE 'unexpected' END END AS verdict,
  json_extract_string(js, '$.reason_code') AS reason_code, {flag('numeric_match')}, {flag('entity_match')}, {flag('rank_match')},
  {flag('time_scope_match')}, {flag('measure_match')}, json_extract_string(js, '$.notes') AS notes FROM js)
"""

MERGED = SCORED + "," + JUDGE + """,
scores AS (SELECT question_id, split, slice, verdicts.question AS question,
  CASE WHEN lower(sdk) IN ('pass', 'true') THEN true WHEN lower(sdk) IN ('failed', 'incorrect') THEN false END AS sdk_pass,
  CASE WHEN why IS NULL THEN judge.verdict WHEN why = 'numeric_mismatch' THEN 'no' ELSE 'yes' END AS robust_verdict,
  CASE WHEN why IS NULL THEN 'judge' ELSE 'heuristic' END AS score_source,
  CASE WHEN why IS NULL THEN judge.reason_code ELSE 'heuristic_' || why END AS reason_code
  FROM verdicts LEFT JOIN judge ON judge.question = verdicts.question),
final AS (SELECT *, coalesce(robust_verdict = 'yes', false) AS robust_pass,
  sdk_pass IS NOT DISTINCT FROM coalesce(robust_verdict = 'yes', false) AS sdk_vs_robust_match FROM scores)
"""

CALIBRATION = """
cal AS (SELECT doc_id, quality = 1 AS pos, CASE WHEN doc_id % 17 = 0 THEN 'unexpected' WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS j FROM labels),
conf AS (SELECT count(*) AS cases, count(*) FILTER (pos AND j = 'yes') AS tp, count(*) FILTER (NOT pos AND j = 'yes') AS fp,
  count(*) FILTER (pos AND j = 'no') AS fn, count(*) FILTER (NOT pos AND j = 'no') AS tn FROM cal),
rates AS (SELECT *, CAST(tp + tn AS DOUBLE) / cases AS judge_accuracy, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0::DOUBLE) AS judge_precision,
  coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0::DOUBLE) AS judge_recall, coalesce(CAST(fp AS DOUBLE) / NULLIF(tn + fp, 0), 0.0::DOUBLE) AS judge_fpr FROM conf)
"""
CORRECTED = "CASE WHEN judge_recall - judge_fpr > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({0} - judge_fpr) / (judge_recall - judge_fpr))) ELSE {0} END"

RESULTS = """
WITH counted AS (SELECT n_name AS question_id, n_nationkey, c_mktsegment AS segment, count(*) AS customers,
  CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
res AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY customers DESC, segment) AS place FROM counted
  QUALIFY place <= [0, 1, 5][n_nationkey % 3 + 1])
"""
CELL = """CASE WHEN abs(balance - round(balance)) <= 1e-9 * greatest(abs(balance), abs(round(balance))) THEN CAST(CAST(round(balance) AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(format('{:.6f}', balance), '\\.?0+$', '') END"""

SUMMARY = """count(*) AS questions, CAST(count(*) FILTER (robust_pass) AS DOUBLE) / count(*) AS robust_accuracy,
  CAST(count(*) FILTER (sdk_pass) AS DOUBLE) / NULLIF(count(sdk_pass), 0) AS sdk_accuracy,
  CAST(count(*) FILTER (score_source = 'heuristic') AS DOUBLE) / count(*) AS heuristic_share"""

ORACLES = {
    "ev_format_answer": RESULTS + f""",
lines AS (SELECT question_id, place, 'segment: ' || segment || ', customers: ' || customers || ', balance: ' || {CELL} AS line FROM res),
packed AS (SELECT question_id, count(*) AS n, max(line) AS one, string_agg(place || '. ' || line, chr(10) ORDER BY place) AS many FROM lines GROUP BY 1)
SELECT n_name AS question_id, CASE WHEN n IS NULL THEN 'No results' WHEN n = 1 THEN one ELSE many END AS answer_text
FROM nation LEFT JOIN packed ON n_name = question_id""",
    "ev_structured_truth": RESULTS + """,
packed AS (SELECT question_id, count(*) AS n, string_agg('{"segment":"' || segment || '","customers":' || customers || '}', ',' ORDER BY place) AS rows FROM res GROUP BY 1)
SELECT n_name AS question_id, CASE WHEN n IS NULL THEN '{"columns":[],"rows":[],"row_count":0}'
  ELSE '{"columns":["segment","customers"],"rows":[' || rows || '],"row_count":' || n || '}' END AS truth_json
FROM nation LEFT JOIN packed ON n_name = question_id""",
    "ev_normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "ev_extract_numbers": f"""
WITH t AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
e AS (SELECT doc_id, CAST(i AS INT) AS position, ts[i + 1] AS token FROM t, unnest(range(len(ts))) u(i))
SELECT doc_id, position, token, {read('token')} AS value, CASE WHEN ends_with(token, '%') THEN {read('token')} / 100.0::DOUBLE END AS fraction FROM e""",
    "ev_compare_numeric": SCORED + "SELECT question_id, numeric_match FROM compared",
    "ev_deterministic_verdict": SCORED + """
SELECT question_id, CASE WHEN why = 'numeric_mismatch' THEN 'no' WHEN why IS NOT NULL THEN 'yes' END AS verdict,
  'heuristic_' || why AS reason_code, CASE WHEN why IS NOT NULL THEN 'heuristic' END AS score_source FROM verdicts""",
    "ev_parse_judge_payload": "WITH " + JUDGE + "SELECT * FROM judge",
    "ev_calibration_metrics": "WITH " + CALIBRATION + """
SELECT *, judge_recall AS judge_tpr, coalesce(2 * judge_precision * judge_recall / NULLIF(judge_precision + judge_recall, 0), 0.0::DOUBLE) AS judge_f1,
  CASE WHEN judge_accuracy < 0.75 THEN 'low' WHEN judge_accuracy < 0.90 THEN 'moderate' ELSE 'high' END AS reliability FROM rates""",
    "ev_calibration_by_group": "WITH " + CALIBRATION + """
SELECT lang AS case_group, count(*) AS cases, CAST(count(*) FILTER (j = CASE WHEN pos THEN 'yes' ELSE 'no' END) AS DOUBLE) / count(*) AS accuracy,
  count(*) FILTER (j <> CASE WHEN pos THEN 'yes' ELSE 'no' END) AS failures FROM cal JOIN documents USING (doc_id) GROUP BY 1""",
    "ev_rescore_merge": MERGED + "SELECT * FROM final",
    "ev_adjusted_accuracy": MERGED + "," + CALIBRATION + f""",
s AS (SELECT count(*) AS n, count(*) FILTER (sdk_pass) AS sdk, count(*) FILTER (robust_pass) AS rob,
  count(*) FILTER (score_source = 'judge') AS jn, count(*) FILTER (score_source = 'judge' AND robust_pass) AS jp,
  count(*) FILTER (score_source <> 'judge' AND robust_pass) AS hp,
  CAST(count(*) FILTER (split = 'holdout' AND robust_pass) AS DOUBLE) / NULLIF(count(*) FILTER (split = 'holdout'), 0) AS holdout FROM final),
o AS (SELECT *, coalesce(CAST(jp AS DOUBLE) / NULLIF(jn, 0), 0.0::DOUBLE) AS obs FROM s, rates),
a AS (SELECT *, (hp + {CORRECTED.format('obs')} * jn) / n AS adj, (1 - judge_accuracy) * jn / n AS slack FROM o)
SELECT n AS total_questions, CAST(sdk AS DOUBLE) / n AS sdk_accuracy, CAST(rob AS DOUBLE) / n AS robust_accuracy, adj AS adjusted_accuracy,
  greatest(0.0::DOUBLE, adj - slack) AS adjusted_lower_bound, least(1.0::DOUBLE, adj + slack) AS adjusted_upper_bound, judge_accuracy,
  jn AS judge_scored_questions, n - jn AS heuristic_scored_questions, holdout AS holdout_accuracy FROM a""",
    "ev_adjusted_accuracy_simple": CASES + "," + CALIBRATION + f""",
s AS (SELECT count(*) AS n, count(*) FILTER (lower(sdk) IN ('true', 'yes', '1')) AS p FROM cases),
a AS (SELECT *, CAST(p AS DOUBLE) / n AS obs, {CORRECTED.format('(CAST(p AS DOUBLE) / n)')} AS adj FROM s, rates)
SELECT n AS total_questions, p AS passed, obs * 100 AS raw_accuracy_percent, adj AS adjusted_pass_rate,
  greatest(0.0::DOUBLE, adj - (1 - judge_accuracy)) AS lower_bound, least(1.0::DOUBLE, adj + (1 - judge_accuracy)) AS upper_bound FROM a""",
    "ev_split_summary": MERGED + f"SELECT split, {SUMMARY}, count(*) FILTER (NOT sdk_vs_robust_match) AS disagreements FROM final GROUP BY 1",
    "ev_slice_summary": MERGED + f"SELECT split, slice, {SUMMARY} FROM final GROUP BY 1, 2",
    "ev_disagreements": MERGED + "SELECT * FROM final WHERE NOT sdk_vs_robust_match",
    "ev_question_summary": """
WITH r AS (SELECT user_id AS question, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN true WHEN event_type = 'error' THEN false END AS ok FROM events),
s AS (SELECT question, count(*) FILTER (ok) AS true_runs, count(*) FILTER (NOT ok) AS false_runs, count(*) FILTER (ok IS NULL) AS unclear_runs,
  CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) * 100 AS true_percent FROM r GROUP BY 1)
SELECT s.*, r.event_id AS failed_thread FROM s LEFT JOIN r ON r.question = s.question AND NOT ok""",
    "ev_split_size_check": """
SELECT lang || '/' || source AS split, count(*) AS cases FROM documents GROUP BY 1 HAVING count(*) < 30""",
    "ev_dataset_fingerprint": CASES + """
SELECT count(*) AS records, CAST(sum(CAST(CAST('0x' || substr(sha256(coalesce(length(CAST(question_id AS VARCHAR)) || ':' || CAST(question_id AS VARCHAR), '-') || coalesce(length(CAST(split AS VARCHAR)) || ':' || CAST(split AS VARCHAR), '-') || coalesce(length(CAST(slice AS VARCHAR)) || ':' || CAST(slice AS VARCHAR), '-') || coalesce(length(CAST(expected_shape AS VARCHAR)) || ':' || CAST(expected_shape AS VARCHAR), '-') || coalesce(length(CAST(question AS VARCHAR)) || ':' || CAST(question AS VARCHAR), '-') || coalesce(length(CAST(expected AS VARCHAR)) || ':' || CAST(expected AS VARCHAR), '-')), 1, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)
  AS fingerprint FROM cases""",
}
