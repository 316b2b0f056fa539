"""DuckDB twins of the job-log analytics."""

LINES = """
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, event_id AS k, user_id AS u FROM events),
raw AS (SELECT u AS log, k, ms, event_type, CASE
  WHEN event_type = 'view' AND k % 2 = 0 THEN '{"Event": "SparkListenerJobEnd", "Job ID": ' || k || ', "Completion Time": ' || ms ||
    CASE k % 4 WHEN 0 THEN ', "Job Result": {"Result": "JobFailed"}}' WHEN 1 THEN '}' ELSE ', "Job Result": {"Result": "JobSucceeded"}}' END
  WHEN event_type = 'view' THEN '{"Event": "SparkListenerStageCompleted", "Timestamp": ' || ms || ', "Stage Info": {"Stage ID": ' || k || ', "Stage Name": "scan ' || u ||
    '", "Number of Tasks": ' || (k % 9 + 1) || ', "Number of Complete Tasks": ' || (k % 9) || CASE WHEN k % 2 = 0 THEN ', "Number of Failed Tasks": 1}}' ELSE '}}' END
  WHEN event_type = 'click' THEN '{"Event": "SparkListenerExecutorAdded", "Executor ID": "' || k || '", "Timestamp": ' || ms || CASE WHEN k % 3 = 0 THEN ', "Resources": {"cores":4}}' ELSE '}' END
  WHEN event_type = 'signup' THEN '{"Event": "SparkListenerApplicationStart", "App Name": "app ' || u || '", "App ID": "a-' || u || '", "Timestamp": ' || ms || '}'
  WHEN event_type = 'purchase' AND k % 2 = 0 THEN '{"Event": "SparkListenerApplicationEnd", "Timestamp": ' || ms || '}'
  WHEN event_type = 'purchase' THEN '{"Event": "SparkListenerEnvironmentUpdate", "Timestamp": ' || ms || ', "Spark Properties": {"spark.app.name": "app ' || u ||
    '", "spark.executor.memory": "' || (k % 8 + 1) || 'g", "spark.executor.memoryOverhead": "1g", "spark.ui.port": "0"}, "JVM Information": {"Java Version": "' || (k % 3 + 15) || '", "Scala Version": "2.13"}}'
  WHEN k % 2 = 0 THEN '{"Timestamp": ' || ms || ', "message": "task failed with code ' || k || '"}'
  ELSE 'broken line ' || k || ' {' END AS line FROM e),
log AS (SELECT log, line, CAST(line AS JSON) AS j, coalesce(json_extract_string(CAST(line AS JSON), '$.Event'), 'Unknown') AS event,
  CAST(coalesce(json_extract_string(CAST(line AS JSON), '$.Timestamp'), json_extract_string(CAST(line AS JSON), '$."Completion Time"')) AS BIGINT) AS at_ms
  FROM raw WHERE json_valid(line))
"""


def of(kind: str) -> str:
    return f"event = 'SparkListener{kind}'"


ORACLES = {
    "lg_read": LINES + 'SELECT event, at_ms AS "at", line FROM log',
    "lg_event_counts": LINES + "SELECT log, event, count(*) AS events, CAST(sum(count(*)) OVER (PARTITION BY log) AS BIGINT) AS total_events FROM log GROUP BY 1, 2",
    "lg_application": LINES + f"""
, a AS (SELECT log, max(at_ms) FILTER ({of('ApplicationStart')}) AS s, max(at_ms) FILTER ({of('ApplicationEnd')}) AS e,
  max(json_extract_string(j, '$."App Name"')) AS name, max(json_extract_string(j, '$."App ID"')) AS id
  FROM log WHERE {of('ApplicationStart')} OR {of('ApplicationEnd')} GROUP BY 1)
SELECT log, name, id, s AS start_time, strftime(make_timestamp(s * 1000), '%Y-%m-%d %H:%M:%S') AS start_time_formatted, e AS end_time,
  CASE WHEN s IS NOT NULL THEN strftime(make_timestamp(e * 1000), '%Y-%m-%d %H:%M:%S') END AS end_time_formatted, CAST(e - s AS DOUBLE) / 1000 AS duration_sec,
  CAST(floor((e - s) / 60000.0::DOUBLE) AS BIGINT) || 'm ' || CAST(floor((floor((e - s + 50) / 100.0::DOUBLE) - floor((e - s) / 60000.0::DOUBLE) * 600) / 10) AS BIGINT) || '.'
    || CAST(CAST(floor((e - s + 50) / 100.0::DOUBLE) - floor((e - s) / 60000.0::DOUBLE) * 600 AS BIGINT) % 10 AS BIGINT) || 's' AS duration_formatted FROM a""",
    "lg_config_props": LINES + f"""
, p AS (SELECT log, json_extract(j, '$."Spark Properties"') AS ps FROM log WHERE {of('EnvironmentUpdate')}),
k AS (SELECT log, ps, unnest(json_keys(ps)) AS property FROM p)
SELECT log, property, json_extract_string(ps, '$."' || property || '"') AS setting FROM k
WHERE contains(property, 'spark.app.name') OR contains(property, 'spark.executor.memory')""",
    "lg_jvm": LINES + f"""
SELECT log, at_ms AS "at", json_extract_string(j, '$."JVM Information"."Java Version"') AS java_version,
  json_extract_string(j, '$."JVM Information"."Java Home"') AS java_home, json_extract_string(j, '$."JVM Information"."Scala Version"') AS scala_version
FROM log WHERE {of('EnvironmentUpdate')}""",
    "lg_jobs": LINES + f"""
SELECT log, CAST(json_extract_string(j, '$."Job ID"') AS BIGINT) AS id, coalesce(json_extract_string(j, '$."Job Result".Result'), 'Unknown') AS result, at_ms AS completion_time
FROM log WHERE {of('JobEnd')} QUALIFY row_number() OVER (PARTITION BY log ORDER BY completion_time, id) <= 10""",
    "lg_stages": LINES + f"""
SELECT log, CAST(json_extract_string(j, '$."Stage Info"."Stage ID"') AS BIGINT) AS id, json_extract_string(j, '$."Stage Info"."Stage Name"') AS name,
  CAST(json_extract_string(j, '$."Stage Info"."Number of Tasks"') AS BIGINT) AS tasks,
  CAST(json_extract_string(j, '$."Stage Info"."Number of Complete Tasks"') AS BIGINT) AS successful_tasks,
  coalesce(CAST(json_extract_string(j, '$."Stage Info"."Number of Failed Tasks"') AS BIGINT), 0) AS failed_tasks
FROM log WHERE {of('StageCompleted')} QUALIFY row_number() OVER (PARTITION BY log ORDER BY at_ms, id) <= 10""",
    "lg_executors": LINES + f"""
SELECT log, json_extract_string(j, '$."Executor ID"') AS id, at_ms AS added_time, coalesce(CAST(json_extract(j, '$.Resources') AS VARCHAR), '{{}}') AS resources
FROM log WHERE {of('ExecutorAdded')} QUALIFY row_number() OVER (PARTITION BY log ORDER BY added_time, id) <= 10""",
    "lg_exceptions": LINES + """
SELECT log, event, at_ms AS "at", line FROM log WHERE regexp_matches(line, 'Error|error|exception|Exception|Failed|failed')
QUALIFY row_number() OVER (PARTITION BY log ORDER BY at_ms, line) <= 20""",
}
