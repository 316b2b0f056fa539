"""DuckDB twins of the stream steps."""


def text(mark: str) -> str:
    return f"""('{{"Step": ' || (event_id % 4 + 1) || ', "Type": "' || upper(event_type) || '{mark}", "Amount": ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) ||
  ', "NameOrig": "C' || user_id || '", "OldBalanceOrig": 10.5, "NewBalanceOrig": ' || (event_id % 1000) || '.25, "NameDest": "M' || user_id ||
  '", "OldBalanceDest": 0.0, "NewBalanceDest": 1.0, "IsFraud": ' || (event_id % 2) || ', "IsFlaggedFraud": 0, "Rec": 1, "DateTimeNow": "' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}}')"""


DECODED = f"""
WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN {text('')} WHEN 1 THEN base64(encode({text('')}))
  WHEN 2 THEN regexp_replace(base64(encode({text('')})), '=+$', '') WHEN 3 THEN {text('=x')} ELSE 'broken ' || event_id || ' {{' END AS body FROM events),
d AS (SELECT event_id, CASE WHEN contains(body, '=') AND event_id % 5 = 1 THEN decode(from_base64(CASE WHEN event_id % 5 = 1 THEN body ELSE '' END)) ELSE body END AS body FROM b)
"""


def field(name: str, kind: str) -> str:
    return f"CAST(json_extract_string(j, '$.{name}') AS {kind}) AS \"{name}\""


PARSED = DECODED + f""",
j AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM d),
p AS (SELECT event_id, body, j IS NULL AS bad, {field('Step', 'INT')}, {field('Type', 'VARCHAR')}, {field('Amount', 'DOUBLE')}, {field('NameOrig', 'VARCHAR')},
  {field('OldBalanceOrig', 'DOUBLE')}, {field('NewBalanceOrig', 'DOUBLE')}, {field('NameDest', 'VARCHAR')}, {field('OldBalanceDest', 'DOUBLE')},
  {field('NewBalanceDest', 'DOUBLE')}, {field('IsFraud', 'INT')}, {field('IsFlaggedFraud', 'INT')}, {field('Rec', 'INT')},
  replace(json_extract_string(j, '$.DateTimeNow'), 'T', ' ') AS "DateTimeNow" FROM j)
"""

ORACLES = {
    "st_decode_events": DECODED + "SELECT * FROM d",
    "st_parse_events": PARSED + "SELECT * EXCLUDE (body, bad) FROM p",
    "st_ingest": PARSED + "SELECT * EXCLUDE (event_id, body, bad) FROM p",
    "st_ingest_once": PARSED + "SELECT * EXCLUDE (event_id, body, bad), CASE WHEN bad THEN body END AS body, CASE WHEN bad THEN 'malformed body' END AS reason FROM p",
}
