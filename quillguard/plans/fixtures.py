"""Derived inputs, written once in SQL that both Spark and DuckDB run.

Integer arithmetic on keys gives identity numbers, phones, cards and the like, set into
sentences of our own, so both engines see the same rows at any scale.
"""

from __future__ import annotations

_K = "c_custkey"
_AREA = f"lpad(cast(({_K} * 7919) % 905 as string), 3, '0')"
_GROUP = f"lpad(cast(({_K} * 31) % 100 as string), 2, '0')"
_SERIAL = f"lpad(cast(({_K} * 37) % 10000 as string), 4, '0')"
_DASHED = f"{_AREA} || '-' || {_GROUP} || '-' || {_SERIAL}"
_PLAIN = f"{_AREA} || {_GROUP} || {_SERIAL}"
_MRN = f"lpad(cast(({_K} * 104729) % 10000000 as string), 7, '0')"
_MONTH = f"lpad(cast({_K} % 14 as string), 2, '0')"
_DAY = f"lpad(cast(({_K} * 3) % 33 as string), 2, '0')"
_YEAR = f"cast(1900 + ({_K} * 7) % 200 as string)"
_P3 = f"cast(200 + {_K} % 700 as string)"
_P4 = f"lpad(cast(({_K} * 77) % 10000 as string), 4, '0')"
_G = [f"lpad(cast(({_K} * {m}) % 10000 as string), 4, '0')" for m in (131, 137, 139, 149)]
_CARD = " || '-' || ".join(_G)
_CARD16 = " || ".join(_G)
_V4 = f"cast({_K} % 300 as string) || '.' || cast(({_K} * 3) % 256 as string) || '.' || cast(({_K} * 5) % 256 as string) || '.' || cast(({_K} * 7) % 256 as string)"
_HEXLET = f"lpad(cast(({_K} * 11) % 10000 as string), 4, '0')"
_PASS = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({_K} % 26 as int) + 1, 1) || lpad(cast(({_K} * 7907) % 100000000 as string), 8, '0')"
_MAIL = f"'user.' || cast({_K} as string) || '@mail' || cast({_K} % 9 as string) || '.example.com'"

#: Sentences of the samples; ours, one branch per kind of evidence.
TEMPLATES = [
    f"'Employee SSN ' || {_DASHED} || ' is on file.'",
    f"'The social security number ' || {_PLAIN} || ' was checked.'",
    f"'Track parcel ' || {_PLAIN} || ' by its serial.'",
    f"'Reach me at (' || {_P3} || ') ' || {_P3} || '-' || {_P4} || ' or ' || {_MAIL} || '.'",
    f"'Office line +44 20 ' || {_P4} || ' ' || {_P4} || ', desk +1-' || {_P3} || '-' || {_P3} || '-' || {_P4}",
    f"'Chart MRN-' || {_MRN} || ' replaces mrn-' || {_MRN} || '.'",
    f"'Their daughter, born ' || {_MONTH} || '/' || {_DAY} || '/' || {_YEAR} || ', swims.'",
    f"'The deadline passed on ' || {_MONTH} || '/' || {_DAY} || '/' || {_YEAR} || '.'",
    f"'Visa card ' || {_CARD} || ' was charged.'",
    f"'Her credit card ' || {_CARD16} || ' passed.'",
    f"'Tracking id ' || {_CARD16} || ' left the dock.'",
    f"'Host ' || {_V4} || ' answers on 2001:db8::' || {_HEXLET} || ' too.'",
    f"'Mapped ::ffff:' || {_V4} || ' and fe80:0:0:0:1:2:3:' || {_HEXLET} || ' seen.'",
    f"'Passport ' || {_PASS} || ' expires soon.'",
    f"'Tax id ' || {_PLAIN} || ', again SSN ' || {_DASHED} || ', mail ' || {_MAIL} || ', mail ' || {_MAIL}",
    "'Nothing private in std::string here.'",
    f"'Form field date of birth ' || {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} || '; age unknown.'",
    f"'A bare ' || {_PLAIN} || ' and a lone :: sign'",
]
SAMPLES = f"SELECT {_K} AS id, CASE {_K} % {len(TEMPLATES)} " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(TEMPLATES)) + " END AS text FROM customer"

#: Hits of an entity model, made from keys: up to three per sample, some below the threshold.
HITS = f"""SELECT {_K} AS id, n, CASE ({_K} + n) % 5 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' WHEN 3 THEN 'MISC' ELSE 'PATIENT' END AS entity_group,
  cast(({_K} * (n + 3)) % 24 as int) AS start, cast(({_K} * (n + 3)) % 24 + 3 + ({_K} + n * 5) % 12 as int) AS stop,
  cast((70 + ({_K} * 13 + n * 7) % 30) as double) / 100.0 AS score
  FROM customer CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n) q"""

#: Request, response and stream bodies around conversation turns, odd ones among them.
QUOTED = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
BODIES = f"""SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 10
  WHEN 0 THEN '{{"messages":[{{"role":"system","content":"x"}},{{"role":"user","content":"' || {QUOTED} || '"}}]}}'
  WHEN 1 THEN '{{"messages":[{{"role":"user","content":[{{"type":"text","text":"a"}},{{"type":"image","text":"no"}},{{"type":"text","text":"' || {QUOTED} || '"}}]}},{{"role":"user","content":"b"}}]}}'
  WHEN 2 THEN '{{"messages":[{{"role":"user","content":""}},{{"role":"user","content":""}},{{"role":"user"}},{{"role":"user","content":7}}]}}'
  WHEN 3 THEN '{{"choices":[{{"message":{{"role":"assistant","content":"' || {QUOTED} || '"}}}}]}}'
  WHEN 4 THEN '{{"choices":[{{"message":{{"content":[{{"type":"text","text":"p"}},{{"type":"text","text":"q"}}]}}}}]}}'
  WHEN 5 THEN '{{"type":"response.output_text.delta","delta":"' || {QUOTED} || '"}}'
  WHEN 6 THEN '{{"type":"response.output_text.delta","delta":5,"choices":[{{"delta":{{"content":"no"}}}}]}}'
  WHEN 7 THEN '{{"choices":[{{"delta":{{"content":"' || {QUOTED} || '"}}}}]}}'
  WHEN 8 THEN '{{"messages":"none","choices":[]}}'
  ELSE '{{broken' END AS body FROM conversations"""

#: A request log over events: method, path, headers as a line.
REQUESTS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '/health' WHEN 1 THEN '/metrics' WHEN 2 THEN '/v1/chat' ELSE '/other' END AS path,
  CASE event_id % 7 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'SSN, PHONE' WHEN 2 THEN ' EMAIL ' ELSE 'MRN,DOB,SSN' END AS skip,
  CASE event_id % 6 WHEN 0 THEN 'expired' WHEN 1 THEN 'missing' WHEN 2 THEN 'bad_key' ELSE 'ok' END AS reason FROM events"""
