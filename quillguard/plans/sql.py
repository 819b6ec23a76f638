"""Pieces of DuckDB SQL that restate the operators independently."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.context import RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def matches(source: str, kind: str) -> str:
    """id, text, span, start, stop, i of all matches in ``source`` (id, text)."""
    p = quoted(P.RE2[kind])
    return f"""SELECT id, text, i, m[i] AS span,
  CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0) AS INTEGER) AS start
  FROM (SELECT id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({source}) WHERE regexp_matches(text, {p})))"""


def _valid(digits: str) -> str:
    return f"(CAST(substr({digits}, 1, 3) AS INTEGER) NOT IN (0, 666) AND CAST(substr({digits}, 1, 3) AS INTEGER) < 900 AND substr({digits}, 4, 2) <> '00' AND substr({digits}, 6, 4) <> '0000')"


_SCORE = {"SSN_DASHED": 0.99, "PHONE": 0.95, "EMAIL": 0.99, "MRN": 0.99, "IPV4": 0.95, "IPV6": 0.95, "PASSPORT": 0.99}
_BASE = {"SSN_PLAIN": 0.40, "DOB": 0.50, "CREDIT_CARD": 0.50}


def scored(source: str, kind: str) -> str:
    """id, start, stop, span, score of all candidates of a context-scored detector."""
    triggers, up, pairs, more, negatives, down = RULES[kind]
    rule = f"{_BASE[kind]} + CASE WHEN list_has_any(w, {listed(triggers)}) THEN {up} ELSE 0 END - CASE WHEN list_has_any(w, {listed(negatives)}) THEN {down} ELSE 0 END"
    if pairs:
        rule += f" + CASE WHEN list_has_any(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k+1]), {listed(pairs)}) THEN {more} ELSE 0 END"
    valid = f" WHERE {_valid('span')}" if kind == "SSN_PLAIN" else ""
    strip = quoted(P.STRIP)
    return f"""SELECT id, text, i, span, start, start + length(span) AS stop, round(greatest(0, least(1, CAST({rule} AS DOUBLE))), 4) AS score FROM (
  SELECT *, list_transform(list_concat(list_filter(regexp_split_to_array(lower(substr(text, 1, start)), '\\s+'), lambda x: x <> '')[-10:],
    list_filter(regexp_split_to_array(lower(substr(text, start + length(span) + 1)), '\\s+'), lambda x: x <> '')[1:10]), lambda x: trim(x, {strip})) AS w
  FROM ({matches(source, kind)}){valid})"""


def detected(source: str, kind: str) -> str:
    """id, entity_type, start, stop, span, score, det, i of the spans of one detector."""
    head = f"SELECT id, '{P.ENTITY[kind]}' AS entity_type, start, CAST(start + length(span) AS INTEGER) AS stop, span"
    n = P.ORDER.index(kind)
    if kind in _SCORE:
        only = f" WHERE {_valid(chr(39).join(['replace(span, ', '-', ', ', '', ')']))}" if kind == "SSN_DASHED" else ""
        return f"{head}, CAST({_SCORE[kind]} AS DOUBLE) AS score, {n} AS det, i FROM ({matches(source, kind)}){only}"
    if kind == "CREDIT_CARD":
        inner = f"SELECT * REPLACE (CASE WHEN length(span) > 16 THEN 0.99 ELSE score END AS score) FROM ({scored(source, kind)})"
    else:
        inner = scored(source, kind)
    return f"{head}, score, {n} AS det, i FROM ({inner}) WHERE score >= 0.7"


def all_detected(source: str) -> str:
    return " UNION ALL ".join(f"({detected(source, k)})" for k in P.ORDER)


_STRUCTURED = listed(P.STRUCTURED)


def merged(candidates: str) -> str:
    """CTEs ending in ``merged`` (id, entity_type, start, stop, span, score, source) from
    ``candidates`` (id, entity_type, start, stop, span, score, source, ord)."""
    one = "{'entity_type': c.entity_type, 'start': c.start, 'stop': c.stop, 'span': c.span, 'score': c.score, 'source': c.source}"
    firm = lambda s: f"({s}.source = 'regex' AND list_contains({_STRUCTURED}, {s}.entity_type))"
    return f"""cand AS ({candidates}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, start - stop, ord) AS rn FROM cand),
fold(id, rn, acc) AS (
  SELECT c.id, c.rn, [{one}] FROM ranked c WHERE rn = 1
  UNION ALL
  SELECT c.id, c.rn, CASE WHEN f.acc[-1].stop <= c.start THEN list_append(f.acc, {one})
    WHEN CASE WHEN f.acc[-1].start = c.start AND f.acc[-1].stop = c.stop THEN CASE WHEN {firm('f.acc[-1]')} THEN false WHEN {firm('c')} THEN true ELSE c.score > f.acc[-1].score END
         ELSE c.stop - c.start > f.acc[-1].stop - f.acc[-1].start END THEN list_append(f.acc[1:len(f.acc) - 1], {one})
    ELSE f.acc END
  FROM fold f JOIN ranked c ON c.id = f.id AND c.rn = f.rn + 1),
merged AS (SELECT id, unnest(acc, recursive := true) FROM fold f WHERE rn = (SELECT max(rn) FROM ranked r WHERE r.id = f.id))"""
