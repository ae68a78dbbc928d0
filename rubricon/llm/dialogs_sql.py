"""The repair of conversations as one recursive query, for comparison with ``dialogs``.

Each state holds the cheapest cost, letters and rows so far as a struct, compared in that order.
"""

from __future__ import annotations

_SPACE = r"\x20\x09-\x0D"
_NONE = "NULL::STRUCT(c INTEGER, p VARCHAR, r VARCHAR)"


def _moved(state: str, letter: str, cost: str, row: str = "''") -> str:
    return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'c': {state}.c + {cost}, 'p': {state}.p || '{letter}', 'r': {state}.r || {row}}} END"


def _inserted(source: str, columns: str) -> str:
    """Rows of a table of states with empty rows put in where that is cheaper."""
    user = ", ".join(_moved(s, "I", "2", "chr(10) || 'user:'") for s in "esa")
    first = f"SELECT {columns}, e, s, a, least(u, {user}) AS u FROM {source}"
    return f"SELECT * REPLACE (least(a, {_moved('u', 'I', '2', "chr(10) || 'assistant:'")}) AS a) FROM ({first})"


_OPEN = "least(e, s, a)"
_MORE = "(f = 3)::INTEGER"
_AS_IS = "chr(10) || role || ':' || text"


def _only(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


SQL = rf"""WITH RECURSIVE
bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295]
    || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
placed AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
lines AS (SELECT conv_id, turn, role, text, c, i, CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*\z') THEN 3 ELSE 0 END AS f,
  coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS bad FROM placed),
states(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'p': '', 'r': ''}}, {_NONE}, {_NONE}, {_NONE} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_moved("e", "D", "3")},
    least({_moved("s", "D", "3")}, {_only("f IN (0, 3) AND c = 's'", _moved("e", "K", _MORE, _AS_IS))}),
    least({_moved("u", "D", "3")}, {_only("f IN (0, 3) AND c = 'u'", _moved(_OPEN, "K", _MORE, _AS_IS))},
      {_only("f IN (0, 3)", _moved(_OPEN, "R", f"2 + {_MORE}", "chr(10) || 'user:' || text"))}),
    least({_moved("a", "D", "3")}, {_only("f IN (0, 3) AND c = 'a'", _moved("u", "K", _MORE, _AS_IS))},
      {_only("f IN (0, 3)", _moved("u", "R", f"2 + {_MORE}", "chr(10) || 'assistant:' || text"))})
  FROM ({_inserted("states st JOIN lines l ON l.conv_id IS NOT DISTINCT FROM st.conv_id AND l.i = st.i + 1", "l.conv_id, l.i, role, text, c, f")})),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
  count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM lines GROUP BY conv_id),
ends AS (SELECT conv_id, i, least(e, a) AS w FROM ({_inserted("states", "conv_id, i")}))
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, w.c::BIGINT AS cost, w.p AS audit, sha256(substr(w.r, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id WHERE ends.i = coalesce(n, 0)"""
