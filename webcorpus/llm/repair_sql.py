"""DuckDB SQL for the repair of conversations: one step of a recursive query for each row."""

from __future__ import annotations

#: CRC-32 of an ASCII string, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split({key}, ''), lambda ch: ascii(ch)::UBIGINT),
    lambda crc, byte: list_reduce(range(8)::UBIGINT[], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END,
      xor(crc, byte)), 4294967295::UBIGINT))"""

_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _edit(state: str, cost: str, letter: str, row: str | None) -> str:
    rows = f"{state}.r" if row is None else f"list_append({state}.r, {row})"
    return f"{{c: {state}.c + {cost}, a: {state}.a || '{letter}', r: {rows}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _kept(state: str, initial: str) -> str:
    return _edit(state, f"CASE WHEN fault <> 'gone' AND ini = '{initial}' THEN cut ELSE 1000000 END", "K", "role || ':' || text")


def _reroled(state: str, role: str) -> str:
    return _edit(state, "CASE WHEN fault <> 'gone' THEN 2 + cut ELSE 1000000 END", "R", f"'{role}:' || text")


def _inserts(old: str, other: str = "*") -> str:
    """Columns v0 to v3 (nothing, system, user, assistant) with rows inserted, from columns of the relation ``old``."""
    user = _least("s2", *[_edit(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")])
    return (
        f"SELECT {other}, s0 AS v0, s1 AS v1, {_least('s3', _edit('v2', '2', 'I', chr(39) + 'assistant:' + chr(39)))} AS v3 "
        f"FROM (SELECT *, {user} AS v2 FROM {old})"
    )


_STEP = f"""SELECT conv_id, pos,
    {_edit('v0', '3', 'D', None)} AS s0,
    {_least(_edit('v1', '3', 'D', None), _kept('v0', 's'))} AS s1,
    {_least(_edit('v2', '3', 'D', None), *[_kept(s, 'u') for s in ('v0', 'v1', 'v3')], *[_reroled(s, 'user') for s in ('v0', 'v1', 'v3')])} AS s2,
    {_least(_edit('v3', '3', 'D', None), _kept('v2', 'a'), _reroled('v2', 'assistant'))} AS s3"""

_NONE = "{c: 1000000, a: '', r: []::VARCHAR[]}"

STRUCTURE_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(key=_KEY)} % 20 AS f FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
ordered AS (
  SELECT *, rtrim(text, {_SPACE}) AS tail, substr(role, 1, 1) AS ini,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged),
faults AS (
  SELECT *, tail = '' AS blank, tail <> '' AND seen > 1 AS duplicate,
    tail <> '' AND seen = 1 AND right(tail, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair
  FROM ordered),
rows AS (
  SELECT conv_id, pos, role, text, ini, CASE WHEN blank OR duplicate THEN 'gone' ELSE 'stays' END AS fault, truncated::INT AS cut FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
    sum(truncated::INT) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faults GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{c: 0, a: '', r: []::VARCHAR[]}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM conversations
  UNION ALL
  {_STEP} FROM ({_inserts('(SELECT w.*, r.* EXCLUDE (conv_id, pos), r.pos AS here FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.pos + 1)', '* EXCLUDE (pos), here AS pos')})),
ends AS (
  SELECT conv_id, {_least('v0', 'v3')} AS best FROM ({_inserts('(SELECT w.* FROM walk w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.pos = coalesce(c.n, 0))')}))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
