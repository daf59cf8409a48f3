"""The SQL that states the rows of the conversation repair: its costs by a recursion over all rows of a conversation, without block tables."""

from __future__ import annotations

CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b:
  list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))"""


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _step(after: str, cost: str, letters: str, lines: str, when: str = "true") -> str:
    """An edit (or several) before what follows in state ``after``."""
    return f"CASE WHEN {when} THEN {{'c': {after}.c + {cost}, 'a': '{letters}' || {after}.a, 't': list_concat({lines}, {after}.t)}} END"


def _stays(initial: str, name: str, after: str) -> list[str]:
    kept = _step(after, "broken", "K", "[role || ':' || text]", f"NOT must AND own = '{initial}'")
    return [kept, _step(after, "broken + 1", "R", f"['{name}:' || text]", f"NOT must AND own <> '{initial}'")] if name else [kept]


def statement() -> str:
    gone = lambda s: _step(s, "2", "D", "CAST([] AS VARCHAR[])")
    put = lambda s, *names: _step(s, str(5 * len(names)), "I" * len(names), "[" + ", ".join(f"'{n}:'" for n in names) + "]")
    user, assistant = _stays("u", "user", "s2"), _stays("a", "assistant", "s3")
    end = lambda c, a, *names: f"{{'c': CAST({c} AS BIGINT), 'a': '{a}', 't': CAST([{', '.join(repr(n + ':') for n in names)}] AS VARCHAR[])}}"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({CRC.format(key)}, 4294967295) % 20 AS code FROM conversations),
d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE code <> 0),
o AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS own, lead(left(role, 1)) OVER w AS following,
         right(rtrim(text, {space}), 1) AS ends FROM d
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (
  SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
m AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS broken FROM f),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (following IS NOT NULL AND own || following NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
v AS (
  SELECT conv_id, n + 1 AS i, {end(0, '')} AS s0, {end(10, 'II', 'user', 'assistant')} AS s1, {end(5, 'I', 'assistant')} AS s2, {end(0, '')} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, {_best('s0', put('s2', 'user'), put('s3', 'user', 'assistant'))} AS s0,
         {_best('s1', put('s2', 'user'), put('s3', 'user', 'assistant'))} AS s1,
         {_best('s2', put('s3', 'assistant'))} AS s2, {_best('s3', put('s2', 'user'))} AS s3
  FROM (SELECT m.conv_id, m.i, {_best(gone('s0'), *_stays('s', '', 's1'), *user)} AS s0, {_best(gone('s1'), *user)} AS s1,
               {_best(gone('s2'), *assistant)} AS s2, {_best(gone('s3'), *user)} AS s3
        FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.i = v.i - 1)),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 1
"""
