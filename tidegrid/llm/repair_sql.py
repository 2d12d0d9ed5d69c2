"""DuckDB SQL of the conversation repair query: a recursive search for the cheapest edits, message by message."""

from __future__ import annotations

#: What a role's initial leads to from each of the four states; see conversation_repair.
_KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_DUE = {0: 2, 1: 2, 2: 3, 3: 2}


def _step(state: str, cost: str, letter: str, line: str | None = None) -> str:
    body = f"list_append({state}.b, {line})" if line else f"{state}.b"
    return f"{{'c': {state}.c + {cost}, 'l': {state}.l || '{letter}', 'b': {body}}}"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {{'c': 1000000000::BIGINT, 'l': '', 'b': []::VARCHAR[]}} END"


def _least(options: list[str]) -> str:
    return f"least({', '.join(options)})" if len(options) > 1 else options[0]


def repair_sql() -> str:
    def inserted(source: str) -> str:
        first = _least(["s2", *[_step(f"s{q}", "2", "I", "'user:'") for q in (0, 1, 3)]])
        then = _least(["s3", _step("x2", "2", "I", "'assistant:'")])
        return f"(SELECT *, {then} AS x3 FROM (SELECT *, {first} AS x2 FROM {source}))"

    arcs = {to: [_step(f"{'x' if to > 1 else 's'}{to}", "3", "D")] for to in range(4)}
    for q in range(4):
        source = f"{'x' if q > 1 else 's'}{q}"
        for initial, leads in _KEEPS.items():
            if q in leads:
                arcs[leads[q]].append(_when(f"initial = '{initial}' AND NOT goes", _step(source, "broken", "K", "role || ':' || text")))
        name = {2: "user", 3: "assistant"}[_DUE[q]]
        arcs[_DUE[q]].append(_when("NOT goes", _step(source, "2 + broken", "R", f"'{name}:' || text")))
    joined = """(
                SELECT w.s0, w.s1, w.s2, w.s3, r.conv_id, r.i, r.role, r.text, r.initial, r.goes, r.broken
                FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            )"""
    begin = "{'c': 0::BIGINT, 'l': '', 'b': []::VARCHAR[]}"
    never = "{'c': 1000000000::BIGINT, 'l': '', 'b': []::VARCHAR[]}"
    moved = ", ".join(f"{_least(arcs[to])} AS s{to}" for to in range(4))
    return rf"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
            FROM conversations
        ),
        f AS (
            SELECT *, xor(list_reduce(
                list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
                lambda h, x: list_reduce(range(8), lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(h, x)), 4294967295::BIGINT
            ), 4294967295::BIGINT) % 20 AS fault FROM c
        ),
        d AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END))
            FROM f WHERE fault <> 0
        ),
        o AS (
            SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
            FROM d
        ),
        s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
        r AS (
            SELECT *, bare = '' AS blank, bare <> '' AND again AS repeated,
                   bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS off,
                   bare = '' OR again AS goes, (right(bare, 1) NOT IN ('.', '!', '?'))::BIGINT AS broken,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
            FROM s
        ),
        n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (repeated) AS duplicate, count(*) FILTER (off) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
            FROM r GROUP BY conv_id
        ),
        w AS (
            SELECT conv_id, 0::BIGINT AS i, {begin} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM n
            UNION ALL
            SELECT conv_id, i, {moved}
            FROM {inserted(joined)}
        ),
        e AS (
            SELECT n.*, least(s0, x3) AS best
            FROM n JOIN {inserted("w")} x ON n.conv_id IS NOT DISTINCT FROM x.conv_id AND n.last = x.i
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
               coalesce(best.l, '') AS audit, sha256(coalesce(array_to_string(best.b, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
    """
