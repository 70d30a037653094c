"""DuckDB SQL of the operators on conversations and the manifest."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string: bit by bit, a byte is followed by eight marks that shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]::UBIGINT[]))"
    return (
        f"xor(list_reduce(list_concat([4294967295]::UBIGINT[], {steps}), lambda c, x: CASE WHEN x < 256 THEN xor(c, x)"
        " WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END), 4294967295::UBIGINT)"
    )


_LINE = "CASE WHEN {0}.r = '' THEN {1} ELSE {0}.r || chr(10) || {1} END"


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """``state`` after one edit, which may add a line to what is repaired."""
    r = _LINE.format(state, line) if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {r}}} END"


def _inserted(table: str, extra: str) -> str:
    """States e, s, u, a after inserts that cost less than none between two rows: one, then perhaps a second."""
    user = lambda x: _edit(x, "2", "I", "'user:'")
    assistant = lambda x: _edit(x, "2", "I", "'assistant:'")
    one = f"SELECT {extra}, e, s, list_min([u, {user('e')}, {user('s')}, {user('a')}]) AS u, list_min([a, {assistant('u')}]) AS a FROM {table}"
    return f"SELECT {extra}, e, s, list_min([u, {user('a')}]) AS u, list_min([a, {assistant('u')}]) AS a FROM ({one})"


def _row_step() -> str:
    gone = {x: _edit(x, "3", "D") for x in "esua"}
    on = "CASE WHEN fault NOT IN (1, 2) AND {0} THEN {1} END"
    keep = lambda x, initial: on.format(f"initial = '{initial}'", _edit(x, "late", "K", "line"))
    new = lambda x, role: on.format("true", _edit(x, "2 + late", "R", f"'{role}:' || text"))
    users = ", ".join(f"{keep(x, 'u')}, {new(x, 'user')}" for x in "esa")
    return f"""{gone['e']} AS e, list_min([{gone['s']}, {keep('e', 's')}]) AS s,
    list_min([{gone['u']}, {users}]) AS u, list_min([{gone['a']}, {keep('u', 'a')}, {new('u', 'assistant')}]) AS a"""


_START = "{'c': 0, 'a': '', 'r': ''}"
_NONE = f"CASE WHEN false THEN {_START} END"

CONVERSATIONS = f"""
WITH RECURSIVE shown AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM shown WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed),
judged AS (SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS initial, role || ':' || text AS line,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM ranked),
steps AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1, 1) || initial AS pair FROM judged),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {_START} AS e, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM ids
  UNION ALL
  SELECT w.conv_id, w.i + 1, {_row_step()}
  FROM ({_inserted("ways", "conv_id, i")}) w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.i + 1),
ended AS (SELECT conv_id, list_min([e, a]) AS best FROM (SELECT * FROM ({_inserted("ways", "conv_id, i")}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv_id)
SELECT n.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.r) AS repaired_sha256
FROM ended n LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM n.conv_id"""


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, idx, h, n) above leaves (g, idx, h, n); n is the size of the level."""
    return f"""{name} AS (SELECT g, 0 AS level, idx, h, n FROM {leaves}
  UNION ALL
  SELECT g, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, level, idx // 3, n)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (SELECT source AS g, doc_id, {_leaf_sql("text")} AS h,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS told FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_tree("low", "leaves")},
subroots AS (SELECT true AS g, g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "subroots")},
docs AS (SELECT row_number() OVER () AS k, l.g, l.doc_id, l.idx, l.h AS leaf, l.told, s.idx AS sidx, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root
         FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g),
runs AS (SELECT k, low.level, low.idx, low.h, low.idx = docs.idx // power(3, low.level)::BIGINT AS own FROM docs
         JOIN low ON low.g IS NOT DISTINCT FROM docs.g AND low.n > 1 AND low.idx // 3 = docs.idx // power(3, low.level + 1)::BIGINT
         UNION ALL
         SELECT k, 100 + high.level, high.idx, high.h, high.idx = sidx // power(3, high.level)::BIGINT AS own FROM docs
         JOIN high ON high.n > 1 AND high.idx // 3 = sidx // power(3, high.level + 1)::BIGINT),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY level) AS step FROM runs),
proofs AS (SELECT k, string_agg(h, '' ORDER BY level, idx) FILTER (NOT own) AS siblings, max(step) AS last FROM ranked GROUP BY k),
folds AS (SELECT k, CAST(0 AS BIGINT) AS step, told AS h FROM docs
  UNION ALL
  SELECT f.k, f.step + 1, sha256(string_agg(CASE WHEN own THEN f.h ELSE r.h END, '' ORDER BY r.idx)) FROM folds f JOIN ranked r ON r.k = f.k AND r.step = f.step + 1 GROUP BY f.k, f.step)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM docs LEFT JOIN proofs USING (k) JOIN folds f ON f.k = docs.k AND f.step = coalesce(proofs.last, 0)"""
