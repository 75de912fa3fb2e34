"""DuckDB SQL for the engine's queries, written apart from the DataFrame code: one CTE chain a query."""

from __future__ import annotations

from siltstone.functions.budget import py_chunk
from siltstone.plans.queries import ANCHOR, BUDGET_WINDOWS, CAPACITIES, CATALOG, COOLDOWNS, MERGE_USABLE, NEEDLE_WORDS, NOW, PROVIDERS, RECOVERY, ROUTES, WINDOWS

# Fixed texts and word lists, written out here too, so that the operators' own are checked.
OPEN_TAG, CLOSE_TAG = "<compacted-summary>", "</compacted-summary>"
PREAMBLE = "This is an automatically generated checkpoint condensing an earlier span of the conversation to free up context. Treat the captured context as established background and build on it without restating it. Continue the task directly from the messages that follow, without acknowledging this checkpoint."
FORGETFUL = "SUMMARY: the user asked for work; several files were inspected and edited; continue from here."
REJECTIONS = ("rejected", "reject", "declined", "avoid", "must not", "do not", "don't", "no longer")
ADOPTIONS = ("chosen", "chose", "adopted", "selected", "decided to", "we will use", "went with")
STALE_CLAIM = "still (valid|available|supported)|is (still )?current|recommended"
FLIP = "we (also )?(chose|chosen|decided|picked)"

_SPLIT = r"regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')"
_LINES = f"l0 AS (SELECT doc_id, {_SPLIT} AS l FROM documents), doc_lines AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM l0)"
_ESC = "chr(27)"
_LOGS = ", ".join(f"'svc 2026-01-01 10:00:0{k} INFO step {k}'" for k in range(6))
_NOISY = f"""{_LINES},
n0 AS (SELECT doc_id, line_no AS idx, list_concat([line],
  CASE WHEN (doc_id + line_no) % 3 = 0 THEN ['', '', '', ''] WHEN (doc_id + line_no) % 3 = 1 THEN [''] ELSE [] END,
  CASE WHEN (doc_id + line_no) % 5 = 0 THEN [{_ESC} || '[31m' || substr(line, 1, 20) || {_ESC} || '[0m', '    ^^^^^^', '----------------'] ELSE [] END,
  CASE WHEN (doc_id + line_no) % 7 = 0 THEN ['```py', 'def f():', '        a', '            b', '            c', '```'] ELSE [] END,
  CASE WHEN (doc_id + line_no) % 4 = 0 THEN [{_LOGS}] ELSE [] END) AS l FROM doc_lines),
n1 AS (SELECT doc_id, idx, unnest(range(len(l))) AS sub, unnest(l) AS line FROM n0),
noisy AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sub) - 1 AS line_no, line FROM n1)"""


def _kept(name: str, source: str) -> str:
    return f"{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, line FROM {source})"


def _dedup(name: str, source: str) -> str:
    return f"""{name}_a AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM {source}),
{name}_b AS (SELECT * FROM {name}_a WHERE b IS NULL OR b <> line), {_kept(name, name + "_b")}"""


def _purge(name: str, source: str) -> str:
    sign = "substr(trim(line), 1, 1)"
    rule = f"length(trim(line)) >= 16 AND replace(trim(line), {sign}, '') = '' AND NOT regexp_matches({sign}, '[\\s\\w]')"
    return f"""{name}_a AS (SELECT doc_id, line_no, regexp_replace(line, '\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])', '', 'g') AS line FROM {source}),
{name}_b AS (SELECT * FROM {name}_a WHERE NOT regexp_matches(line, '^\\s*[\\^~]{{4,}}\\s*$') AND NOT ({rule})), {_kept(name, name + "_b")}"""


def _blanks(name: str, source: str) -> str:
    return f"""{name}_a AS (SELECT *, trim(line) = '' AS e FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g, max(CASE WHEN NOT e THEN line_no END) OVER (PARTITION BY doc_id) AS last FROM {name}_a),
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, e ORDER BY line_no) AS r FROM {name}_b),
{name}_d AS (SELECT doc_id, line_no, CASE WHEN e THEN '' ELSE line END AS line FROM {name}_c WHERE NOT e OR (r = 3 AND (last IS NULL OR line_no < last))), {_kept(name, name + "_d")}"""


def _skeleton(name: str, source: str, depth: int = 2) -> str:
    return f"""{name}_a AS (SELECT *, regexp_matches(line, '^```\\s*$') AS bare, regexp_matches(line, '^```[^\\s`]+\\s*$') AS lang,
  (length(regexp_extract(line, '^[ \\t]*')) + 3 * length(replace(regexp_extract(line, '^[ \\t]*'), ' ', ''))) // 4 AS depth FROM {source}),
{name}_b AS (SELECT *, sum(bare::INT) OVER w AS bares FROM {name}_a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
{name}_c AS (SELECT *, max(CASE WHEN lang THEN bares END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN opened IS NULL THEN (bares - bare::INT) % 2 = 1 ELSE (1 + bares - bare::INT - opened) % 2 = 1 END AND NOT bare AND depth > {depth} AS deep FROM {name}_c),
{name}_e AS (SELECT *, sum((NOT deep)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {name}_d),
{name}_f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g, deep) AS n, min(line_no) OVER (PARTITION BY doc_id, g, deep) AS first FROM {name}_e),
{name}_g AS (SELECT doc_id, line_no, CASE WHEN deep THEN '[condensed: ' || n || ' lines removed]' ELSE line END AS line FROM {name}_f WHERE NOT deep OR line_no = first), {_kept(name, name + "_g")}"""


def _islands(name: str, source: str) -> str:
    stamp, level = r"^\S+\s+\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b"
    return f"""{name}_a AS (SELECT *, regexp_matches(line, '{stamp}') OR regexp_matches(line, '{level}') AS log FROM {source}),
{name}_b AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, log ORDER BY line_no) AS g FROM {name}_a),
{name}_c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, log, g) AS n, row_number() OVER (PARTITION BY doc_id, log, g ORDER BY line_no) AS r FROM {name}_b)"""


def _condense(name: str, source: str, mode: str, most: int) -> str:
    head = {"balanced": (most + 1) // 2, "head": most, "tail": 0}[mode]
    cut = f"(log AND n >= 4 AND n > {most})"
    return f"""{_islands(name, source)},
{name}_d AS (SELECT doc_id, line_no, CASE WHEN {cut} AND r = {head + 1} THEN '[condensed: ' || (n - {most}) || ' lines removed]' ELSE line END AS line
  FROM {name}_c WHERE NOT {cut} OR r <= {head + 1} OR r > n - {most - head}), {_kept(name, name + "_d")}"""


_STAGE0 = ",\n".join([_NOISY, _dedup("s1", "noisy"), _purge("s2", "s1"), _blanks("s3", "s2"), _skeleton("s4", "s3"), _condense("clean", "s4", "balanced", 3)])


def _chunks(source: str, windows: list[int]) -> str:
    """CTEs that end in ``chunks``, from lines in ``source``: a jump for every start and route, then a walk along them."""
    values = ", ".join(f"({k}, {py_chunk(w)}, {int(py_chunk(w) * 0.1)})" for k, w in enumerate(windows))
    return f"""routes(route, budget, overlap) AS (VALUES {values}),
cost AS (SELECT doc_id, line_no, (length(line) + 3) // 4 + 1 AS cost, trim(line) = '' OR regexp_matches(trim(line), '[.?!:;,}}\\])"''`]$') AS good FROM {source}),
p AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS s, false AS good FROM (SELECT DISTINCT doc_id FROM cost) UNION ALL
      SELECT doc_id, line_no + 1, (sum(cost) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT, good FROM cost),
sizes AS (SELECT doc_id, max(i) AS n FROM p GROUP BY doc_id),
far AS (SELECT a.doc_id, route, overlap, a.i AS start, a.s AS s0, greatest(a.i + 1, max(b.i)) AS stop FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i, routes
        WHERE b.s - a.s <= budget GROUP BY a.doc_id, route, overlap, a.i, a.s),
snap AS (SELECT f.doc_id, route, overlap, start, s0, stop, n, CASE WHEN stop >= n THEN n ELSE coalesce(max(q.i), stop) END AS e
         FROM far f JOIN sizes z ON z.doc_id = f.doc_id LEFT JOIN p q ON q.doc_id = f.doc_id AND q.good AND q.i BETWEEN greatest(start + 1, stop - 12) AND stop
         WHERE start < n GROUP BY f.doc_id, route, overlap, start, s0, stop, n),
jump AS (SELECT t.doc_id, route, start, s0, e, z.s AS s1, CASE WHEN e >= n THEN n WHEN overlap <= 0 THEN e ELSE coalesce(max(q.i), e) END AS next
         FROM snap t JOIN p z ON z.doc_id = t.doc_id AND z.i = e LEFT JOIN p q ON q.doc_id = t.doc_id AND q.i > start AND q.i <= e AND z.s - q.s >= overlap
         GROUP BY t.doc_id, route, overlap, start, s0, e, n, z.s),
walk AS (SELECT doc_id, 0 AS chunk, 0 AS route, start, e, next, 0::BIGINT AS core, s1 - s0 AS tokens FROM jump WHERE start = 0 AND route = 0
         UNION ALL
         SELECT j.doc_id, w.chunk + 1, j.route, j.start, j.e, j.next, w.e, j.s1 - j.s0 FROM walk w JOIN jump j ON j.doc_id = w.doc_id AND j.start = w.next AND j.route = (w.chunk + 1) % {len(windows)}),
chunks AS (SELECT w.doc_id, chunk, route, start AS line_start, w.e AS line_end, core AS core_start, w.e AS core_end, tokens::BIGINT AS tokens, (b.s - a.s)::BIGINT AS core_tokens
           FROM walk w JOIN p a ON a.doc_id = w.doc_id AND a.i = core JOIN p b ON b.doc_id = w.doc_id AND b.i = w.e)"""


_CAPS = f"""caps0 AS (SELECT *, greatest(1, floor({MERGE_USABLE} * core_tokens / greatest(1, sum(core_tokens) OVER (PARTITION BY doc_id))))::BIGINT AS cap0 FROM chunks),
caps1 AS (SELECT *, sum(cap0) OVER (PARTITION BY doc_id) AS total FROM caps0),
caps AS (SELECT *, CASE WHEN total > {MERGE_USABLE} THEN greatest(1, floor(cap0 * ({MERGE_USABLE}::DOUBLE / total)))::BIGINT ELSE cap0 END AS cap_tokens FROM caps1)"""
_CHUNK_LINES = f"{_STAGE0}, {_chunks('clean', WINDOWS)}, cl AS (SELECT c.doc_id, chunk, l.line_no, l.line, l.line_no - line_start AS idx FROM chunks c JOIN clean l ON l.doc_id = c.doc_id AND l.line_no >= line_start AND l.line_no < line_end)"
_WORTH = r"trim(line) <> '' AND NOT regexp_matches(trim(line), '^\[filler\s+\d+\]') AND NOT (regexp_matches(trim(line), '^\[condensed: .*removed\]$') AND NOT contains(line, 'including'))"
_PERFECT = f"""worth AS (SELECT doc_id, chunk, line, min(line_no) AS line_no FROM cl WHERE {_WORTH} GROUP BY ALL),
perfect0 AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY line_no) AS body FROM worth GROUP BY ALL),
perfect AS (SELECT c.doc_id, c.chunk, 'SUMMARY:' || chr(10) || coalesce(body, '') AS digest FROM chunks c LEFT JOIN perfect0 USING (doc_id, chunk))"""
_MERGED = f"""material AS (SELECT doc_id, line, chunk, line_no FROM worth UNION ALL SELECT doc_id, unnest(['--- digest ' || (chunk + 1) || ' ---', 'SUMMARY:']), chunk, unnest([-2, -1]) FROM chunks),
flat AS (SELECT doc_id, line, chunk, line_no FROM material QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY chunk, line_no) = 1),
many AS (SELECT doc_id, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY chunk, line_no) AS many FROM flat GROUP BY doc_id),
one AS (SELECT doc_id, count(*) AS n, first(digest) AS one FROM perfect GROUP BY doc_id),
merged AS (SELECT doc_id, (n > 1)::INT AS merge_levels, CASE WHEN n > 1 THEN coalesce(many, 'SUMMARY:' || chr(10)) ELSE one END AS summary FROM one LEFT JOIN many USING (doc_id)),
checkpoints AS (SELECT *, '{PREAMBLE}' || chr(10) || chr(10) || '{OPEN_TAG}' || chr(10) || summary || chr(10) || '{CLOSE_TAG}' AS answer FROM merged)"""
_DIGEST = "length(digest)::INT AS chars, sha256(digest) AS digest_sha256"
_LINE3 = "SELECT doc_id, line_no::BIGINT AS line_no, line FROM"

_CONV = r"""c0 AS (SELECT conv_id, turn, list_concat(['[' || role || ']'], regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS l FROM conversations),
c1 AS (SELECT conv_id, turn, unnest(range(len(l))) AS idx, unnest(l) AS line FROM c0),
conv AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, idx) - 1 AS line_no, line FROM c1)"""
_SURFACE = "surfaces AS (SELECT conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS surface FROM conversations GROUP BY conv_id)"
_NODES = """calls AS (SELECT *, (turn % 3 = 1)::INT AS call FROM conversations),
nodes AS (SELECT conv_id AS session_id, row_number() OVER w - 1 AS pos, turn + 100 AS seq, (length(text) + 3) // 4 + 8 AS tokens, call - coalesce(lag(call) OVER w, 0) AS delta, role = 'system' AS is_system, text, role
          FROM calls WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
balance AS (SELECT *, coalesce(sum(delta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS balanced_before, sum(delta) OVER (w ROWS UNBOUNDED PRECEDING) = 0 AS balanced_after,
            sum(tokens) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM nodes WINDOW w AS (PARTITION BY session_id ORDER BY pos))"""


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_POOL = f"""r0(tier_name, tier_idx, pos, provider, model, max_concurrent, cooldown_hours) AS (VALUES {_values(ROUTES)}),
cap(key, w, m) AS (VALUES {_values(CAPACITIES)}), cool(key, u) AS (VALUES {_values(COOLDOWNS)}),
pool AS (SELECT r0.*, provider || '/' || model AS key, CASE WHEN w > 0 THEN w ELSE 262144 END AS win, CASE WHEN m > 0 THEN m ELSE 32768 END AS mt, coalesce(u, 0) AS cooled,
         coalesce(u, 0) <= {NOW} AS healthy FROM r0 LEFT JOIN cap ON cap.key = provider || '/' || model LEFT JOIN (SELECT key, max(u) AS u FROM cool GROUP BY key) k ON k.key = provider || '/' || model)"""
_ATTEMPTS = "a AS (SELECT user_id % 50 AS job, event_id AS pos, 'p' || (event_id % 3) || '/m' AS model, CASE WHEN event_type IN ('error', 'purchase') THEN 'failed ' || event_id END AS error FROM events)"
_GRADES = """need AS (SELECT conv_id, list_sort(list_distinct(list(lower(string_split(text, ' ')[1])))) AS need FROM conversations GROUP BY conv_id),
ans AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id),
grades AS (SELECT conv_id, len(list_filter(need, lambda t: contains(lower(coalesce(answer, '')), lower(t))))::INT AS matched, len(need)::INT AS required, list_filter(need, lambda t: NOT contains(lower(coalesce(answer, '')), lower(t))) AS missing
           FROM need LEFT JOIN (SELECT conv_id, answer FROM ans) USING (conv_id))"""
_FRAME = f"'{PREAMBLE}' || chr(10) || chr(10) || '{OPEN_TAG}' || chr(10) || %s || chr(10) || '{CLOSE_TAG}'"
_KEEP = """b AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM balance),
k AS (SELECT session_id, 1::BIGINT AS start_pos, max(pos) - 1 AS end_pos FROM b WHERE pos <= greatest(1, least(n - 2, n - 1)) AND pos > 1 AND balanced_before GROUP BY session_id)"""


def _round(k: int) -> str:
    """CTEs of one round of the pressure policy: n{k} before it, n{k + 1} after."""
    return f"""t{k} AS (SELECT session_id, sum(tokens) AS total FROM n{k} GROUP BY session_id),
b{k} AS (SELECT n.*, coalesce(sum(delta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS bb, sum(tokens) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix
  FROM n{k} n JOIN t{k} USING (session_id) WHERE total >= 340 WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
c{k} AS (SELECT session_id, coalesce(max(CASE WHEN suffix >= 64 THEN pos END), 0) AS cut, bool_or(pos = 0 AND is_system)::BIGINT AS a FROM b{k} GROUP BY session_id),
r{k} AS (SELECT session_id, a, max(pos) - 1 AS z FROM b{k} JOIN c{k} USING (session_id) WHERE pos <= cut AND pos > a AND bb GROUP BY session_id, a),
m{k} AS (SELECT session_id, a, z, max(seq) + 1000 AS s, sum(tokens) // 3 AS tok FROM r{k} JOIN n{k} USING (session_id) WHERE pos BETWEEN a AND z GROUP BY session_id, a, z),
n{k + 1} AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS pos, CASE WHEN pos = a THEN s ELSE seq END AS seq, CASE WHEN pos = a THEN tok ELSE tokens END AS tokens,
  CASE WHEN pos = a THEN 0 ELSE delta END AS delta, is_system AND coalesce(pos <> a, true) AS is_system FROM n{k} LEFT JOIN m{k} USING (session_id) WHERE NOT coalesce(pos > a AND pos <= z, false))"""


def _suite(name: str, source: str) -> str:
    """CTEs that grade each persona's answers over branches (conv_id, text): {name}_g (conv_id, persona, recall, t)."""
    return f"""{name}_m AS (SELECT conv_id, text || chr(10) || 'Answer strictly from the context above: Which words open the turns?' AS m FROM {source}),
{name}_s AS (SELECT conv_id, string_split(m, chr(10)) AS l FROM {name}_m),
{name}_a AS (SELECT conv_id, 'perfect' AS persona, m AS answer FROM {name}_m UNION ALL SELECT conv_id, 'forgetful', 'I do not have that information.' FROM {name}_m
  UNION ALL SELECT conv_id, 'leak', array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF i % 4 <> 0], chr(10)) FROM {name}_s),
{name}_g AS (SELECT conv_id, persona, len(list_filter(need, lambda x: contains(lower(answer), x))) / len(need) AS recall, lower(answer) AS t FROM {name}_a JOIN need USING (conv_id))"""


_NEEDLES = f"needles AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[2:{NEEDLE_WORDS + 1}], ' ') AS needle FROM benchmark)"


def _grep(name: str, source: str) -> str:
    return f"""{name}_l AS MATERIALIZED (SELECT lower(unnest(string_split(text, chr(10)))) AS line FROM {source}),
{name} AS (SELECT needle, count(line) AS hits FROM needles LEFT JOIN {name}_l ON contains(line, lower(needle)) GROUP BY needle)"""


def _head_tail(threshold: int, head: int, tail: int) -> str:
    return f"""ht0 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS up, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down,
  sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM ht_in),
ht1 AS (SELECT *, sum((up <= {head} OR line_no = 0)::INT) OVER (PARTITION BY doc_id) AS h, sum((down <= {tail} OR line_no = n - 1)::INT) OVER (PARTITION BY doc_id) AS t FROM ht0),
ht2 AS (SELECT *, total > {threshold} AND n - t - h > 0 AS cut FROM ht1),
ht3 AS (SELECT doc_id, line_no, CASE WHEN cut AND line_no = h THEN '[condensed: ' || (n - t - h)::BIGINT || ' lines removed]' ELSE line END AS line FROM ht2 WHERE NOT cut OR line_no <= h OR line_no >= n - t),
{_kept("ht", "ht3")}"""


_ANY = lambda names: "(" + " OR ".join(f"contains(t, '{n.replace(chr(39), chr(39) * 2)}')" for n in names) + ")"

ORACLES = {
    "region_lines": f"WITH {_CONV} SELECT conv_id, line_no::BIGINT AS line_no, line FROM conv",
    "block_lines": r"""WITH b AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN regexp_split_to_array(text, '\r\n|\r|\n') WHEN 1 THEN ['[tool-call read]', '{"turn":' || turn || '}']
 WHEN 2 THEN ['[image' || CASE WHEN conv_id % 2 = 0 THEN ': a.png' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN ' (offloaded)' ELSE '' END || ']'] WHEN 3 THEN ['[file' || CASE WHEN conv_id % 2 = 0 THEN ': a.png' ELSE '' END || ']']
 ELSE ['[block chart]', '{"x":1}'] END AS l FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(l) + 1)) AS idx, unnest(list_concat(['[' || role || ']'], l)) AS line FROM b)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, idx) - 1 AS line_no, line FROM e""",
    "replayed_region": r"""WITH m AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AND role = 'user' AND coalesce(regexp_matches(text, '(?i)compaction engine|condense the conversation|structured checkpoint'), false) AS gone FROM conversations),
k AS (SELECT conv_id, turn, list_concat(['[' || role || ']'], regexp_split_to_array(text, '\r\n|\r|\n')) AS l FROM m WHERE NOT gone),
e AS (SELECT conv_id, turn, unnest(range(len(l))) AS idx, unnest(l) AS line FROM k UNION ALL SELECT DISTINCT conv_id, NULL, 0, '[user]' FROM k)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, idx) - 1 AS line_no, line FROM e""",
    "dedup_lines": f"WITH {_LINES}, {_dedup('o', 'doc_lines')} {_LINE3} o",
    "purge_noise": f"WITH {_NOISY}, {_purge('o', 'noisy')} {_LINE3} o",
    "skip_blank_blocks": f"WITH {_NOISY}, {_blanks('o', 'noisy')} {_LINE3} o",
    "head_middle_tail": f"WITH {_LINES}, ht_in AS (SELECT * FROM doc_lines), {_head_tail(2000, 900, 500)} {_LINE3} ht",
    "ast_skeleton": f"WITH {_NOISY}, {_skeleton('o', 'noisy')} {_LINE3} o",
    "log_runs": f"WITH {_NOISY}, {_islands('o', 'noisy')} SELECT doc_id, min(line_no)::BIGINT AS run_start, (max(line_no) + 1)::BIGINT AS run_end FROM o_c WHERE log AND n >= 4 GROUP BY doc_id, g",
    "log_condense_balanced": f"WITH {_NOISY}, {_condense('o', 'noisy', 'balanced', 3)} {_LINE3} o",
    "log_condense_head": f"WITH {_NOISY}, {_condense('o', 'noisy', 'head', 2)} {_LINE3} o",
    "log_condense_tail": f"WITH {_NOISY}, {_condense('o', 'noisy', 'tail', 2)} {_LINE3} o",
    "stage0_full": f"WITH {_STAGE0} {_LINE3} clean",
    "replayed_blocks": r"""WITH m AS (SELECT *, text || chr(10) || 'read {"turn":' || turn || '}' || chr(10) || '{"x":1}' AS body, turn = max(turn) OVER (PARTITION BY conv_id) AND role = 'user' AND coalesce(regexp_matches(text, '(?i)compaction engine|condense the conversation|structured checkpoint'), false) AS gone FROM conversations),
k AS (SELECT conv_id, turn, list_concat(['[' || role || ']'], regexp_split_to_array(body, '\r\n|\r|\n')) AS l FROM m WHERE NOT gone),
e AS (SELECT conv_id, turn, unnest(range(len(l))) AS idx, unnest(l) AS line FROM k UNION ALL SELECT DISTINCT conv_id, NULL, 0, '[user]' FROM k)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, idx) - 1 AS line_no, line FROM e""",
    "message_prices": """SELECT conv_id, turn, (4 + 4 + (length(text) + 3) // 4 + 4 + (length('read{"turn":' || turn || '}') + 3) // 4 + 4 + 2)::BIGINT AS block_tokens, ((length(text) + 3) // 4 + 4)::BIGINT AS text_tokens, sha256(text || chr(10) || chr(10)) AS text_sha256 FROM conversations""",
    "request_tokens": "SELECT conv_id, (sum((length(text) + 3) // 4) + 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "region_chars": "SELECT conv_id, sum(length(to_json([text])::VARCHAR))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "history_text": "SELECT conv_id AS session_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_sha256 FROM conversations WHERE turn % 4 > 0 GROUP BY conv_id",
    "purpose_requests": "SELECT event_id, 'compaction' AS purpose FROM events WHERE event_id % 3 = 0",
    "triggers": "SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 4 = 3 THEN 'auto' ELSE ['manual', 'pressure', 'context-overflow'][event_id % 4 + 1] END AS trigger FROM events",
    "targets": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'p' WHEN event_id % 5 > 0 THEN 'q' END AS provider, CASE WHEN event_id % 6 = 0 THEN 'm' WHEN event_id % 5 > 0 THEN 'n' END AS model FROM events",
    "replay_input": f"""WITH {_NODES} SELECT DISTINCT session_id, 0::BIGINT AS at, 'system' AS role, 'Be brief.' AS text, 'read' AS tools FROM nodes
UNION ALL SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq), CASE WHEN is_system THEN 'system' ELSE 'user' END, text, NULL FROM nodes WHERE pos BETWEEN 1 AND 4""",
    "filler_lines": "SELECT i AS line_no, '[filler ' || (i + 1) || '] build: routine output line ' || (i + 1) AS line FROM range(1000) r(i)",
    "unknown_keys": "SELECT event_id, 'x' || (event_id % 3) AS unknown, CASE WHEN event_id % 2 = 0 THEN 'mergeTiers' ELSE '' END AS deprecated FROM events",
    "output_tokens": """WITH w(win) AS (VALUES (500), (1000), (100000)), d AS (SELECT doc_id, win, win - (length(text) + 3) // 4 AS hard FROM documents, w)
SELECT doc_id, win::BIGINT AS "window", CASE WHEN hard <= 0 THEN 0 ELSE least(32768, 8192, hard) END::BIGINT AS max_tokens FROM d""",
    "retry_delays": """WITH b AS (SELECT event_id, least(500.0::DOUBLE * power(2, event_id % 9), 20000.0::DOUBLE) AS base, (event_id % 11) / 10 AS r FROM events)
SELECT event_id, round(least(base * (0.8::DOUBLE + 0.4::DOUBLE * r), 20000.0::DOUBLE), 6) AS delay_ms FROM b""",
    "region_tokens": f"WITH {_CONV}, src AS (SELECT conv_id AS doc_id, line_no, line FROM conv), {_dedup('o', 'src')} SELECT doc_id AS conv_id, count(*) AS n_lines, sum((length(line) + 3) // 4 + 1)::BIGINT AS tokens, sum(length(line))::BIGINT AS chars FROM o GROUP BY doc_id",
    "context_size": f"WITH {_SURFACE} SELECT conv_id, length(surface)::BIGINT AS chars, ((length(surface) + 3) // 4)::BIGINT AS tokens FROM surfaces",
    "budget_table": f"""WITH w(win) AS (VALUES {_values([(w,) for w in BUDGET_WINDOWS])}), o AS (SELECT win::BIGINT AS win, least(32768, floor(win::DOUBLE * 0.15::DOUBLE))::BIGINT AS output FROM w),
u AS (SELECT *, greatest(1, win - output - 1024)::BIGINT AS usable FROM o), c AS (SELECT *, greatest(1, floor(usable * 0.8::DOUBLE))::BIGINT AS chunk FROM u)
SELECT win AS "window", output, usable, chunk, greatest(0, floor(chunk * 0.1::DOUBLE))::BIGINT AS overlap FROM c""",
    "chunk_slices": f"WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS[:1])} SELECT * FROM chunks",
    "chunk_slices_pool": f"WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)} SELECT * FROM chunks",
    "digest_caps": f"WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)}, {_CAPS} SELECT doc_id, chunk, core_tokens, cap_tokens FROM caps",
    "split_halves": f"""WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)}, {_CAPS},
h AS (SELECT *, line_start + greatest(1, (line_end - line_start) // 2) AS mid FROM caps WHERE line_end - line_start >= 2),
s AS (SELECT h.*, m.s - a.s AS sa, b.s - m.s AS sb FROM h JOIN p a ON a.doc_id = h.doc_id AND a.i = line_start JOIN p m ON m.doc_id = h.doc_id AND m.i = mid JOIN p b ON b.doc_id = h.doc_id AND b.i = line_end),
t AS (SELECT *, floor(tokens * sa / (sa + sb)) AS ta, floor(tokens * sb / (sa + sb)) AS tb FROM s),
u AS (SELECT * FROM t WHERE ta >= 1 AND tb >= 1 AND ta < tokens AND tb < tokens)
SELECT doc_id, chunk, 1 AS half, line_start, mid AS line_end, ta::BIGINT AS tokens, greatest(1, floor(cap_tokens * sa / (sa + sb)))::BIGINT AS cap_tokens FROM u
UNION ALL SELECT doc_id, chunk, 2, mid, line_end, tb::BIGINT, greatest(1, floor(cap_tokens * sb / (sa + sb)))::BIGINT FROM u""",
    "persona_perfect": f"WITH RECURSIVE {_CHUNK_LINES}, {_PERFECT} SELECT doc_id, chunk, {_DIGEST} FROM perfect",
    "persona_leak": f"WITH RECURSIVE {_CHUNK_LINES}, d AS (SELECT doc_id, chunk, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS digest FROM cl WHERE idx % 4 <> 3 GROUP BY ALL) SELECT doc_id, chunk, {_DIGEST} FROM d",
    "persona_forgetful": f"WITH RECURSIVE {_CHUNK_LINES}, d AS (SELECT DISTINCT doc_id, chunk, '{FORGETFUL}' AS digest FROM cl) SELECT doc_id, chunk, {_DIGEST} FROM d",
    "merge_material": f"WITH RECURSIVE {_CHUNK_LINES}, {_PERFECT} SELECT doc_id, count(*) AS digests, sha256(string_agg('--- digest ' || (chunk + 1) || ' ---' || chr(10) || digest, chr(10) || chr(10) ORDER BY chunk)) AS material_sha256 FROM perfect GROUP BY doc_id",
    "compaction_graded": f"""WITH RECURSIVE {_CHUNK_LINES}, {_PERFECT}, {_MERGED},
f AS (SELECT doc_id, list_distinct(list(w)) AS need FROM (SELECT doc_id, regexp_extract(line, '^([A-Za-z]{{4,}})', 1) AS w FROM doc_lines) WHERE w <> '' GROUP BY doc_id),
g AS (SELECT doc_id, merge_levels, length(summary)::INT AS summary_chars, len(list_filter(need, lambda x: contains(lower(answer), lower(x))))::INT AS matched, len(need)::INT AS required FROM checkpoints JOIN f USING (doc_id))
SELECT *, round(matched / required, 6) AS recall FROM g""",
    "compression_ratio": f"WITH RECURSIVE {_CHUNK_LINES}, {_PERFECT}, {_MERGED} SELECT doc_id, length(text)::INT AS before_chars, length(answer)::INT AS after_chars, length(answer) < length(text) AS shrinks, CASE WHEN length(text) > 0 THEN round(length(answer) / length(text), 6) END AS ratio FROM documents JOIN checkpoints USING (doc_id)",
    "framed_shrinks": f"""WITH {_CONV}, {_NODES}, w AS (SELECT conv_id, line, min(line_no) AS line_no FROM conv WHERE {_WORTH} GROUP BY ALL), d AS (SELECT conv_id, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS digest FROM w GROUP BY conv_id),
n AS (SELECT session_id, sum(tokens) AS shadowed FROM nodes GROUP BY session_id) SELECT session_id, (length({_FRAME % "digest"}) + 3) // 4 + 8 < shadowed AS shrinks FROM n JOIN d ON conv_id = session_id""",
    "summary_decision": "SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'host' WHEN doc_id % 5 = 2 AND length(text) > 2000 THEN repeat('long ', 400) WHEN doc_id % 5 > 2 AND length(text) > 5 THEN 'short' ELSE 'host' END AS chosen FROM documents",
    "call_outcomes": """WITH e AS (SELECT event_id, event_id % 4 AS f, event_id % 7 = 0 AS image, event_id % 3 = 0 AS blank FROM events)
SELECT event_id, CASE f WHEN 2 THEN 'aborted' WHEN 0 THEN CASE WHEN image OR blank THEN 'fail' ELSE 'ok' END ELSE 'fail' END AS status,
  CASE f WHEN 2 THEN 'cancelled' WHEN 1 THEN 'provider error' WHEN 3 THEN 'MAX_TOKENS' ELSE CASE WHEN image THEN 'UNSUPPORTED_CONTENT' WHEN blank THEN 'no text' END END AS error FROM e""",
    "instructions": f"""WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)}, {_CAPS} SELECT doc_id, chunk, 2 AS messages, 'excerpt' AS first,
  'Condense the excerpt.' || chr(10) || chr(10) || CASE WHEN chunk > 0 THEN 'Keep the digest within ' || cap_tokens || ' tokens.' || chr(10) || chr(10) ELSE '' END || 'Keep names.' AS last FROM caps""",
    "synthetic_stream": """WITH k(n, type) AS (VALUES (0, 'block-start'), (1, 'text-delta'), (2, 'block-end'), (3, 'finish'))
SELECT conv_id, turn, n AS at, type, CASE WHEN n IN (1, 2) THEN text END AS text, CASE WHEN n = 3 THEN 'stop' END AS reason FROM conversations, k""",
    "tool_balance": f"WITH {_NODES} SELECT session_id, pos, delta, balanced_before, balanced_after FROM balance",
    "retention_range": f"""WITH {_NODES}, c AS (SELECT session_id, coalesce(max(CASE WHEN suffix >= 120 THEN pos END), 0) AS cut, coalesce(bool_or(pos = 0 AND is_system), false)::BIGINT AS start_pos FROM balance GROUP BY session_id)
SELECT session_id, start_pos, max(pos) - 1 AS end_pos FROM balance JOIN c USING (session_id) WHERE pos <= cut AND pos > start_pos AND balanced_before GROUP BY ALL""",
    "pressure_decision": f"WITH {_NODES} SELECT session_id, sum(tokens)::BIGINT AS total_tokens, 340::BIGINT AS threshold_tokens, 64::BIGINT AS retain_tokens, sum(tokens) >= 340 AS compact FROM nodes GROUP BY session_id",
    "validate_region": f"""WITH {_NODES}, s AS (SELECT session_id, min(seq) + session_id % 4 AS start_seq, max(seq) - session_id % 3 AS end_seq FROM nodes GROUP BY session_id)
SELECT s.*, CASE WHEN a.pos IS NULL THEN 'start not on surface' WHEN b.pos IS NULL THEN 'end not on surface' WHEN a.pos > b.pos THEN 'start after end' WHEN NOT a.balanced_before THEN 'start not balanced' WHEN NOT b.balanced_after THEN 'end not balanced' END AS error
FROM s LEFT JOIN balance a ON a.session_id = s.session_id AND a.seq = start_seq LEFT JOIN balance b ON b.session_id = s.session_id AND b.seq = end_seq""",
    "surface_after_replace": f"""WITH {_NODES}, z AS (SELECT session_id, max(seq) AS top, list(seq ORDER BY seq) AS s FROM nodes GROUP BY session_id),
v AS (SELECT session_id, seq AS place, seq FROM nodes JOIN z USING (session_id) WHERE len(s) < 4 OR seq NOT IN (s[2], s[3], s[4]) UNION ALL SELECT session_id, s[2], top + 2 FROM z WHERE len(s) >= 4)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS pos, seq FROM v""",
    "surface_streamed": f"""WITH {_NODES}, z AS (SELECT session_id, max(seq) AS top, list(seq ORDER BY seq) AS s FROM nodes GROUP BY session_id),
v AS (SELECT session_id, seq AS place, seq, tokens FROM nodes JOIN z USING (session_id) WHERE len(s) < 4 OR seq NOT IN (s[2], s[3], s[4]) UNION ALL SELECT session_id, s[2], top + 2, 0 FROM z WHERE len(s) >= 4)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS pos, seq, tokens::BIGINT AS tokens FROM v""",
    "surface_nested": f"WITH {_NODES} SELECT session_id, 0::BIGINT AS pos, min(seq) AS seq FROM nodes GROUP BY session_id UNION ALL SELECT session_id, 1, max(seq) + 10000 FROM nodes GROUP BY session_id HAVING count(*) > 1",
    "pressure_rounds": f"""WITH {_NODES}, n0 AS (SELECT session_id, pos, seq, tokens, delta, is_system FROM nodes), {_round(0)}, {_round(1)},
e AS (SELECT session_id, sum(tokens)::BIGINT AS total_tokens FROM n2 GROUP BY session_id),
x AS (SELECT session_id, total_tokens, (session_id IN (SELECT session_id FROM r0))::INT + (session_id IN (SELECT session_id FROM r1))::INT AS rounds,
  (t0.total >= 340 AND session_id NOT IN (SELECT session_id FROM r0)) OR (t1.total >= 340 AND session_id NOT IN (SELECT session_id FROM r1)) AS stuck FROM e JOIN t0 USING (session_id) JOIN t1 USING (session_id))
SELECT session_id, rounds, total_tokens, CASE WHEN rounds = 0 AND stuck THEN 'stuck' WHEN rounds = 0 THEN 'below' WHEN total_tokens < 340 THEN 'done' WHEN stuck THEN 'stuck' ELSE 'above' END AS status FROM x""",
    "keep_right": f"WITH {_NODES}, {_KEEP} SELECT * FROM k",
    "control_branch": f"WITH {_NODES}, {_KEEP} SELECT session_id, pos, seq FROM nodes LEFT JOIN k USING (session_id) WHERE NOT coalesce(pos BETWEEN start_pos AND end_pos, false)",
    "surface_stability": "SELECT conv_id AS session_id, NOT ((conv_id % 3 = 0 AND count(*) > 1) OR conv_id % 5 = 0) AS stable FROM conversations GROUP BY conv_id",
    "span_stability": f"""WITH {_NODES}, s AS (SELECT session_id, min(seq) AS start_seq, max(seq) AS end_seq FROM nodes WHERE pos BETWEEN 1 AND 3 GROUP BY session_id HAVING count(*) = 3)
SELECT *, [NULL, 'rewritten', 'changed', 'no longer a valid target'][session_id % 4 + 1] AS error FROM s""",
    "committed": f"""WITH {_NODES}, r AS (SELECT session_id, max(seq) AS top, list(seq ORDER BY pos) FILTER (pos IN (1, 2)) AS c, session_id % 4 = 0 AS bad FROM nodes GROUP BY session_id),
k(n, type) AS (VALUES (1, 'compaction/start'), (2, 'compaction/summary'), (3, 'user/message'), (4, 'compaction/end')), e AS (SELECT * FROM r, k WHERE c IS NOT NULL AND NOT (bad AND n IN (2, 3)))
SELECT session_id, top + CASE WHEN bad AND n = 4 THEN 2 ELSE n END AS seq, type, CASE WHEN n = 3 THEN 'replace' END AS op, CASE WHEN n = 3 THEN array_to_string(c, ',') END AS covers,
  CASE n WHEN 2 THEN array_to_string(c, ',') WHEN 3 THEN array_to_string(list_concat([top + 1, top + 2], c), ',') END AS sources, CASE WHEN n IN (2, 3) THEN 'S' WHEN bad AND n = 4 THEN 'not smaller' END AS text FROM e""",
    "compacted_log": rf"""WITH {_NODES}, c AS (SELECT session_id, coalesce(max(CASE WHEN suffix >= 120 THEN pos END), 0) AS cut, coalesce(bool_or(pos = 0 AND is_system), false)::BIGINT AS start_pos FROM balance GROUP BY session_id),
span AS (SELECT session_id, start_pos, max(pos) - 1 AS end_pos FROM balance JOIN c USING (session_id) WHERE pos <= cut AND pos > start_pos AND balanced_before GROUP BY ALL),
inside AS (SELECT n.* FROM nodes n JOIN span USING (session_id) WHERE pos BETWEEN start_pos AND end_pos),
l0 AS (SELECT session_id AS doc_id, pos, list_concat(['[' || role || ']'], regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS l FROM inside),
l1 AS (SELECT doc_id, pos, unnest(range(len(l))) AS idx, unnest(l) AS line FROM l0),
src AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, idx) - 1 AS line_no, line FROM l1),
{_dedup("d1", "src")}, {_purge("d2", "d1")}, {_blanks("d3", "d2")}, {_condense("d4", "d3", "balanced", 200)},
w AS (SELECT doc_id, line, min(line_no) AS line_no FROM d4 WHERE {_WORTH} GROUP BY ALL),
d AS (SELECT doc_id AS session_id, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS digest FROM w GROUP BY doc_id),
r AS (SELECT session_id, list(seq ORDER BY pos) AS c, sum(tokens) AS shadowed FROM inside GROUP BY session_id),
good AS (SELECT session_id, c, {_FRAME % "digest"} AS summary FROM r JOIN d USING (session_id) WHERE (length({_FRAME % "digest"}) + 3) // 4 + 8 < shadowed),
v AS (SELECT n.session_id, seq AS place, seq, role || '/message' AS type, text, 0 AS covered, 0::BIGINT AS batch FROM nodes n LEFT JOIN good g ON g.session_id = n.session_id WHERE c IS NULL OR NOT list_contains(c, seq)
      UNION ALL SELECT session_id, c[1], (SELECT max(seq) FROM nodes n WHERE n.session_id = good.session_id) + 3, 'user/message', summary, len(c)::INT, 1 FROM good)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS pos, seq, type, sha256(text) AS text_sha256, covered, batch FROM v""",
    "entry_state": """WITH e AS (SELECT user_id AS session_id, event_id AS seq, event_id % 5 AS k, event_id * 2 AS turn FROM events),
s AS (SELECT session_id, max(seq) FILTER (k IN (0, 1)) AS t, max(seq) FILTER (k IN (2, 3)) AS c, max(seq) FILTER (k = 4) AS last_seed FROM e GROUP BY session_id)
SELECT session_id, CASE WHEN t % 5 = 0 THEN t * 2 END AS open_turn, CASE WHEN c % 5 = 2 THEN c END AS open_start, last_seed, coalesce(c % 5 = 2 AND (last_seed IS NULL OR last_seed <= c), false) AS busy FROM s""",
    "derive_span": f"""WITH {_NODES}, r AS (SELECT session_id, pos - session_id % 3 AS idx, text FROM nodes WHERE pos >= session_id % 3 AND pos < session_id % 3 + 3),
t AS (SELECT r.session_id, o, count(*) AS hits, min(n.seq) AS start_seq, max(n.seq) AS end_seq FROM r, (VALUES (0), (1)) x(o), nodes n WHERE n.session_id = r.session_id AND n.pos = r.idx + o AND n.text = r.text GROUP BY ALL),
k AS (SELECT session_id, count(*) AS n FROM r GROUP BY session_id)
SELECT session_id, start_seq, end_seq FROM t JOIN k USING (session_id) WHERE hits = n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY o) = 1""",
    "pool_validation": f"""WITH {_POOL}, pr(provider, listable) AS (VALUES {_values(PROVIDERS)}), cat(provider, model) AS (VALUES {_values(CATALOG)})
SELECT tier_name, key, CASE WHEN listable IS NULL THEN 'provider is not registered' WHEN NOT listable THEN 'provider does not publish a model catalog' ELSE 'model is not in the provider catalog' END AS reason
FROM pool LEFT JOIN pr USING (provider) WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.provider = pool.provider AND cat.model = pool.model)""",
    "route_capacity": f'WITH {_POOL} SELECT key, win::BIGINT AS "window", mt::BIGINT AS max_tokens, cooled::BIGINT AS cooled_until, healthy FROM pool',
    "merge_holdable": f"WITH {_POOL}, w(mw) AS (VALUES (3000), (262144), (300000)) SELECT mw::BIGINT AS merge_window, coalesce(bool_or(healthy AND win >= mw), false) AS holdable FROM pool, w GROUP BY mw",
    "route_pick": f"""WITH RECURSIVE {_LINES}, {_chunks('doc_lines', [20000, 30000])}, {_POOL},
t AS (SELECT doc_id || '-' || chunk AS task, tokens, CASE WHEN (doc_id + chunk) % 5 = 0 THEN 'p1/m2' ELSE '' END AS pref, (doc_id + chunk) % 7 = 0 AS retry, (doc_id + chunk) % 3 = 0 AS splittable FROM chunks),
x AS (SELECT t.*, pool.*, healthy AND tokens + 512 + least(mt, least(32768, floor(win * 0.15::DOUBLE))) <= win AS fits, key <> 'p2/m3' AS free FROM t, pool),
y AS (SELECT task, retry, splittable, tier_idx, bool_or(healthy) AS any_healthy, bool_or(fits) AS any_fits, first(key ORDER BY key <> pref, CASE WHEN retry THEN -win ELSE 0 END, pos) FILTER (fits AND free) AS key FROM x GROUP BY ALL),
z AS (SELECT *, NOT any_fits AND retry AND splittable AND any_healthy AS split FROM y),
f AS (SELECT task, first({{'key': key, 'tier_idx': tier_idx, 'split': split}} ORDER BY tier_idx) FILTER (any_fits OR split) AS s FROM z GROUP BY task)
SELECT task, s.key, s.tier_idx, coalesce(s.split, false) AS split, s IS NOT NULL AND NOT s.split AND s.key IS NULL AS waits FROM f""",
    "route_deal": f"""WITH {_POOL}, t AS (SELECT doc_id AS task, coalesce((length(text) + 3) // 4, 0) AS tokens, CASE WHEN doc_id % 5 = 0 THEN 'p1/m2' ELSE '' END AS pref FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT * FROM t, pool WHERE tokens + 512 + least(mt, least(32768, floor(win * 0.15::DOUBLE))) <= win QUALIFY tier_idx = min(tier_idx) OVER (PARTITION BY task)),
c AS (SELECT *, sum(max_concurrent) OVER (PARTITION BY task ORDER BY pos) AS hi, sum(max_concurrent) OVER (PARTITION BY task) AS total, bool_or(key = pref) OVER (PARTITION BY task) AS has FROM f)
SELECT task, first(c.key) AS key, first(c.tier_idx) AS tier_idx FROM t LEFT JOIN c USING (task) WHERE c.key IS NULL OR CASE WHEN has THEN c.key = c.pref ELSE task % total >= hi - max_concurrent AND task % total < hi END GROUP BY task""",
    "pool_reset": f"WITH {_POOL} SELECT {NOW}::BIGINT AS at, key, healthy, false AS reset FROM pool UNION ALL SELECT 0, key, cooled <= 0, false FROM pool UNION ALL SELECT -1, key, true, true FROM pool",
    "merge_plan": f"""WITH {_POOL}, c(digests, merge_window, may) AS (VALUES (1, 1500, true), (3, 1500, true), (3, 1000000000, true), (3, 1000000000, false), (0, 1500, true)),
h AS (SELECT *, (SELECT bool_or(healthy AND win >= merge_window) FROM pool) AS ok FROM c)
SELECT digests, merge_window, may AS may_fall_back, CASE WHEN digests = 1 THEN 'single' WHEN digests > 1 AND ok THEN 'merge' WHEN may THEN 'fallback' ELSE 'error' END AS plan,
  (digests > 1 AND ok)::INT AS merge_levels, CASE WHEN digests = 0 THEN 'pool-unusable' WHEN digests > 1 AND NOT ok THEN 'no-merge-model' END AS reason, digests > 1 AND NOT ok AND NOT may AS fails FROM h""",
    "local_quarantine": f"WITH {_ATTEMPTS} SELECT key, max(u)::BIGINT AS cooldown_until FROM (SELECT model AS key, pos + 1800000 AS u FROM a WHERE error IS NOT NULL UNION ALL VALUES ('p0/m', 5), ('other/m', 7)) GROUP BY key",
    "cooldowns_cleared": "SELECT 'x' AS key, 0::BIGINT AS cooldown_until WHERE false",
    "chunk_routes": f"WITH {_POOL} SELECT key, ((row_number() OVER (ORDER BY pos) + 1) % 3)::INT AS turn FROM pool WHERE tier_idx = 0",
    "earliest_expiry": f"WITH {_POOL} SELECT min(cooled) FILTER (cooled > {NOW})::BIGINT AS earliest, count(*) > 0 AND bool_and(NOT healthy) AS all_cooled, string_agg(key || CASE WHEN healthy THEN '=healthy' ELSE '=cooled' END, ', ' ORDER BY tier_idx, pos) AS summary FROM pool",
    "attempts_summary": f"""WITH {_ATTEMPTS}, b AS (SELECT job, model, count(*) AS n, arg_max(error, pos) FILTER (true) AS x, first(error ORDER BY pos DESC) AS last, min(pos) AS first FROM a GROUP BY ALL),
s AS (SELECT job, string_agg(model || ' x' || n || CASE WHEN last IS NULL THEN '' ELSE ' (last: ' || last || ')' END, '; ' ORDER BY first) AS s FROM b GROUP BY job)
SELECT job, CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS summary FROM s""",
    "calls_by_route": f"WITH {_ATTEMPTS} SELECT model, count(*) AS calls, count(error) AS failures, max(pos * 10 + pos % 7) - min(pos * 10) AS duration_ms FROM a GROUP BY model",
    "collapse_error": f"""WITH {_ATTEMPTS}, b AS (SELECT job, model, count(*) AS n, first(error ORDER BY pos DESC) AS last, min(pos) AS first FROM a WHERE job % 2 = 0 GROUP BY ALL),
s AS (SELECT job, string_agg(model || ' x' || n || CASE WHEN last IS NULL THEN '' ELSE ' (last: ' || last || ')' END, '; ' ORDER BY first) AS s FROM b GROUP BY job)
SELECT DISTINCT a.job, sha256('no route is left' || CASE WHEN s IS NULL THEN '' ELSE '; attempts: ' || CASE WHEN length(s) > 500 THEN substr(s, 1, 499) || '…' ELSE s END END) AS error_sha256 FROM a LEFT JOIN s USING (job)""",
    "combined_parts": """WITH m AS (SELECT conv_id, string_agg(m, ',' ORDER BY t) AS models FROM (SELECT conv_id, 'p/m' || (turn % 2) AS m, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_sha256, 'p' AS provider, 'm' || (min(turn) % 2) AS model, (min(turn) * 100)::BIGINT AS max_tokens, string_agg('try ' || turn, ',' ORDER BY turn) AS attempts,
  bool_or(turn = 3) AS fallback, count(*)::INT AS split_into, first(models) AS models FROM conversations JOIN m USING (conv_id) GROUP BY conv_id""",
    "recorded_once": f"WITH {_ATTEMPTS} SELECT pos % 97 AS failure_id, pos, error FROM a WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pos % 97 ORDER BY pos) = 1",
    "cooldown_upsert": f"WITH {_ATTEMPTS} SELECT model AS key, max(pos) + 1800000 AS cooldown_until FROM a WHERE error IS NOT NULL GROUP BY model UNION ALL SELECT 'other/m', 7 UNION ALL SELECT 'p0/m', 5 WHERE NOT EXISTS (SELECT 1 FROM a WHERE error IS NOT NULL AND model = 'p0/m')",
    "run_record": """SELECT event_id AS "at", CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'pressure' END AS trigger, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 > 0 THEN 'p1/m1' ELSE 'fallback' END AS route, event_id % 5 = 0 AS failed,
CASE WHEN event_id % 5 = 0 THEN 'outer failed: cause ' || event_id END AS error, (event_id % 300)::INT AS "snapshotChars", (CASE WHEN event_id % 300 > 100 THEN 100 + length('.[elided  chars].') + length((event_id % 300 - 100)::VARCHAR) + 2 ELSE event_id % 300 END)::INT AS snapshot_length FROM events""",
    "runlog_recent": """SELECT event_id AS "at", CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 > 0 THEN 'p1/m1' ELSE 'fallback' END AS route FROM events ORDER BY event_id % 3, event_id DESC LIMIT 20""",
    "runlog_capped": """WITH e AS (SELECT event_id AS "at", CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 > 0 THEN 'p1/m1' ELSE 'fallback' END AS route FROM events),
n AS (SELECT * FROM e ORDER BY "at" % 3, "at" DESC LIMIT 500) SELECT * FROM n UNION ALL SELECT * FROM e WHERE "at" < 10""",
    "runlog_read_back": "SELECT conv_id AS session_id, 'c' || conv_id AS compaction_id, (1 - turn)::INT AS at, turn::BIGINT AS seq, text FROM conversations WHERE conv_id % 3 = 0 AND turn IN (0, 1)",
    "chunk_attribution": f"""WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)}, {_CAPS}
SELECT doc_id, chunk, CASE WHEN (doc_id + chunk) % 4 > 0 AND chunk % 2 = 0 THEN 'p1/m1' ELSE 'route-' || route END AS model, line_start, line_end, tokens, core_tokens, cap_tokens, CASE WHEN (doc_id + chunk) % 4 > 0 THEN tokens // 4 END AS digest_tokens FROM caps""",
    "grep_retrieval": f"WITH {_NEEDLES}, {_grep('g', 'documents')} SELECT needle, hits FROM g",
    "retrieval_recall": f"""WITH {_LINES}, {_dedup('ht_in', 'doc_lines')}, {_head_tail(2000, 900, 500)}, kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ht GROUP BY doc_id),
{_NEEDLES}, {_grep('b', 'documents')}, {_grep('k', 'kept')}, s AS (SELECT sum((b.hits > 0)::INT)::BIGINT AS found_before, sum((b.hits > 0 AND k.hits > 0)::INT)::BIGINT AS found_after FROM b JOIN k USING (needle))
SELECT *, CASE WHEN found_before > 0 THEN round(found_after / found_before, 6) END AS recall FROM s""",
    "probe_recall": f"WITH {_GRADES} SELECT conv_id, matched, required, CASE WHEN required > 0 THEN round(matched / required, 6) END AS recall, array_to_string(missing, ',') AS missing FROM grades",
    "faithfulness": f"WITH {_GRADES} SELECT conv_id % 4 AS episode, sum(matched)::BIGINT AS matched, sum(required)::BIGINT AS required, round(sum(matched) / sum(required), 6) AS faithfulness FROM grades GROUP BY ALL",
    "suite_means": f"WITH {_GRADES} SELECT conv_id % 4 AS episode, round(avg(CASE WHEN required > 0 THEN matched / required END), 3) AS mean_recall FROM grades GROUP BY ALL",
    "suite_a": f"""WITH {_GRADES}, {_NODES}, {_KEEP},
placed AS (SELECT nodes.*, coalesce(pos BETWEEN start_pos AND end_pos, false) AS inside FROM nodes LEFT JOIN k USING (session_id)),
rl0 AS (SELECT session_id AS doc_id, pos, list_concat(['[' || role || ']'], {_SPLIT}) AS l FROM placed WHERE inside), rl1 AS (SELECT doc_id, pos, unnest(range(len(l))) AS idx, unnest(l) AS line FROM rl0),
rl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, idx) - 1 AS line_no, line FROM rl1), {_dedup('rd', 'rl')},
pf AS (SELECT doc_id, line, min(line_no) AS line_no FROM rd WHERE {_WORTH} GROUP BY ALL), dg AS (SELECT doc_id, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS digest FROM pf GROUP BY doc_id),
kept AS (SELECT session_id AS conv_id, pos, role, text FROM placed WHERE NOT inside), cd AS (SELECT doc_id AS conv_id, 1 AS pos, 'user' AS role, {_FRAME % "digest"} AS text FROM dg),
tb AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY pos) AS text FROM (SELECT * FROM kept UNION ALL SELECT * FROM cd) GROUP BY conv_id),
cb AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY pos) AS text FROM kept GROUP BY conv_id),
{_suite('tg', 'tb')}, {_suite('cg', 'cb')}
SELECT tg_g.conv_id % 4 AS episode, tg_g.persona, count(*) AS probes, round(avg(tg_g.recall), 6) AS recall, round(avg(cg_g.recall), 6) AS control_recall, round(avg(tg_g.recall) - avg(cg_g.recall), 6) AS gain,
  round(avg((({_ANY(REJECTIONS)} AND {_ANY(ADOPTIONS)}))::INT), 6) AS hallucination FROM tg_g JOIN (SELECT conv_id, persona, recall FROM cg_g) cg_g ON cg_g.conv_id = tg_g.conv_id AND cg_g.persona = tg_g.persona GROUP BY ALL""",
    "suite_matrix": f"""WITH {_GRADES}, {_NODES}, {_KEEP},
placed AS (SELECT nodes.*, coalesce(pos BETWEEN start_pos AND end_pos, false) AS inside FROM nodes LEFT JOIN k USING (session_id)),
rl0 AS (SELECT session_id AS doc_id, pos, list_concat(['[' || role || ']'], {_SPLIT}) AS l FROM placed WHERE inside), rl1 AS (SELECT doc_id, pos, unnest(range(len(l))) AS idx, unnest(l) AS line FROM rl0),
rl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, idx) - 1 AS line_no, line FROM rl1), {_dedup('rd', 'rl')}, ht_in AS (SELECT * FROM rd), {_head_tail(600, 300, 80)},
pf AS (SELECT 'default' AS v, doc_id, line, min(line_no) AS line_no FROM rd WHERE {_WORTH} GROUP BY ALL UNION ALL SELECT 'legacy', doc_id, line, min(line_no) FROM ht WHERE {_WORTH} GROUP BY ALL),
dg AS (SELECT v, doc_id, 'SUMMARY:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS digest FROM pf GROUP BY v, doc_id),
ctx AS (SELECT x AS v, session_id AS conv_id, pos, role, text FROM placed, (VALUES ('default'), ('legacy'), ('control'), ('whole')) w(x) WHERE NOT inside OR x = 'whole'
  UNION ALL SELECT v, doc_id, 1, 'user', {_FRAME % "digest"} FROM dg),
sf AS (SELECT v, conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY pos) AS text FROM ctx GROUP BY v, conv_id),
vd AS (SELECT conv_id, text FROM sf WHERE v = 'default'), vl AS (SELECT conv_id, text FROM sf WHERE v = 'legacy'), vc AS (SELECT conv_id, text FROM sf WHERE v = 'control'),
{_suite('d', 'vd')}, {_suite('l', 'vl')}, {_suite('c', 'vc')},
z AS (SELECT conv_id, sum(length(text)) FILTER (v = 'default') AS zd, sum(length(text)) FILTER (v = 'legacy') AS zl, sum(length(text)) FILTER (v = 'whole') AS zw FROM sf GROUP BY conv_id),
g AS (SELECT d_g.conv_id, d_g.persona, d_g.recall AS rd, l_g.recall AS rl, c_g.recall AS rc, d_g.t AS td, l_g.t AS tl FROM d_g JOIN l_g ON l_g.conv_id = d_g.conv_id AND l_g.persona = d_g.persona JOIN c_g ON c_g.conv_id = d_g.conv_id AND c_g.persona = d_g.persona)
SELECT conv_id % 4 AS episode, persona, count(*) AS probes, round(avg(rd), 6) AS recall_default, round(avg(rl), 6) AS recall_legacy, round(avg(rc), 6) AS recall_control,
  round(avg(({_ANY(REJECTIONS).replace("contains(t,", "contains(td,")} AND {_ANY(ADOPTIONS).replace("contains(t,", "contains(td,")})::INT), 6) AS hallucination_default,
  round(avg(({_ANY(REJECTIONS).replace("contains(t,", "contains(tl,")} AND {_ANY(ADOPTIONS).replace("contains(t,", "contains(tl,")})::INT), 6) AS hallucination_legacy,
  round(sum(zd) / sum(zw), 6) AS ratio_default, round(sum(zl) / sum(zw), 6) AS ratio_legacy FROM g JOIN z USING (conv_id) GROUP BY ALL""",
    "request_sizes": f"""WITH RECURSIVE {_LINES}, {_chunks('doc_lines', WINDOWS)},
w AS (SELECT *, [{", ".join(map(str, WINDOWS))}][route + 1]::BIGINT AS win, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks), x AS (SELECT *, tokens + 512 AS i, least(32768, floor(win * 0.15::DOUBLE))::BIGINT AS o FROM w)
SELECT doc_id, chunk, win AS "window", i AS input_tokens, o AS output_tokens, i + o <= win AS within, n AS chunks, (n > 1)::INT AS merge_calls FROM x""",
    "suite_report": f"WITH {_GRADES}, m AS (SELECT conv_id % 4 AS episode, round(avg(CASE WHEN required > 0 THEN matched / required END), 3) AS r FROM grades GROUP BY ALL) SELECT '| ' || episode || ' | ' || coalesce(printf('%.3f', r), 'n/a') || ' |' AS line FROM m",
    "suite_table": f"""WITH {_GRADES}, m AS (SELECT conv_id % 4 AS episode, printf('%.3f', round(avg(CASE WHEN required > 0 THEN matched / required END), 3)) AS r FROM grades GROUP BY ALL)
SELECT 0 AS part, NULL AS episode, 'episode  recall' AS line UNION ALL SELECT 1, NULL, '-------  ------' UNION ALL SELECT 2, episode, rpad(episode::VARCHAR, 7, ' ') || '  ' || rpad(r, 6, ' ') FROM m""",
    "suite_json": f"WITH {_GRADES}, m AS (SELECT conv_id % 4 AS episode, round(avg(CASE WHEN required > 0 THEN matched / required END), 3) AS r FROM grades GROUP BY ALL) SELECT '{{\"episode\":' || episode || ',\"mean_recall\":' || coalesce(r::VARCHAR, 'null') || '}}' AS line FROM m",
    "hallucination": f"""WITH t AS (SELECT conv_id, turn, lower(text || CASE conv_id % 6 WHEN 0 THEN ' We rejected it and also chose it.' WHEN 1 THEN ' OLDNAME is still valid.' WHEN 2 THEN ' It was rejected; we decided so.' WHEN 3 THEN ' OLDNAME is gone.' ELSE '' END) AS t FROM conversations)
SELECT conv_id, turn, ({_ANY(REJECTIONS)} AND {_ANY(ADOPTIONS)}) OR (contains(t, 'oldname') AND regexp_matches(t, '{STALE_CLAIM}')) OR (turn % 2 = 0 AND contains(t, 'rejected') AND regexp_matches(t, '{FLIP}')) AS hallucinated FROM t""",
    "snapshot_cap": "WITH s AS (SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 160) || chr(10) || '…[elided ' || (length(text) - 200) || ' chars]…' || chr(10) || right(text, 40) ELSE text END AS s FROM documents) SELECT doc_id, length(s)::INT AS chars, sha256(s) AS snapshot_sha256 FROM s",
    "text_previews": r"WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents) SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint, CASE WHEN length(p) > 80 THEN substr(p, 1, 79) || '…' ELSE p END AS preview FROM s",
    "anchor_block": f"""WITH {_SURFACE}, h AS (SELECT conv_id, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(surface, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS h FROM surfaces),
i AS (SELECT conv_id, '{ANCHOR}' || upper(to_base(h, 36)) AS id FROM h), b AS (SELECT *, '<session-search-anchors>' || chr(10) || '{{"id":"' || id || '","sessionId":' || conv_id || '}}' || chr(10) || '</session-search-anchors>' AS block FROM i)
SELECT *, 'a summary' || chr(10) || chr(10) || block || chr(10) || chr(10) || '{RECOVERY.replace(chr(39), chr(39) * 2)}' AS answer FROM b""",
    "duplicate_routes": f"WITH {_ATTEMPTS} SELECT job || '-' || model AS key, count(*) AS n FROM a GROUP BY key HAVING count(*) > 1",
}
