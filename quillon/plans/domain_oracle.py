"""DuckDB SQL for the queries on domain records, worked from the volume tables and not from the records."""

from __future__ import annotations

# -- inputs

_TRUTH = """t AS (SELECT doc_id AS ord, source AS cve, [lang, 'b' || doc_id % 7, lang] AS vuln, ['b' || doc_id % 5, 'b' || doc_id % 5, 'p'] AS patch,
  CASE WHEN doc_id % 3 > 0 THEN ['b' || doc_id % 4, 'n'] ELSE [] END AS na FROM documents)"""
_LAST = "k AS (SELECT * FROM t WHERE ord = (SELECT max(ord) FROM t x WHERE x.cve = t.cve))"


def _first_places(lists: str, keys: str) -> str:
    """Positions of a list's distinct members, by their first places."""
    return f"""u AS (SELECT {keys}, unnest(l) AS "binary", generate_subscripts(l, 1) AS i FROM ({lists})), m AS (SELECT {keys}, "binary", min(i) AS i FROM u GROUP BY ALL)
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS INTEGER) AS pos, "binary" FROM m"""


def _refused(times: str) -> str:
    return f"""WITH r AS (SELECT doc_id, {times} AS n FROM documents), e AS (SELECT doc_id, unnest(range(n)) AS i FROM r)
SELECT count(*) AS bad, (SELECT string_agg(doc_id, ', ' ORDER BY doc_id) FROM (SELECT doc_id FROM e ORDER BY doc_id LIMIT 5)) AS sample FROM e"""


_ENV_K, _ENV_NAME = "event_id % 8", "'N' || event_id % 11"
_ENV = f"""e AS (SELECT user_id, event_id, {_ENV_NAME} AS name, CASE {_ENV_K} WHEN 2 THEN 'v=' || event_id WHEN 3 THEN 'v=' || event_id WHEN 6 THEN 'v=' || event_id WHEN 7 THEN 'v=' || event_id END AS value, {_ENV_K} AS k FROM events),
g AS (SELECT user_id, event_id, CASE WHEN k = 6 THEN 'export' || name ELSE name END AS name, CASE k WHEN 2 THEN value || '''"' ELSE value END AS value FROM e WHERE k IN (2, 3, 6, 7)),
h AS (SELECT user_id, event_id, name, rtrim(rtrim(value, '"'), '''') AS value FROM g)"""

# -- traces

_TRACE = """x AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type, event_id % 2 AS c FROM events WHERE event_id % 13 <> 0),
cmd AS (SELECT run_id, 'c' || c AS id, seq, event_type = 'purchase' AS done, lag(CASE WHEN event_type = 'view' THEN seq END) OVER (PARTITION BY run_id, c ORDER BY seq) AS opened FROM x WHERE event_type IN ('view', 'purchase')),
ran AS (SELECT run_id, id, 'a|b ' || seq AS command, CAST(coalesce(opened, seq) AS DOUBLE) AS started_at, CAST(seq AS DOUBLE) AS completed_at, CAST(seq - coalesce(opened, seq) AS DOUBLE) AS elapsed,
  CASE WHEN seq % 5 > 0 THEN seq % 3 END AS exit_code, 2 + seq % 7 AS output_bytes, row_number() OVER (PARTITION BY run_id ORDER BY seq - coalesce(opened, seq) DESC, seq) AS rank, seq FROM cmd WHERE done),
trn AS (SELECT run_id, seq, event_type = 'click' AS done, lag(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY run_id ORDER BY seq) AS opened FROM x WHERE event_type IN ('signup', 'click')),
turned AS (SELECT run_id, seq, CAST(coalesce(opened, seq) AS DOUBLE) AS started_at, CAST(seq AS DOUBLE) AS completed_at, CAST(seq - coalesce(opened, seq) AS DOUBLE) AS elapsed, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM trn WHERE done),
runs AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(min(event_id) AS DOUBLE) AS started_at, CAST(count(*) AS DOUBLE) AS elapsed, 0 AS returncode FROM events GROUP BY user_id UNION ALL SELECT 'none', 0, 1.5, NULL)"""

_HEADS = ("| Turn | Duration (s) | Input Tokens | Cached Input | Output Tokens | Reasoning Tokens |\n|---:|---:|---:|---:|---:|---:|", "| Rank | Duration (s) | Exit | Output Bytes | Command |\n|---:|---:|---:|---:|---|")

# -- symbols

_SYMBOLS = """s AS (SELECT user_id AS "binary", event_id AS addr, event_type AS name, lead(event_id) OVER w AS next, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""

_VIEW = f"""WITH {_SYMBOLS},
q AS (SELECT user_id AS id, max(event_id) AS top, max(event_id) % 3 = 0 AS debug, user_id % 4 AS k, CASE WHEN user_id % 5 = 0 THEN 300 ELSE 64 END AS cap FROM events GROUP BY user_id),
f AS (SELECT "binary", min_by(addr, r) AS addr, min_by(next, r) AS next FROM s WHERE name = 'error' GROUP BY 1),
p AS (SELECT q.*, CASE WHEN k = 0 THEN f.addr WHEN k IN (1, 2) THEN greatest(0, top - 250) END AS start,
  CASE WHEN k = 0 THEN greatest(f.addr + 1, least(coalesce(f.next, f.addr + 500), f.addr + 500)) WHEN k IN (1, 2) THEN top + 250 END AS stop,
  CASE WHEN k = 0 AND f.addr IS NULL THEN 'symbol not found: error; first symbols: ' || (SELECT string_agg(name, ', ' ORDER BY r) FROM s WHERE s."binary" = q.id AND r <= 20) END AS error FROM q LEFT JOIN f ON f."binary" = q.id),
l AS (SELECT p.id, p.k, p.cap, e.event_id AS n, upper(to_hex(e.event_id)) || ': ' || e.event_type || chr(10) AS line, regexp_matches(e.event_type, 'view|sign') AS hit FROM p JOIN events e ON e.user_id = p.id AND p.error IS NULL AND (p.start IS NULL OR (e.event_id >= p.start AND e.event_id < p.stop))),
c AS (SELECT *, CASE WHEN k IN (2, 3) AND row_number() OVER (PARTITION BY id ORDER BY n) > 1 THEN '--' || chr(10) || line ELSE line END AS chunk FROM l WHERE k NOT IN (2, 3) OR hit),
z AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
o AS (SELECT id, left(string_agg(chunk, '' ORDER BY n), any_value(cap)) AS t, sum(length(chunk)) > any_value(cap) AS cut, count(*) FILTER (hit AND before <= cap) AS matched FROM z GROUP BY id)
SELECT p.id, CASE WHEN error IS NULL THEN CASE WHEN k = 0 THEN '# view symbol=error range=0x' || lower(to_hex(start)) || ':0x' || lower(to_hex(stop)) || ' window=500' WHEN k IN (1, 2) THEN '# view addr=0x' || lower(to_hex(top)) || ' range=0x' || lower(to_hex(start)) || ':0x' || lower(to_hex(stop)) || ' window=500' ELSE '# view grep=''view|sign'' full-disassembly-scan context=0' END || chr(10)
  || CASE WHEN p.id % 2 = 0 AND NOT debug THEN '# note: --line-numbers ignored because binary has no .debug_line section' || chr(10) ELSE '' END
  || CASE WHEN k IN (2, 3) THEN '# matches=' || coalesce(matched, 0) || ' max_output_bytes=' || cap || chr(10) ELSE '' END || coalesce(t, '')
  || CASE WHEN coalesce(cut, false) THEN chr(10) || '# TRUNCATED: ' || CASE WHEN k = 3 THEN 'narrow --grep, reduce --context, or use --addr/--symbol.' WHEN k = 2 THEN 'use a smaller --window/--context or a more specific --grep.' ELSE 'use a smaller --window or add --grep.' END || chr(10) ELSE '' END END AS text, error
FROM p LEFT JOIN o USING (id)"""

# -- whole-function analysis: n assignments, the c-th is patched, k tells what is amiss

_PROJECT = """d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS fn, doc_id % 4 + 2 AS n, doc_id % (doc_id % 4 + 2) + 1 AS c, doc_id % 10 AS k FROM documents),
ok AS (SELECT * FROM d WHERE k NOT IN (5, 6, 8, 9)),
near AS (SELECT * FROM ok WHERE k <> 3),
a AS (SELECT ok.*, unnest(range(1, n + 1)) AS i FROM ok)"""

# the variables that the added line names: v(c), v(c-1) and K(c)
_USES = f"""WITH {_PROJECT}, v AS (SELECT *, c AS i FROM near UNION ALL SELECT *, c - 1 FROM near),
e AS (
  SELECT fn, 4 AS line, 4 AS end_line, 'v' || i AS var, 'def_decl' AS op, 'declaration' AS node_type, NULL AS rhs, NULL AS callee FROM v WHERE i > 0
  UNION ALL SELECT fn, 2, 2, 'v0', 'param_def', 'parameter_declaration', NULL, NULL FROM v WHERE i = 0
  UNION ALL SELECT fn, 4 + i, 4 + i, 'v' || i, 'def', 'assignment_expression', 'K' || i || ',v' || (i - 1), NULL FROM v WHERE i > 0
  UNION ALL SELECT fn, 5 + i, 5 + i, 'v' || i, 'use', 'assignment_expression', NULL, NULL FROM v WHERE i < n
  UNION ALL SELECT fn, 4 + c, 4 + c, 'K' || c, 'use', 'assignment_expression', NULL, NULL FROM near
  UNION ALL SELECT fn, 5 + n, 6 + n, 'v' || i, 'use_control', 'if_statement', NULL, NULL FROM v WHERE i = n
  UNION ALL SELECT fn, 6 + n, 6 + n, 'v' || i, 'use_call', 'call_expression', NULL, 'send' FROM v WHERE i = n
  UNION ALL SELECT fn, 7 + n, 7 + n, 'v' || i, 'use_control', 'return_statement', NULL, NULL FROM v WHERE i = n)
SELECT fn, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, var, op, node_type, rhs, callee FROM e"""

_EDGES = f"""{_PROJECT}, v AS (SELECT *, c AS i FROM near UNION ALL SELECT *, c - 1 FROM near),
g AS (SELECT fn, c, 'param:v0' AS source, 'v0' AS "to", 2 AS line, 'param_def' AS kind, 0 AS pos FROM v WHERE i = 0
  UNION ALL SELECT fn, c, CASE WHEN i = 1 THEN 'param:v0' ELSE 'local:v' || (i - 1) END, 'v' || i, 4 + i, 'rhs_dep', 1 FROM v WHERE i > 0
  UNION ALL SELECT fn, c, 'global_or_external:K' || i, 'v' || i, 4 + i, 'rhs_dep', 0 FROM v WHERE i > 0 AND i < c
  UNION ALL SELECT fn, c, 'macro:K' || c, 'v' || c, 4 + c, 'rhs_dep', 0 FROM near WHERE k = 7)"""  # the text after the patch stands in

_FLOW = f"""WITH {_EDGES},
w AS (SELECT fn, "to", string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, string_agg('  - ' || CASE kind WHEN 'param_def' THEN 'v0 defined from function parameter at line 2' ELSE "to" || ' depends on ' || regexp_replace(source, '^[a-z_]+:', '') || ' at line ' || line END, chr(10) ORDER BY pos) AS why FROM g GROUP BY ALL),
s AS (SELECT fn, string_agg('- Sink var `' || "to" || '`' || chr(10) || '  Sources: ' || sources || chr(10) || why, chr(10) ORDER BY "to") AS items FROM w GROUP BY fn),
t AS (SELECT fn, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM g GROUP BY fn),
y AS (SELECT fn, 'v' || (c - 1) || ',v' || c AS sink_vars, sources, '[4' AS head, c, items FROM near JOIN s USING (fn) JOIN t USING (fn))
SELECT fn, sink_vars, sources, '[Pre-patch Source-Sink Flow]' || chr(10) || 'Old patch lines (treated as sink region): [' || (4 + c) || ']' || chr(10) || 'Old-line idents: ' || replace(sink_vars, ',', ', ') || chr(10) || 'Sink-adjacent variables: ' || replace(sink_vars, ',', ', ') || chr(10) || items AS text FROM y
UNION ALL SELECT fn, '', '', '[Pre-patch Source-Sink Flow]' || chr(10) || 'Old patch lines (treated as sink region): [900]' || chr(10) || 'Old-line idents: x' || chr(10) || 'Sink-adjacent variables: (none)' FROM ok WHERE k = 3"""

ORACLES: dict[str, str] = {
    "groundtruth_normalize": f"WITH {_TRUTH}, {_LAST}, " + _first_places("SELECT cve, 'vuln' AS side, vuln AS l FROM k UNION ALL SELECT cve, 'patch', patch FROM k UNION ALL SELECT cve, 'not_affected', na FROM k", "cve, side"),
    "groundtruth_invalid": _refused("CASE WHEN doc_id % 40 = 7 OR doc_id % 50 = 9 THEN 1 ELSE 0 END"),
    "expected_status": f"""WITH {_TRUTH}, {_LAST}, u AS (SELECT cve, unnest(patch) AS "binary", 0 AS r FROM k UNION ALL SELECT cve, unnest(vuln), 1 FROM k UNION ALL SELECT cve, unnest(na), 2 FROM k)
      SELECT cve, "binary", ['present', 'absent', 'not_affected'][min(r) + 1] AS expected FROM u GROUP BY ALL""",
    "testset_normalize": f"WITH {_TRUTH}, {_LAST}, " + _first_places("SELECT cve, CASE WHEN ord % 2 = 0 THEN ['x', 'x' || ord % 9, 'x'] ELSE vuln || patch || na END AS l FROM k", "cve"),
    "testset_invalid": _refused("CASE doc_id % 60 WHEN 11 THEN 1 WHEN 20 THEN 1 WHEN 31 THEN 2 WHEN 41 THEN 1 ELSE 0 END"),
    "cveinfo_normalize": "WITH k AS (SELECT 'CVE-' || doc_id % 97 AS cve, arg_max(source, doc_id) AS summary, arg_max([lang, source], doc_id) AS l FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1) SELECT cve, summary, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS cwe FROM k",
    "source_diff_normalize": "SELECT 'CVE-' || doc_id AS cve, source AS commit FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 5 > 0",
    "change_types": """SELECT doc_id AS cve, 'f' || doc_id % 3 AS function, CASE WHEN doc_id % 4 > 0 AND source <> '' THEN source ELSE 'unknown' END AS change_type FROM documents UNION ALL SELECT doc_id, 'f' || (doc_id + 1) % 3, 'unknown' FROM documents""",
    "function_lists": """WITH n AS (SELECT doc_id, doc_id % 3 AS a, (doc_id + 1) % 3 AS b, doc_id % 2 AS c FROM documents)
      SELECT doc_id AS cve, 'f' || a || ',f' || b AS functions, 'f' || a || ',f' || b || CASE WHEN c IN (a, b) THEN '' ELSE ',f' || c END || ',g' AS names, CASE WHEN a = 0 THEN 'own' WHEN c = 0 THEN 'cve' ELSE '' END AS commit FROM n""",
    "info_join": "SELECT d.doc_id AS cve, coalesce(CAST(quality AS VARCHAR), '') AS summary, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS cwes, l.doc_id IS NULL AS no_info FROM documents d LEFT JOIN labels l USING (doc_id)",
    "cve_payloads": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'kept' WHEN 2 THEN 'CVE-' || event_id END AS cve_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "compact_functions": "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'source' END, CASE WHEN doc_id % 2 = 0 THEN lang END, '') AS code FROM documents",
    "env_declarations": f"""WITH {_ENV}, o AS (SELECT user_id, name, arg_min(value, event_id) AS value FROM h GROUP BY ALL), q AS (SELECT name, arg_min(value, event_id) AS value FROM h GROUP BY name)
      SELECT user_id, name, value FROM o UNION ALL SELECT -7, name, value FROM q WHERE name <> 'N3' UNION ALL SELECT -7, 'N3', 'set'""",
    "select_all_sorted": """SELECT 'all' AS how, source AS cve FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 'first', source FROM (SELECT source FROM documents ORDER BY doc_id LIMIT 7) UNION ALL SELECT 'whole', CAST(count(*) AS VARCHAR) FROM documents""",
    "path_derivation": """WITH r AS (SELECT doc_id AS id, doc_id % 6 AS k, 'p' || doc_id AS p FROM documents)
      SELECT id, CASE k WHEN 0 THEN NULL WHEN 1 THEN '/own.json' WHEN 2 THEN '/base/' || p || '.json' ELSE '/base/' || p || '/' || p || '.json' END AS project_json,
      CASE WHEN k = 0 THEN '/t.json' WHEN EXISTS (SELECT 1 FROM r WHERE k = 5) THEN '/base/testset.json' ELSE '/base/' || p || '/testset.json' END AS testset_json,
      CASE k WHEN 0 THEN NULL WHEN 3 THEN '/base/' || p || '/targets' WHEN 4 THEN '/base/' || p ELSE '/bin/' || p || '_gcc' END AS target_dir,
      CASE WHEN k = 0 THEN '/o.json' ELSE '/base/runs/' || p || '_O0_codex_results.json' END AS output,
      CASE WHEN k = 0 THEN 'missing required arguments: --project-json, --target-dir; or provide --project' END AS problem FROM r""",
    "first_candidates": "SELECT source AS project, '/r/' || coalesce(min(doc_id) FILTER (doc_id % 9 = 4), min(doc_id)) AS path FROM documents GROUP BY source",
    "exposed_answers": """WITH r AS (SELECT '/' || ['en', 'de', 'es', 'e'][item_id % 4 + 1] || '/src' || item_id || CASE WHEN item_id % 3 = 0 THEN '/' ELSE '' END AS root FROM benchmark UNION ALL SELECT '/fr' UNION ALL SELECT '/e' UNION ALL SELECT '/it//'),
      p AS (SELECT '/' || lang || '/' || source || '/t' || doc_id AS path FROM documents) SELECT path, root FROM p JOIN r ON starts_with(path, rtrim(root, '/') || '/')""",
    "resolve_binaries": "SELECT 'b' || doc_id AS \"binary\", 'b' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-deployed' ELSE '-' || lang || '-O0' END AS actual FROM documents",
    "mapping_record": "SELECT source AS cve, 'target_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS anonymous, 'b' || doc_id AS original, 'b' || doc_id || '-deployed' AS actual, '/h' AS helper FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
    "pipeline_steps": "SELECT doc_id AS name, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 - 1 AS INTEGER) END AS returncode, n_chars / 8 AS seconds, CASE doc_id % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'ok' ELSE 'failed' END AS status FROM documents",
    "path_predicates": """WITH p AS (SELECT doc_id, lang || '/' || source AS b, doc_id % 10 AS k FROM documents) SELECT doc_id, k IN (0, 1, 2, 7, 9) AS code,
      replace(b, '/', '_') || ['.c', '..c', '_x.H', '.tar.gz', '_.c', '_Makefile', '.c_readme', '_é.cpp', '.C.', '_a.hxx'][k + 1] AS safe, replace(b, '/', '_') || ['.c', '..c', '_x.H', '.tar.gz', '_.c', '_Makefile', '.c_readme', '_.cpp', '.C.', '_a.hxx'][k + 1] AS run_id FROM p""",
    "path_functions": """WITH p AS (SELECT doc_id, source, lang, doc_id % 3 > 0 AS deep FROM documents) SELECT doc_id, source = 'src1' AS inside, CASE WHEN NOT deep THEN 'w' WHEN source = 'src2' THEN lang || '.v1' ELSE source END AS project,
      CASE WHEN source = 'src11' THEN 'src11' WHEN source = 'src1' THEN 'src1' END AS of_diff, CASE WHEN length('/w/' || source) <= 8 AND NOT deep THEN '/w/' || source ELSE left('/w/' || source || CASE WHEN deep THEN '/' || lang || '.v1.json' ELSE '' END, 8) || chr(10) || '...' END AS capped FROM p""",
    "parse_integers": """SELECT event_id, CASE event_id % 12 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN -event_id WHEN 3 THEN event_id WHEN 4 THEN event_id WHEN 5 THEN event_id * 10 + 7 WHEN 9 THEN 0 END AS v FROM events""",
    "line_fetch": "SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE strlen(coalesce(string_split(text, chr(10))[doc_id % 4], '')) END AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL",
    "shell_words": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '''' || source || ' ' || lang || '''' WHEN 2 THEN '''it''"''"''s ' || lang || '''' ELSE '''''' END AS word FROM documents""",
    "deanonymize_text": "SELECT conv_id, turn, 'see x' || turn || '/y' || conv_id || ' in y' || conv_id || '1, ' || role || ' x' || turn AS said FROM conversations",
    "final_texts": "SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN ' ' || source || chr(10) WHEN 3 THEN lang ELSE 'out ' || doc_id END AS said FROM documents",
    "verdict_validate": """WITH f AS (SELECT doc_id, doc_id % 6 AS k, lang AS b, 0 AS second FROM documents UNION ALL SELECT doc_id, doc_id % 6, source, 1 FROM documents),
      g AS (SELECT *, (second = 0 AND k IN (0, 2, 4)) OR (second = 1 AND k = 1) AS has FROM f)
      SELECT 'C' || doc_id AS cve, b AS "binary", CASE WHEN NOT has THEN 'error' ELSE ['present', 'not_found', 'inconclusive', '', 'error'][k + 1] END AS status, CASE WHEN has AND k = 0 THEN 'high' WHEN has AND k = 2 THEN 'odd' ELSE 'low' END AS confidence,
      CASE WHEN NOT has THEN 'codex output did not contain this requested binary' ELSE ['one', '7', 'x|1|True|None', '', ''][k + 1] END AS evidence, CASE WHEN NOT has THEN 'Missing per-binary result in final JSON.' WHEN k = 0 THEN 'r' ELSE '' END AS reasoning FROM g""",
    "deanonymize_verdicts": """SELECT source || '-' || doc_id // 200 AS cve, 'lib' || doc_id AS "binary", CASE WHEN doc_id % 3 > 0 THEN 'present' ELSE 'error' END AS status, CASE WHEN doc_id % 3 > 0 THEN 'high' ELSE 'low' END AS confidence,
      CASE WHEN doc_id % 3 > 0 THEN 'in lib' || doc_id || '|none' ELSE 'codex output did not contain this requested binary after de-anonymization' END AS evidence, CASE WHEN doc_id % 3 > 0 THEN 'lib' || doc_id || ' has it' ELSE 'Missing per-binary result in anonymous final JSON.' END AS reasoning FROM documents""",
    "any_status": "SELECT source AS cve, bool_or(coalesce(toxic = 1 AND quality = 0, false)) AS has FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "analysis_validate": """SELECT doc_id AS cve, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 2 THEN 'no JSON object in the answer' WHEN 5 THEN 'no JSON object in the answer' WHEN 3 THEN 'patch_intent_analysis.behavior_changes must be a string list' ELSE 'missing root_cause_analysis or patch_intent_analysis' END AS analysis_error,
      CASE WHEN doc_id % 6 = 0 THEN source END AS cause, CASE WHEN doc_id % 6 = 0 THEN '7' END AS mechanism, CASE WHEN doc_id % 6 = 0 THEN 'b|' || lang END AS behaviors FROM documents""",
    "behaviour_resume": """SELECT doc_id AS cve, source, CASE WHEN doc_id % 6 = 0 THEN source END AS cause, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 2 THEN 'no JSON object in the answer' WHEN 5 THEN 'no JSON object in the answer' WHEN 3 THEN 'patch_intent_analysis.behavior_changes must be a string list' ELSE 'missing root_cause_analysis or patch_intent_analysis' END AS behavior_analysis_error
      FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""",
    "results_document": """SELECT source || '"\\é' AS cve, CAST(doc_id AS VARCHAR) AS "binary", 'present' AS status, 'low' AS confidence, lang AS evidence, lang || ' "' || chr(10) AS reasoning FROM documents""",
    "results_by_cve": """SELECT source || '"/é' AS cve, CAST(doc_id AS VARCHAR) AS "binary", CASE WHEN starts_with(source, 'src1') THEN 'absent' ELSE 'present' END AS status, lang AS evidence, lang || ' "' || chr(10) AS reasoning FROM documents WHERE source IS NOT NULL""",
    "document_layout": """SELECT doc_id, replace('{|  "a": ' || doc_id || ',|  "z": {|    "a": [|      true,|      "' || lang || '"|    ],|    "b": 1|  },|  "é": null|}|', '|', chr(10)) AS text FROM documents""",
    "text_files": "SELECT lang || ' ' || source AS line, count(*) AS n FROM documents GROUP BY 1",
    "answer_schema": "WITH s AS (SELECT ['present', 'absent', 'not_affected', 'inconclusive', 'not_found', 'error'][doc_id % 6 + 1] AS status FROM documents) SELECT status, count(*) AS n, status <> 'error' AS offered FROM s GROUP BY status",
    "trace_commands": f"WITH {_TRACE} SELECT run_id, id, CASE WHEN started_at < completed_at THEN command ELSE command END AS command, started_at, completed_at, elapsed, CAST(exit_code AS BIGINT) AS exit_code, CAST(output_bytes AS BIGINT) AS output_bytes, rank FROM ran",
    "trace_turns": f"WITH {_TRACE} SELECT run_id, started_at, completed_at, elapsed, seq AS input_tokens, CAST(2 AS BIGINT) AS cached_input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM turned",
    "timing_report": f"""WITH {_TRACE}, t AS (SELECT run_id, string_agg('| ' || n || ' | ' || printf('%.3f', elapsed) || ' | ' || seq || ' | 2 |  |  |', chr(10) ORDER BY n) AS l FROM turned GROUP BY 1),
      c AS (SELECT run_id, string_agg('| ' || rank || ' | ' || printf('%.3f', elapsed) || ' | ' || coalesce(CAST(exit_code AS VARCHAR), '') || ' | ' || output_bytes || ' | `' || replace(command, '|', '\\|') || '` |', chr(10) ORDER BY rank) AS l FROM ran GROUP BY 1)
      SELECT run_id, '# Codex Exec Timing: CVE-' || run_id || chr(10) || chr(10) || 'Total wall time: ' || printf('%.3f', r.elapsed) || 's' || chr(10) || 'Return code: ' || coalesce(CAST(returncode AS VARCHAR), 'None') || chr(10) || chr(10) || '## Turns' || chr(10) || chr(10) || '{_HEADS[0]}' || chr(10)
      || coalesce(t.l, '|  |  |  |  |  |  |') || chr(10) || chr(10) || '## Command Executions' || chr(10) || chr(10) || '{_HEADS[1]}' || chr(10) || coalesce(c.l || chr(10), '') AS markdown FROM runs r LEFT JOIN t USING (run_id) LEFT JOIN c USING (run_id)""",
    "timing_documents": f"""WITH {_TRACE} SELECT r.run_id, 'CVE-' || r.run_id AS cve, r.started_at AS started, r.run_id AS second, (SELECT count(*) FROM turned t WHERE t.run_id = r.run_id) AS turns, (SELECT count(*) FROM ran c WHERE c.run_id = r.run_id) AS commands,
      (SELECT elapsed FROM ran c WHERE c.run_id = r.run_id AND rank = 1) AS longest, (SELECT command FROM ran c WHERE c.run_id = r.run_id AND rank = 1) AS command, (SELECT seq FROM turned t WHERE t.run_id = r.run_id AND n = 1) AS first_tokens, returncode IS NULL AS no_code FROM runs r""",
    "comparable_tokens": """WITH r AS (SELECT user_id, sum(event_id) - sum(event_id % 50) + count(*) + count(*) FILTER (event_type = 'view') AS t FROM events GROUP BY 1), b AS (SELECT arg_min(t, user_id) AS b FROM r)
      SELECT 'run' || user_id AS config, CAST(t AS BIGINT) AS comparable, round((t - b)::DOUBLE * 100 / b, 6) AS change_percent FROM r, b""",
    "stream_pairing": """WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, lag(event_id) OVER w AS t FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
      SELECT user_id, CAST(CASE WHEN p = 'view' THEN t ELSE event_id END AS DOUBLE) AS started_at, CAST(event_id AS DOUBLE) AS completed_at, coalesce(p = 'view', false) AS paired FROM x WHERE event_type = 'purchase'""",
    "symbol_table_lines": "SELECT event_id AS addr, ['T', 't', 'W', 'U', 'D', 'w'][event_id % 6 + 1] AS kind, event_type || '(int, char)' AS name, event_id AS seq FROM events WHERE event_id % 6 NOT IN (3, 4) AND event_id % 7 > 0",
    "debug_sections": "SELECT user_id, bool_or(event_id % 97 = 5) AS has_debug_line FROM events GROUP BY user_id",
    "address_lines": "SELECT user_id, event_id AS addr FROM events WHERE event_id >= user_id * 50 - 500 AND event_id < user_id * 50 + 500",
    "symbol_lookup": f"""WITH {_SYMBOLS}, q AS (SELECT "binary", ['error', 'view', 'gone'][count(*) % 3 + 1] AS symbol FROM s GROUP BY 1), f AS (SELECT q."binary", q.symbol, min_by(addr, r) AS a, min_by(next, r) AS n FROM q JOIN s ON s."binary" = q."binary" AND s.name = q.symbol GROUP BY ALL)
      SELECT q."binary", a AS start, greatest(a + 1, least(coalesce(n, a + 16), a + 16)) AS stop, CASE WHEN a IS NULL THEN 'symbol not found: ' || q.symbol || '; first symbols: ' || (SELECT string_agg(name, ', ' ORDER BY r) FROM s WHERE s."binary" = q."binary" AND r <= 20) END AS error FROM q LEFT JOIN f USING ("binary")""",
    "bounded_view": _VIEW,
    "diff_files": """SELECT doc_id, source || '.c' AS path, CAST(2 AS BIGINT) AS ord FROM documents UNION ALL SELECT doc_id, lang, CAST(5 AS BIGINT) FROM documents""",
    "diff_file_match": """WITH c AS (SELECT doc_id, 'CVE-2014-' || doc_id AS cve, CASE WHEN doc_id % 3 > 0 THEN upper(md5(CAST(doc_id AS VARCHAR))) ELSE '' END AS commit FROM documents),
      n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'other_' ELSE 'curl_' END || 'CVE-2014-' || doc_id || '_' AS h, md5(CAST(doc_id AS VARCHAR)) AS s FROM documents), f AS (SELECT h || left(s, 7) || '.diff' AS name FROM n UNION ALL SELECT h || '0' || left(s, 10) || '.diff' FROM n WHERE doc_id % 2 = 1),
      j AS (SELECT c.cve, 'd/' || name AS path, CASE WHEN starts_with(name, 'curl_' || cve || '_') THEN 0 ELSE 1 END AS tier, CASE WHEN commit = '' THEN 9 WHEN contains(lower(name), lower(left(commit, 12))) THEN 0 WHEN contains(lower(name), lower(left(commit, 10))) THEN 1 WHEN contains(lower(name), lower(left(commit, 8))) THEN 2 WHEN contains(lower(name), lower(left(commit, 7))) THEN 3 ELSE 9 END AS rank FROM c LEFT JOIN f ON contains(name, cve))
      SELECT cve, path FROM (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY tier, rank, path) AS r FROM j) WHERE r = 1""",
    "diff_candidates": """WITH f AS (SELECT source, doc_id, 'x/' || CASE WHEN doc_id % 7 = 5 THEN 'abc-' ELSE '' END || doc_id AS file, CASE WHEN doc_id % 7 = 5 AND source <> 'src3' THEN 10 ELSE 0 END + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS score FROM documents WHERE doc_id % 11 > 0)
      SELECT source AS cve, file FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM f) WHERE r = 1""",
    "hunk_overlap": """WITH h AS (SELECT l_orderkey AS cve, l_linenumber AS n, l_linenumber * 10 AS s, CAST(floor(l_quantity) AS INTEGER) % 12 AS q, l_partkey % 3 > 0 AS counted FROM lineitem), i AS (SELECT *, s + greatest(CASE WHEN counted THEN q ELSE 1 END, 1) - 1 AS e FROM h), f AS (SELECT o_orderkey AS cve, o_custkey % 70 AS a, o_custkey % 70 + 8 AS b FROM orders)
      SELECT i.cve, 'f' AS function, '@@ -1,9 +' || s || CASE WHEN counted THEN ',' || q ELSE '' END || ' @@ a - +b' AS header, CAST(n AS BIGINT) AS n FROM i JOIN f ON f.cve = i.cve WHERE (e >= a AND s <= b) OR NOT EXISTS (SELECT 1 FROM i x WHERE x.cve = f.cve AND x.e >= a AND x.s <= b)""",
    "decl_closure": "WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey % 60 AS fn, 'v' || l_partkey % 400 AS var, 'v' || l_suppkey * 7 % 400 AS dep FROM lineitem), r AS (SELECT DISTINCT fn, 'v' || fn AS var FROM d UNION SELECT d.fn, d.dep FROM r JOIN d ON d.fn = r.fn AND d.var = r.var) SELECT fn, var FROM r",
    "macro_resolve": """WITH m AS (SELECT doc_id, doc_id % 6 + 1 AS k, doc_id % 9 AS x FROM documents), a AS (SELECT doc_id, unnest(range(k + 1)) AS i, k, x FROM m)
      SELECT CAST(doc_id AS VARCHAR) AS file, 'A' || i AS name, CAST(16 + (k - i) * x AS VARCHAR) AS value, false AS capped FROM a UNION ALL SELECT CAST(doc_id AS VARCHAR), n, v, n = 'L' FROM documents, (VALUES ('B', '( A0+1 )'), ('T', 'T'), ('U', 'U'), ('H', '1'), ('F(a,', 'b ) x'), ('S', '7 / 2'), ('L', '1 << 5000'), ('M', '8')) AS t(n, v)""",
    "identifier_classify": """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 6 AS p FROM lineitem), k AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = n.l_orderkey AND l.l_linenumber = n.l_linenumber AND l.l_partkey % 6 = p AND l_suppkey % 3 = 0) THEN 'api' WHEN p = 2 THEN 'macro'
      WHEN p IN (3, 4) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = n.l_orderkey AND l.l_partkey % 6 = p AND l_suppkey % 2 = 0) THEN 'local_or_param' ELSE 'global_or_external' END AS kind FROM n)
      SELECT CAST(l_orderkey AS VARCHAR) AS fn, CAST(l_linenumber AS BIGINT) AS line, 'n' || p AS name, kind, kind <> 'api' AS variable FROM k""",
    "source_sink_edges": """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS fn, 'v' || l_partkey % 5 AS var, l_linenumber AS line, l_suppkey % 6 AS op, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 5 IN (1, 3)), u AS (SELECT *, unnest(['v' || l_suppkey % 5, 'K' || l_partkey % 3]) AS name FROM e WHERE op IN (0, 5) AND l_partkey % 4 > 0)
      SELECT fn, CASE WHEN name IN ('v0', 'v1') THEN 'param' WHEN name = 'K1' THEN 'macro' WHEN name = 'v2' THEN 'local' ELSE 'global_or_external' END || ':' || name AS source, var AS "to", CAST(line AS BIGINT) AS line, 'rhs_dep' AS kind FROM u UNION ALL SELECT fn, 'param:' || var, var, CAST(line AS BIGINT), 'param_def' FROM e WHERE op = 1""",
    "sink_variables": """WITH e AS (SELECT l_orderkey AS o, l_partkey % 5 AS v, l_linenumber AS line FROM lineitem), t AS (SELECT o, v, CASE WHEN o_custkey % 3 = 0 AND v = o_custkey % 5 THEN 0 WHEN o_custkey % 3 = 1 AND line = o_custkey % 7 + 1 THEN 1 WHEN v = o_custkey % 5 THEN 2 END AS tier FROM e JOIN orders ON o_orderkey = o)
      SELECT DISTINCT CAST(o AS VARCHAR) AS fn, 'v' || v AS var FROM t WHERE tier = (SELECT min(tier) FROM t x WHERE x.o = t.o)""",
    "defuse_group": """WITH e AS (SELECT l_orderkey AS o, 'v' || l_partkey % 5 AS var, l_linenumber AS line, ['def', 'param_def', 'def_decl', 'use_call', 'use', 'def'][l_suppkey % 6 + 1] AS op FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS o, unnest(['v0', 'v1', 'none']) AS var FROM lineitem)
      SELECT CAST(t.o AS VARCHAR) AS fn, t.var, coalesce(string_agg(line, ',' ORDER BY line, op) FILTER (op IN ('def', 'param_def', 'def_decl')), '') AS defs, coalesce(string_agg(line, ',' ORDER BY line, op) FILTER (op LIKE 'use%'), '') AS uses, coalesce(string_agg(line, ',' ORDER BY line, op), '') AS all_events FROM t LEFT JOIN e ON e.o = t.o AND e.var = t.var GROUP BY t.o, t.var""",
    "provider_settings": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '-c|model_provider="' || source || '"|-c|model_providers.' || source || '={name="' || source || '", base_url="http://' || lang || '/v1", env_key="K' || doc_id || '", wire_api="chat", requires_openai_auth=' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' END AS settings,
      CASE WHEN doc_id % 3 > 0 THEN 'a,' || lang || ',a,localhost' ELSE 'localhost,' || lang END AS no_proxy FROM documents""",
    "model_profiles": """WITH p AS (SELECT doc_id, doc_id % 11 AS k, lang, source || '.' || doc_id AS name FROM documents) SELECT name, CASE WHEN k <> 1 THEN 'u' END AS base_url, CASE WHEN k NOT IN (1, 3, 5) THEN CASE WHEN k = 4 THEN 'K' ELSE lang END END AS api_key_env,
      CASE WHEN k = 1 THEN '' WHEN k = 10 THEN '' WHEN doc_id % 2 = 0 THEN lang ELSE 'profile-' || replace(name, '.', '-') END AS provider_name,
      CASE k WHEN 0 THEN 'provider is missing' WHEN 2 THEN 'base_url, wire_api and model are needed' WHEN 3 THEN 'api_key_env is missing' WHEN 4 THEN 'api_key_env is no list of names' WHEN 6 THEN 'reasoning needs an effort' WHEN 7 THEN 'reasoning mode is unknown' WHEN 9 THEN 'reasoning effort is unknown' WHEN 10 THEN 'provider_name is empty' END AS problem,
      CASE WHEN length(name) % 2 = 0 THEN 'low' WHEN k = 8 THEN 'high' END AS effort FROM p""",
    "alias_resolution": """WITH n AS (SELECT DISTINCT 'p' || source AS name FROM documents), h AS (SELECT string_agg(name, ', ' ORDER BY name) AS have FROM n), r AS (SELECT doc_id AS id, doc_id % 5 AS k, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'p' || source ELSE 'px' END ELSE 'psrc2' END AS own FROM documents),
      a AS (SELECT id, k, CASE k WHEN 0 THEN 'psrc1' WHEN 1 THEN NULL WHEN 2 THEN 'gone' ELSE own END AS name FROM r)
      SELECT id, name, CASE WHEN k = 1 THEN 'unknown provider alias; available: fast, old, older' WHEN name NOT IN (SELECT name FROM n) THEN 'unknown profile; available: ' || have END AS problem FROM a, h""",
    "dangling_aliases": "SELECT DISTINCT 'p' || length(source) AS name, 'p4' AS active FROM documents WHERE length(source) <> 4",
    "profile_documents": """WITH s AS (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS INTEGER) AS n FROM documents), c AS (SELECT *, n % 5 = 0 AS current FROM s)
      SELECT name, CASE WHEN NOT current THEN 'u' END AS base_url, CASE WHEN NOT current AND n % 3 < 2 THEN CASE n % 3 WHEN 0 THEN 'K' || n ELSE 'L' END END AS api_key_env, NOT current AND n % 2 = 0 AS requires_auth,
      CASE WHEN n % 4 = 0 THEN 'on' ELSE 'inherit' END AS mode, CASE WHEN n % 4 = 0 THEN 'high' END AS effort, CASE WHEN current THEN '' WHEN n % 7 = 0 THEN 'own' ELSE 'profile-' || name END AS provider_name,
      CASE WHEN NOT current AND n % 2 = 1 AND n % 3 = 2 THEN 'api_key_env is missing' END AS problem FROM c""",
    "build_statistics": """WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has FROM documents WHERE lang <> 'fr') SELECT (SELECT count(*) FROM documents) AS input_source_diff_cves, count(*) AS selected_cves, count(*) AS emitted_cves, count(*) FILTER (doc_id % 3 > 0) AS diff_files_found, count(*) FILTER (doc_id % 3 = 0) AS diff_files_missing,
      count(*) FILTER (has) AS cveinfo_found, count(*) FILTER (NOT has) AS cveinfo_missing, count(*) AS total_functions, count(*) FILTER (doc_id % 5 > 0) AS functions_with_file, count(*) FILTER (doc_id % 5 = 0) AS functions_without_file FROM d""",
    "build_histograms": """SELECT 'change_type' AS kind, CASE WHEN doc_id % 4 > 0 THEN lang ELSE 'unknown' END AS value, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY ALL UNION ALL SELECT 'inferred_by', CASE WHEN doc_id % 5 > 0 THEN 'm' || doc_id % 3 ELSE 'unknown' END, count(*) FROM documents WHERE lang <> 'fr' GROUP BY ALL""",
    "analysis_rollup": """WITH s AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 > 0 THEN 'ok' ELSE 'unknown' END AS status FROM documents)
      SELECT status, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM s UNION ALL SELECT 'cves', count(DISTINCT source) FROM s UNION ALL SELECT 'functions', count(*) FROM s UNION ALL SELECT 'compact', (SELECT count(*) FROM labels)""",
    "statistics_documents": "SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE event_id % 4 = 3",
    "pipeline_report": """WITH p AS (SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS a FROM documents GROUP BY 1)
      SELECT lang AS project, replace('# ' || lang || ' metadata pipeline run~~## 产物~- `initial`: `/o/initial` (' || CASE WHEN lang = 'en' THEN '存在' ELSE '未生成' END || ')~- `report`: `/o/report` (存在)~~## 输入~- project: `' || lang || '`~- output_dir: `/o/' || lang || '`~- repo_path: `' || CASE WHEN lang <> 'fr' THEN '/r/' || lang ELSE '' END
      || '`~~## 步骤~### build~- status: `ok`~- returncode: `0`~- seconds: `1.24`~- log: `/l`~~```bash~run ''a b''~```~~### analyse~- status: `skipped`~- note: no repository~~## 初始 JSON 统计~- input_source_diff_cves: `0`~- selected_cves: `' || n || '`~- emitted_cves: `0`~- total_functions: `0`~- diff_files_found: `0`~- diff_files_missing: `0`~- cveinfo_found: `0`~- cveinfo_missing: `0`~- functions_with_file: `0`~- functions_without_file: `0`~- change_type.added: `'
      || a || '`~- change_type.modified: `' || (n - a) || '`~~' || CASE WHEN lang <> 'de' THEN '## DeepSeek 行为分析统计~- cve_count: `' || n || '`~- analyzed: `0`~- errors: `0`~~' ELSE '' END || '## 说明~- one~- two~', '~', chr(10)) AS report FROM p""",
    "prompt_payload": """SELECT 'C-' || doc_id AS cve, replace('{|  "cve": "C-' || doc_id || '",|  "metadata": {|    "a": {|      "b": [|        1,|        "' || lang || 'é"|      ]|    }|  },|  "requested_binaries": [|    "' || source || '"|  ],|  "binary_resolution": {|    "' || source || '": "' || source || '-gcc-O0"|  },|  "target_dir": "/t",|  "compiler": "gcc",|  "optimization": "O0"|}', '|', chr(10)) AS payload FROM documents""",
    "analysis_status": f"""WITH {_PROJECT} SELECT fn, CASE WHEN k IN (5, 6, 8, 9) THEN 'failed' ELSE 'ok' END AS status,
      CASE k WHEN 5 THEN 'repo_path is required for AST source analysis' WHEN 6 THEN 'diff file is missing' WHEN 8 THEN 'unable to locate function AST node' WHEN 9 THEN 'unable to locate function AST node' ELSE '' END AS errors,
      CASE k WHEN 3 THEN 'no changed lines inside AST function range; fell back to whole-file diff lines' WHEN 4 THEN 'function file missing in input; inferred from diff' WHEN 7 THEN 'pre-patch source unavailable; reused post-patch source' WHEN 8 THEN 'function not found in post-patch source: gone' WHEN 9 THEN 'post-patch source unavailable' ELSE '' END AS warnings FROM d""",
    "analysis_entities": f"""WITH {_PROJECT} SELECT fn, CAST(4 + c AS BIGINT) AS line, 'v' || c AS name, 'local_or_param' AS kind, NULL AS resolved_value FROM near UNION ALL SELECT fn, 4 + c, 'v' || (c - 1), 'local_or_param', NULL FROM near UNION ALL SELECT fn, 4 + c, 'K' || c, 'macro', CAST(2 + doc_id % 7 AS VARCHAR) FROM near""",
    "def_use_events": _USES,
    "analysis_edges": f"WITH {_EDGES} SELECT fn, source, \"to\", CAST(line AS BIGINT) AS line, kind FROM g",
    "analysis_flow": _FLOW,
    "analysis_hunks": f"""WITH {_PROJECT} SELECT fn, '@@ -' || (4 + c) || ',1 +' || (4 + c) || ',1 @@ int f' AS header, '  v' || c || ' = v' || (c - 1) || ';' AS old_lines, '  v' || c || ' = v' || (c - 1) || ' + K' || c || ';' AS new_lines FROM near UNION ALL SELECT fn, '@@ -900,1 +900,1 @@', 'x;', 'y;' FROM ok WHERE k = 3""",
    "reduced_code": f"""WITH {_PROJECT}, s AS (SELECT fn, string_agg('v' || i || ' = v' || (i - 1) || ' + K' || i || ';~', '' ORDER BY i) FILTER (k <> 3 AND i BETWEEN c - 1 AND c + 1) AS t, string_agg('v' || i, ', ' ORDER BY i) AS vars FROM a GROUP BY fn)
      SELECT fn, replace('int f' || doc_id || '(int v0, char *p)~{{~' || CASE WHEN k = 3 THEN '' ELSE 'int ' || vars || ';~~' || CASE WHEN c = 1 THEN 'int v0~' ELSE '' END || t || CASE WHEN c = n THEN 'if (v' || n || ' > LIMIT)~    send(p, v' || n || ');~return v' || n || ';~' ELSE '' END END || '}}', '~', chr(10)) AS code FROM ok JOIN s USING (fn)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
