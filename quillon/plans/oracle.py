"""DuckDB SQL that gives the same rows as the catalogue's queries, written in other ways where it can be."""

from __future__ import annotations

from quillon.plans import domain_oracle, streams

_SIMULATED = """
WITH v AS (SELECT source AS cve, CAST(doc_id AS VARCHAR) AS "binary",
  CASE doc_id % 13 WHEN 0 THEN 'inconclusive' WHEN 1 THEN 'error' WHEN 2 THEN 'not_found' WHEN 3 THEN 'not_affected' WHEN 4 THEN 'not_affected' WHEN 5 THEN 'unrecognised'
  ELSE CASE WHEN n_chars % 2 = 0 THEN 'present' ELSE 'absent' END END AS predicted,
  (SELECT CASE WHEN quality = 0 THEN 'absent' WHEN toxic = 1 THEN 'not_affected' ELSE 'present' END FROM labels l WHERE l.doc_id = d.doc_id) AS expected
  FROM documents d),
o AS (SELECT cve, "binary", expected, predicted, CASE
  WHEN cve = 'src19' THEN 'missing_groundtruth_cve' WHEN expected IS NULL THEN 'version_not_in_groundtruth' WHEN predicted = 'not_found' THEN 'not_found'
  WHEN predicted = 'not_affected' THEN CASE WHEN expected = 'not_affected' THEN 'na_tp' ELSE 'na_fp' END
  WHEN predicted IN ('inconclusive', 'error') THEN predicted || CASE WHEN expected = 'not_affected' THEN '_na' ELSE '' END
  WHEN expected = 'not_affected' THEN 'na_fn' WHEN predicted NOT IN ('present', 'absent') THEN 'error'
  WHEN expected = predicted THEN CASE WHEN expected = 'present' THEN 'TP' ELSE 'TN' END
  WHEN predicted = 'present' THEN 'FP' ELSE 'FN' END AS outcome FROM v)"""


def _metrics(by: str) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    n = lambda *names: f"count(*) FILTER (outcome IN ({', '.join(repr(x) for x in names)}))"
    return f"""{_SIMULATED},
c AS (SELECT {key}{n("TP")} AS TP, {n("TN")} AS TN, {n("FP")} AS FP, {n("FN")} AS FN, {n("na_tp")} AS "not_affected_TP", {n("na_fp")} AS "not_affected_FP",
  {n("na_fn", "inconclusive_na", "error_na")} AS "not_affected_FN", {n("inconclusive", "inconclusive_na")} AS inconclusive, {n("error", "error_na")} AS error, {n("not_found")} AS not_found,
  {n("na_tp", "na_fp")} AS not_affected, {n("version_not_in_groundtruth")} AS version_not_in_groundtruth, {n("missing_groundtruth_cve")} AS missing_groundtruth_cve,
  {n("FP", "FN", "na_fp", "na_fn")} AS mismatches FROM o {group}),
d AS (SELECT *, TP + TN + FP + FN AS accuracy_denominator, TP + TN + FP + FN + inconclusive + error AS TC, "not_affected_TP" + "not_affected_FN" AS not_affected_total FROM c),
e AS (SELECT *, TC + not_affected_total AS "not_affected_included_TC", TP + TN + "not_affected_TP" AS not_affected_included_correct,
  CASE WHEN TP + FP = 0 THEN 0.0::DOUBLE ELSE TP::DOUBLE / (TP + FP) END AS p, CASE WHEN TP + FN = 0 THEN 0.0::DOUBLE ELSE TP::DOUBLE / (TP + FN) END AS r FROM d)
SELECT * EXCLUDE (p, r), round(CASE WHEN accuracy_denominator = 0 THEN 0 ELSE (TP + TN)::DOUBLE / accuracy_denominator END, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN TC = 0 THEN 0 ELSE (TP + TN)::DOUBLE / TC END, 6) AS "DSR",
  round(CASE WHEN "not_affected_included_TC" = 0 THEN 0 ELSE not_affected_included_correct::DOUBLE / "not_affected_included_TC" END, 6) AS "not_affected_included_DSR",
  round(CASE WHEN not_affected_total = 0 THEN 0 ELSE "not_affected_TP"::DOUBLE / not_affected_total END, 6) AS not_affected_accuracy FROM e"""


_LINES = """l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM
  (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) OR text = '' THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END AS parts FROM documents WHERE text IS NOT NULL))"""

_GREP = f"""WITH {_LINES},
h AS (SELECT *, regexp_matches(line, '[Ee]rs') AS hit FROM l),
n AS (SELECT a.doc_id, a.line_no, a.line, a.hit, (SELECT max(b.line_no) FROM h b WHERE b.doc_id = a.doc_id AND b.hit AND b.line_no <= a.line_no AND b.line_no >= a.line_no - 1) AS last,
  (SELECT min(b.line_no) FROM h b WHERE b.doc_id = a.doc_id AND b.hit AND b.line_no >= a.line_no AND b.line_no <= a.line_no + 1) AS next FROM h a),
k AS (SELECT *, CASE WHEN hit THEN line_no ELSE coalesce(last, next) END AS g FROM n WHERE last IS NOT NULL OR next IS NOT NULL),
s AS (SELECT *, lag(g) OVER w IS DISTINCT FROM g AND lag(g) OVER w IS NOT NULL AND NOT coalesce(right(lag(line) OVER w, 2) = '--', false) AS separator FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""

#: Lines of the synthetic diffs straight from the texts.
_DIFFS = """x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: t <> '') AS parts FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, parts, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS i FROM x),
z AS (SELECT doc_id, t, i, i % 3 AS m, 10 + i - (i + 0) // 3 AS old_ln, 20 + i - (i + 1) // 3 AS new_ln,
  (i % 3 = 1 AND left(t, 2) = '--') OR (i % 3 = 2 AND left(t, 2) = '++') AS lost FROM y)"""


# context lines move both counters, removed ones the old, added ones the new
_NUMBERED = f"""{_DIFFS},
q AS (SELECT doc_id, t, m, i, lost,
  CAST(10 + coalesce(sum(CASE WHEN m IN (0, 1) AND NOT lost THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS old_ln,
  CAST(20 + coalesce(sum(CASE WHEN m IN (0, 2) AND NOT lost THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS new_ln
  FROM z WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_SCORES = f"""WITH {_DIFFS}, f AS (SELECT unnest(['the', 'of', 'de']) AS function),
s AS (SELECT doc_id, function, max(CASE
  WHEN m IN (1, 2) AND regexp_matches(t, '^[ \\t]*[A-Za-z_][A-Za-z0-9_*\\s]*\\s' || function || '\\s*\\(') THEN 100
  WHEN regexp_matches('static int ' || string_split(parts1, ' ')[1] || '(void)', '(^|[^A-Za-z0-9_])' || function || '([^A-Za-z0-9_]|$)') THEN 50
  WHEN regexp_matches(t, '(^|[^A-Za-z0-9_])' || function || '\\s*\\(') THEN 35
  WHEN regexp_matches(t, '(^|[^A-Za-z0-9_])' || function || '([^A-Za-z0-9_]|$)') THEN 10 ELSE 0 END) AS score
  FROM (SELECT y.doc_id, y.t, y.i % 3 AS m, y.parts[1] AS parts1 FROM y) u CROSS JOIN f GROUP BY ALL)
SELECT doc_id, function, 'src/f.c' AS file, CASE WHEN score >= 100 THEN 'function_definition_hunk_match' WHEN score >= 50 THEN 'function_header_hunk_match' WHEN score > 0 THEN 'function_reference_hunk_match' ELSE 'single_code_file_fallback' END AS inferred_by,
  CAST(CASE WHEN score > 0 THEN score + 5 ELSE 0 END AS BIGINT) AS score FROM s"""

_PAIRS = """SELECT {key}, {start} AS started_at, {end} AS completed_at{more} FROM (
  SELECT c.*, (SELECT max(p.{order}) FROM {t} p WHERE p.{key} = c.{key} AND p.{order} < c.{order} AND p.{kind} IN ('{a}', '{b}')) AS before FROM {t} c WHERE c.{kind} = '{b}') c
  LEFT JOIN {t} s ON s.{key} = c.{key} AND s.{order} = c.before AND s.{kind} = '{a}'"""

_TIMED = """x AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events)"""
_RANGES = """l AS (SELECT l_returnflag AS f, l_linenumber AS n, l_orderkey AS k, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem),
a AS (SELECT * FROM l WHERE n = 1), b AS (SELECT * FROM l WHERE n = 2)"""

ORACLES: dict[str, str] = {
    "eval_metrics": _metrics(""),
    "eval_metrics_by_source": _metrics("cve"),
    "metrics_document": f"""WITH m AS ({_metrics("")}) SELECT TP, TN, FP, FN, TC, "not_affected_FN", accuracy AS A, "DSR", mismatches, true AS written FROM m""",
    "eval_mismatches": f"{_SIMULATED} SELECT cve, \"binary\", expected, predicted FROM o WHERE outcome IN ('FP', 'FN', 'na_fp', 'na_fn')",
    "select_limit": "SELECT DISTINCT source AS cve FROM documents WHERE source LIKE 'src1%' ORDER BY 1 LIMIT 5",
    "task_plan_binarywise": "SELECT regexp_replace('CVE ' || doc_id || '__' || b, '[^A-Za-z0-9_.-]+', '_', 'g') AS run_id, 'CVE ' || doc_id AS cve, b AS \"binary\" FROM (SELECT doc_id, lang AS b FROM documents UNION ALL SELECT doc_id, source FROM documents)",
    "resume_pending": """SELECT CAST(doc_id // 5 AS VARCHAR) AS run_id, count(*) AS binaries FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (toxic IS NULL OR toxic = 1) > 0""",
    "anonymize_map": "SELECT conv_id, turn, role, 'target_' || lpad(CAST((SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn <= c.turn) AS VARCHAR), 3, '0') AS anonymous FROM conversations c",
    "verdict_extract_json": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "merge_latest": "SELECT user_id, event_type, event_id, value FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type)",
    "command_pairing": _PAIRS.format(key="user_id", order="event_id", t="(SELECT user_id, event_id, event_type FROM events)", kind="event_type", a="view", b="purchase", start="coalesce(s.event_id, c.event_id)", end="c.event_id", more=", c.event_id - coalesce(s.event_id, c.event_id) AS elapsed, s.event_id IS NOT NULL AS paired").replace("SELECT user_id,", "SELECT c.user_id,", 1),
    "turn_pairing": _PAIRS.format(key="conv_id", order="turn", t="(SELECT conv_id, turn, role, text FROM conversations)", kind="role", a="user", b="assistant", start="coalesce(s.turn, c.turn)", end="c.turn", more=", CAST(strlen(c.text) AS BIGINT) AS bytes").replace("SELECT conv_id,", "SELECT c.conv_id,", 1),
    "symbol_ranges": "SELECT user_id, event_id AS addr, event_type AS name, greatest(event_id + 1, least(coalesce((SELECT min(n.event_id) FROM events n WHERE n.user_id = e.user_id AND n.event_id > e.event_id), event_id + 16), event_id + 16)) AS stop FROM events e",
    "line_context_grep": f"{_GREP} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, hit, separator, CAST(strlen(line) AS BIGINT) AS bytes FROM s",
    "grep_matched": f"""{_GREP}, b AS (SELECT *, coalesce(sum(strlen(line) + 1 + CASE WHEN separator THEN 3 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
      c AS (SELECT doc_id, g, min(before) AS first, count(*) FILTER (hit) AS hits FROM b GROUP BY 1, 2) SELECT doc_id, CAST(coalesce(sum(hits) FILTER (first <= 512), 0) AS BIGINT) AS matched FROM c GROUP BY 1""",
    "byte_capped_emit": f"WITH {_LINES}, r AS (SELECT doc_id, line_no, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto, strlen(line) + 1 AS own, sum(strlen(line) + 1) OVER (PARTITION BY doc_id) AS whole FROM l) SELECT doc_id, count(*) AS lines, CAST(least(max(upto), 256) AS BIGINT) AS bytes, max(whole) > 256 AS truncated FROM r WHERE upto - own < 256 GROUP BY 1",
    "diff_parse_lines": f"WITH {_NUMBERED} SELECT doc_id, CASE m WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END AS sign, old_ln, new_ln, CAST(length(t) AS BIGINT) AS chars FROM q WHERE NOT lost",
    "hunk_old_new": f"WITH {_DIFFS} SELECT doc_id, 'src/f.c' AS path, count(*) FILTER (m = 1 AND NOT lost) AS old_lines, count(*) FILTER (m = 2 AND NOT lost) AS new_lines, CAST(coalesce(length(string_agg(t, chr(10)) FILTER (m = 2 AND NOT lost)), 0) AS BIGINT) AS new_chars FROM z GROUP BY 1",
    "changed_in_range": f"WITH {_NUMBERED} SELECT DISTINCT doc_id, CASE m WHEN 1 THEN 'old' ELSE 'new' END AS side, CASE m WHEN 1 THEN old_ln ELSE new_ln END AS ln FROM q WHERE m > 0 AND NOT lost AND CASE m WHEN 1 THEN old_ln ELSE new_ln END BETWEEN 12 AND 21",
    "hunk_score_argmax": _SCORES,
    "interval_containment": """WITH i AS (SELECT l_orderkey, l_linenumber AS s, l_linenumber + CAST(floor(l_quantity) AS INTEGER) % 5 AS e, l_partkey AS q FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s - e, s, q) AS k FROM i)
      SELECT l_orderkey, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.l_orderkey = a.l_orderkey AND b.k < a.k AND b.s <= a.s AND a.e <= b.e)""",
    "tokens_within": f"WITH {_TIMED} SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS recent, count(*) OVER w AS recent_rows FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)",
    "duration_standing": f"""WITH {_TIMED}, y AS (SELECT *, cents % 300 AS e FROM x) SELECT event_id, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist,
      ntile(4) OVER (PARTITION BY user_id ORDER BY e, event_id) AS tile, nth_value(e, 2) OVER (PARTITION BY user_id ORDER BY e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
      count(*) OVER (PARTITION BY user_id ORDER BY e GROUPS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM y WINDOW w AS (PARTITION BY user_id ORDER BY e)""",
    "sketch_rollup": f"""WITH {_TIMED} SELECT event_type, day, count(*) AS n, count(DISTINCT user_id || ' ' || props) AS items, true AS items_close, true AS median_close FROM x GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())""",
    "frequent_items": f"WITH {_TIMED} SELECT event_type, props, count(*) AS n, true AS close FROM x GROUP BY ALL",
    "stored_results": """WITH x AS (SELECT 'CVE-' || user_id AS cve, event_type AS "binary", event_id AS written, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_id % 3 > 0 OR user_id IN (3, 7, 11))
      SELECT cve, "binary", max(written) AS written, arg_max(cents, written) AS cents FROM x GROUP BY ALL""",
    "pipeline_driver": """WITH c AS (SELECT count(text) AS texts, count(DISTINCT source) FILTER (text IS NOT NULL) + coalesce(max(CASE WHEN text IS NOT NULL AND source IS NULL THEN 1 END), 0) AS sources FROM documents),
      r AS (SELECT * FROM (VALUES ('whole', 'initial', 0), ('whole', 'analysis', 0), ('whole', 'behaviour', 0), ('whole', 'summary', 0), ('whole', 'extra', 2), ('stops', 'initial', 0), ('stops', 'analysis', 1), ('stops', 'behaviour', 3), ('stops', 'summary', 3), ('stops', 'extra', 3),
        ('goes on', 'initial', 0), ('goes on', 'analysis', 1), ('goes on', 'behaviour', 4), ('goes on', 'summary', 0), ('goes on', 'extra', 2)) v(run, name, k))
      SELECT run, name, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN k < 2 THEN k END AS returncode, CASE WHEN k = 0 THEN CASE name WHEN 'initial' THEN texts WHEN 'summary' THEN 1 ELSE sources END END AS rows,
        CASE WHEN k > 1 THEN 'skipped' WHEN name = 'behaviour' THEN 'rehearsed' ELSE 'run' END AS mode, CASE k WHEN 2 THEN 'not asked for' WHEN 3 THEN 'an earlier step failed' WHEN 4 THEN 'missing input: analysis' END AS reason FROM r, c""",
    "colocated_results": """SELECT d.doc_id AS cve, CASE WHEN n_chars % 2 = 0 THEN 'present' ELSE 'absent' END AS said, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'present' ELSE 'absent' END END AS expected, user_id AS run
      FROM documents d LEFT JOIN labels l USING (doc_id) JOIN events ON event_id = d.doc_id""",
    "range_overlaps": f"WITH {_RANGES} SELECT a.f AS l_returnflag, a.k AS a, count(*) AS n, min(b.k) AS least, max(b.k + b.q % 7) AS reach FROM a JOIN b ON a.f = b.f AND a.k <= b.k + b.q % 7 AND b.k <= a.k + a.q GROUP BY ALL",
    "range_containment": f"WITH {_RANGES} SELECT a.f AS l_returnflag, a.k AS a, count(*) AS n, max(b.k) AS last FROM a JOIN b ON a.f = b.f AND a.k <= b.k AND b.k + b.q % 7 <= a.k + a.q GROUP BY ALL",
    "status_histogram": "SELECT coalesce(nullif(CASE WHEN quality = 0 THEN 'failed' WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'ok' END, ''), 'unknown') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "template_render": "SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(source, '') || ': ' || coalesce(source || ' ' || n_chars, '') AS prompt FROM documents",
    "clamp_limits": "SELECT event_id, greatest(1, least(event_id % 9000, 4096)) AS window, greatest(0, least(event_id % 40, 16)) AS context, greatest(1024, least(user_id * 700, 65536)) AS max_output FROM events",
    "address_windows": "SELECT event_id, greatest(0, event_id - greatest(1, (user_id % 7) // 2)) AS low, event_id + greatest(1, (user_id % 7) // 2) AS high FROM events",
    "compact_rollup": """SELECT conv_id AS cve_id, arg_min(role, turn) AS cwe, arg_min(CAST(turn AS VARCHAR), turn) AS message, string_agg(role || ',h', ',' ORDER BY turn) AS hunks, count(*) AS functions FROM conversations GROUP BY 1""",
    "behaviour_statistics": "SELECT count(*) FILTER (doc_id % 6 = 0) AS analyzed, count(*) FILTER (doc_id % 4 = 0) AS errors FROM documents",
    "metadata_join": "SELECT doc_id AS cve, lang AS \"binary\", 'error' AS status, 'low' AS confidence FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "progress_ordinals": "SELECT source AS cve, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM documents)",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | domain_oracle.ORACLES | streams.ORACLE
