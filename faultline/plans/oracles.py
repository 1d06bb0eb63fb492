"""The same queries as plain SQL for another engine, written from the definitions rather than from the
Spark plans: windows over whole runs, row-wise unnesting, no buckets and no pre-aggregation."""

from __future__ import annotations

from faultline.operators.calibration import LEARNING_RATE, STEPS
from faultline.operators.compaction import catalog_text
from faultline.operators.mining import FEATURES, FLAGS, KEYWORD_STOPWORDS
from faultline.operators.responses import BASELINE_KEYWORDS
from faultline.operators.rules import RULES
from faultline.functions.stepflags import FILE_PATH, RUNTESTS_COMMAND, TEST_COMMAND, TEST_FAIL, TEST_PASS
from faultline.functions.text import WHITESPACE
from faultline.taxonomy import CATEGORIES, CODES, FINGERPRINTS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q('(?i)' + pattern)})"


_CODES = "[" + ", ".join(_q(c) for c in CODES) + "]"
_SPACE = "'" + "".join(c if c != "'" else "''" for c in WHITESPACE) + "'"

RUNS = r"""
ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k,
         user_id * 8 + (day(ts) - 1) // 7 AS rk
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rk ORDER BY ts, event_id) - 1 AS idx,
    CASE WHEN event_type = 'view' THEN 'file_read'
         WHEN event_type = 'purchase' AND k < 25 AND rk % 3 <> 0 THEN 'file_edit'
         WHEN event_type = 'signup' AND k < 20 THEN 'finish'
         WHEN event_type = 'signup' THEN 'message'
         WHEN event_type = 'error' AND k < 5 THEN 'error'
         ELSE 'command' END AS action_type
  FROM ev),
steps AS (
  SELECT 'run-' || rk AS run_id, rk, idx, action_type, ts,
    CASE WHEN action_type = 'file_read' THEN 'open src/mod_' || (k % 4) || '.py'
         WHEN action_type = 'file_edit' THEN 'edit src/mod_' || (k % 4) || '.py'
         WHEN action_type = 'command' THEN CASE k % 5 WHEN 0 THEN 'pytest tests/test_' || (k % 3)
           WHEN 1 THEN 'python runtests.py app' WHEN 2 THEN 'grep -rn foo src' WHEN 3 THEN 'make build'
           ELSE 'git status' END
         ELSE action_type END AS content,
    action_type NOT IN ('message', 'finish') AS has_obs,
    CASE WHEN action_type IN ('message', 'finish') THEN NULL
         WHEN event_type = 'error' THEN CASE WHEN k < 3 THEN 'Error 429 rate limit exceeded'
           WHEN k < 6 THEN 'maximum iterations reached' WHEN k < 12 THEN 'ModuleNotFoundError: No module named foo'
           WHEN k < 20 THEN 'bash: python: command not found' WHEN k < 26 THEN 'patch does not apply'
           WHEN k < 40 THEN 'AssertionError: expected 1 but got 2' WHEN k < 48 THEN 'No such file or directory'
           ELSE '1 failed' END
         WHEN action_type = 'command' AND k % 5 = 0 THEN '3 passed' ELSE 'ok' END AS obs,
    CASE WHEN action_type IN ('message', 'finish') THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code
  FROM numbered),
flagged AS (
  SELECT *, has_obs AND (coalesce(exit_code <> 0, false) OR action_type = 'error') AS failed,
    CASE WHEN action_type IN ('file_edit', 'file_read') THEN nullif(regexp_extract(content, '__PATH__', 1), '') END AS path
  FROM steps),
runs AS (
  SELECT rk, 'run-' || rk AS run_id, 'task-' || min(user_id) AS task_id,
    CASE WHEN rk % 2 = 0 THEN 'openhands' ELSE 'swe-agent' END AS agent,
    CASE WHEN rk % 3 <> 0 THEN 'model-' || (rk % 3) END AS model,
    CASE WHEN rk % 5 <> 0 THEN 'org/repo-' || (rk % 5) END AS repo,
    'Fix issue ' || repeat(rk || ' ', CAST(rk % 400 AS INTEGER)) AS problem_statement,
    CASE WHEN rk % 20 = 1 THEN 'diff --git a/src/mod.py b/src/mod.py' || repeat(chr(10) || '-x', 12)
         WHEN rk % 4 = 1 THEN 'diff --git a/src/mod.py b/src/mod.py' || chr(10) || '-x' || chr(10) || '+y' END AS final_patch,
    CASE WHEN rk % 4 <> 0 THEN rk % 4 = 1 END AS test_passed,
    CASE WHEN rk % 4 <> 0 THEN rk % 9 + 4 END AS total_tests, CASE WHEN rk % 4 = 1 THEN rk % 9 + 4 END AS passed_tests,
    CASE WHEN rk % 4 = 2 THEN rk % 3 END AS failed_tests,
    CASE WHEN rk % 4 <> 0 AND rk % 5 < 3 THEN 'log of ' || rk || repeat(chr(10) || 'ran', CAST(rk % 300 AS INTEGER)) ELSE '' END AS raw_log,
    CASE WHEN rk % 7 = 0 THEN rk % 14 = 0 END AS resolved,
    CASE WHEN rk % 50 = 3 THEN 'RuntimeError: agent crashed' END AS error,
    count(*) AS n_steps, max(ts) AS ended_at
  FROM ev GROUP BY rk)
""".replace("__PATH__", FILE_PATH)

FINGERPRINT_CTE = (
    ", fp AS (SELECT f.run_id, f.rk, f.idx AS step_index, d.code, d.label FROM ("
    "SELECT *, CASE " + " ".join(f"WHEN {_re('obs', p)} THEN {i}" for i, (p, _, _) in enumerate(FINGERPRINTS))
    + " END AS id FROM flagged WHERE failed) f JOIN "
    + _values([(i, c, l) for i, (_, c, l) in enumerate(FINGERPRINTS)]) + " AS d(id, code, label) ON f.id = d.id)"
)


def _names(condition: str) -> str:
    return f"coalesce(string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (WHERE {condition}), '')"


SIGNALS = RUNS + FINGERPRINT_CTE + f"""
, commands AS (
  SELECT run_id, trim(content, {_SPACE}) AS command, count(*) AS n, min(idx) AS first_index
  FROM steps WHERE action_type = 'command' GROUP BY ALL),
first_edits AS (SELECT run_id, min(idx) AS first_edit FROM steps WHERE action_type = 'file_edit' GROUP BY 1),
per_run AS (
  SELECT s.run_id, count(*) AS n,
    count(*) FILTER (WHERE failed) AS n_failed,
    count(*) FILTER (WHERE action_type = 'file_edit') AS edits,
    max(idx) FILTER (WHERE action_type = 'file_edit') AS last_edit,
    count(DISTINCT path) FILTER (WHERE action_type = 'file_read') AS opened,
    bool_or(action_type = 'command' AND {_re('content', TEST_COMMAND)}) AS ran_tests,
    bool_or(action_type = 'finish') AS finished,
    coalesce(bool_or(failed AND idx >= e.first_edit AND {_re('obs', 'assertionerror|assert .*==|expected .* but got')}), false) AS assertion_after_edit,
    max_by(CASE WHEN {_re('obs', TEST_FAIL)} THEN false WHEN {_re('obs', TEST_PASS)} THEN true END, idx)
      FILTER (WHERE action_type = 'command' AND {_re('content', TEST_COMMAND)}
              AND ({_re('obs', TEST_FAIL)} OR {_re('obs', TEST_PASS)})) AS verdict,
    max(idx) FILTER (WHERE action_type = 'command' AND {_re('content', RUNTESTS_COMMAND)}) AS harness_idx,
    max_by(exit_code = 0, idx) FILTER (WHERE action_type = 'command' AND {_re('content', RUNTESTS_COMMAND)}) AS harness_ok
  FROM flagged s LEFT JOIN first_edits e ON e.run_id = s.run_id GROUP BY 1),
per_fp AS (
  SELECT f.run_id, count(*) AS n_fps,
    count(*) FILTER (WHERE code = 'INFRA_ERROR') AS n_infra, count(*) FILTER (WHERE code = 'ENVIRONMENT') AS n_env,
    count(*) FILTER (WHERE code = 'TOOL_USE') AS n_tool, bool_or(code = 'RESOURCE_LIMIT') AS capped,
    {_names("code = 'INFRA_ERROR'")} AS infra_labels, {_names("code = 'RESOURCE_LIMIT'")} AS resource_labels,
    {_names("code = 'TOOL_USE'")} AS tool_labels,
    {_names("code = 'ENVIRONMENT' AND step_index < greatest(3, n // 4)")} AS early_env_labels,
    {_names("label IN ('missing binary', 'wrong path') AND step_index >= n - greatest(2, n // 10)")} AS late_command_labels,
    bool_or(label = 'missing binary') AS missing_binary
  FROM fp f JOIN per_run p ON p.run_id = f.run_id GROUP BY 1),
joined AS (
  SELECT r.*, p.*, coalesce(f.n_fps, 0) AS n_fps, coalesce(f.n_infra, 0) AS n_infra, coalesce(f.n_env, 0) AS n_env,
    coalesce(f.n_tool, 0) AS n_tool, coalesce(f.capped, false) AS capped, coalesce(f.infra_labels, '') AS infra_labels,
    coalesce(f.resource_labels, '') AS resource_labels, coalesce(f.tool_labels, '') AS tool_labels,
    coalesce(f.early_env_labels, '') AS early_env_labels, coalesce(f.late_command_labels, '') AS late_command_labels,
    coalesce(f.missing_binary, false) AS missing_binary,
    coalesce(length(trim(final_patch, {_SPACE})) > 0, false) AS patched,
    coalesce((SELECT count(*) FROM commands c WHERE c.run_id = r.run_id AND c.n >= 3), 0) AS repeats,
    coalesce(test_passed, verdict) AS tests_passed,
    len(string_split(final_patch, chr(10) || '-')) - 1 AS removed, len(string_split(final_patch, chr(10) || '+')) - 1 AS added
  FROM runs r JOIN per_run p USING (run_id) LEFT JOIN per_fp f USING (run_id)),
sig AS (
  SELECT run_id, rk, task_id, agent, model, n AS step_count, patched AS produced_patch, edits = 0 AS no_file_edits,
    ran_tests, tests_passed, finished AS finished_explicitly, finished AND NOT ran_tests AS finished_without_testing,
    finished AND tests_passed IS NOT DISTINCT FROM false AS finished_on_red, capped AS hit_resource_limit,
    coalesce(error, '') <> '' AS framework_error,
    coalesce(removed > 10 AND added < 0.3 * removed, false) AS catastrophic_edit,
    edits = 0 AND coalesce(harness_ok, false) AND coalesce(harness_idx >= n - greatest(1, n // 5), false) AS verified_without_editing,
    opened AS unique_files_opened, assertion_after_edit,
    n >= 20 AND edits = 0 AND opened < 3 AS narrow_file_search, coalesce(last_edit, -1) AS last_edit_step_index,
    n_failed AS n_failed_steps, repeats AS n_repeated_commands, n_fps AS n_error_fingerprints,
    n_infra AS n_infra_fps, n_env AS n_env_fps, n_tool AS n_tool_fps, infra_labels, resource_labels, tool_labels,
    early_env_labels, late_command_labels, missing_binary AS has_missing_binary
  FROM joined)
"""

_WHEN = {
    "E1": "catastrophic_edit",
    "E2": "n_infra_fps > 0 AND NOT produced_patch",
    "E3": "hit_resource_limit",
    "E4": "n_tool_fps > 0 AND NOT no_file_edits AND NOT produced_patch",
    "E5": "late_command_labels <> '' AND no_file_edits AND NOT hit_resource_limit",
    "E6": "produced_patch AND NOT no_file_edits AND has_missing_binary AND NOT catastrophic_edit",
    "E7": "verified_without_editing",
    "E8": "NOT produced_patch AND no_file_edits AND step_count >= 10 AND n_infra_fps = 0",
    "E9": "early_env_labels <> '' AND NOT produced_patch",
    "E10": "assertion_after_edit AND NOT no_file_edits AND NOT catastrophic_edit",
    "E11": "narrow_file_search AND NOT hit_resource_limit",
}
_SHOWN = {
    "E2": ["infra_labels"], "E3": ["resource_labels"], "E4": ["tool_labels"], "E5": ["late_command_labels"],
    "E8": ["step_count"], "E9": ["early_env_labels"], "E10": ["coalesce(files, 'unknown')"],
    "E11": ["unique_files_opened", "step_count"],
}


def _rationale(rule) -> str:
    """The wording with its expressions replaced by this dialect's, in order."""
    out, rest = [], rule.rationale
    for shown in _SHOWN.get(rule.rule_id, []):
        before, _, after = rest.partition("{")
        out += [_q(before), f"CAST({shown} AS VARCHAR)"]
        rest = after.partition("}")[2] if rule.rule_id != "E10" else after[after.index("}") + 1:]
    out.append(_q(rest))
    return " || ".join(out)


_BY_ID = {r.rule_id: r for r in RULES}
DECIDED = SIGNALS + (
    ", edit_names AS (SELECT run_id, string_agg(path, ', ' ORDER BY idx) AS files FROM (SELECT *, row_number() OVER "
    "(PARTITION BY run_id ORDER BY idx) AS r FROM flagged WHERE action_type = 'file_edit' AND path IS NOT NULL) "
    "WHERE r <= 3 GROUP BY 1)"
    ", hit AS (SELECT s.*, files, CASE " + " ".join(f"WHEN {c} THEN '{i}'" for i, c in _WHEN.items())
    + " END AS rule_id FROM sig s LEFT JOIN edit_names USING (run_id))"
    ", dec AS (SELECT h.*, d.code AS rule_code, d.confidence AS rule_confidence, CASE rule_id "
    + " ".join(f"WHEN '{i}' THEN {_rationale(_BY_ID[i])}" for i in _WHEN)
    + " END AS rule_rationale FROM hit h LEFT JOIN "
    + "(VALUES " + ", ".join(f"('{r.rule_id}', '{r.code}', CAST({r.confidence} AS DOUBLE))" for r in RULES)
    + ") AS d(id, code, confidence) ON d.id = h.rule_id)"
)

TAXONOMY = ", taxonomy AS (SELECT * FROM " + _values([
    (i, c["code"], c["owner"], c["recommended_action"], c["prevention"], c["fix_suggestion"], c["definition"])
    for i, c in enumerate(CATEGORIES)
]) + " AS t(position, code, owner, recommended_action, prevention, fix_suggestion, definition))"

VERDICTS = DECIDED + TAXONOMY + f"""
, verdicts AS (
  SELECT d.run_id, d.rk, d.task_id, d.agent, rule_code, coalesce(rule_code, 'OTHER') AS primary_category,
    coalesce(rule_confidence, 0) AS confidence, CASE WHEN rule_id IS NULL THEN 'llm' ELSE 'rule' END AS classifier, t.owner
  FROM dec d JOIN taxonomy t ON t.code = coalesce(d.rule_code, 'OTHER')),
pairs AS (
  SELECT *, CASE WHEN (rk * 7919) % 10 < 7 THEN primary_category ELSE ({_CODES})[rk % 10 + 1] END AS t,
    primary_category AS p FROM verdicts)
"""

# What the sample responses say, by run number modulo six; kind 5 has no response.
RESPONSES = """
, answers AS (
  SELECT run_id, rk, rk % 6 <> 4 AS parsed,
    CASE rk % 6 WHEN 0 THEN 'SCOPING' WHEN 1 THEN 'VERIFICATION' WHEN 2 THEN 'REASONING' ELSE 'OTHER' END AS primary_category,
    CASE WHEN rk % 6 = 0 THEN 'VERIFICATION' END AS secondary_category,
    CASE rk % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence,
    CASE WHEN rk % 6 = 0 THEN 'SCOPING=90,REASONING=20' ELSE '' END AS all_categories,
    CASE rk % 6 WHEN 0 THEN 'Vague task ' || rk WHEN 2 THEN 'Logic {' || rk || '}' WHEN 3 THEN 'Unknown'
      ELSE '(no root cause given)' END AS root_cause,
    CASE rk % 6 WHEN 0 THEN '2,0,1,999999' WHEN 1 THEN '1' WHEN 3 THEN '0' ELSE '' END AS cited
  FROM runs WHERE rk % 6 <> 5),
cites AS (
  SELECT run_id, c.kind, c.pos, c.step_index, c.why FROM runs JOIN
    (VALUES (0, 0, 2, 'third'), (0, 1, 0, 'first'), (0, 2, 1, ''), (0, 3, 999999, ''), (1, 0, 1, ''), (3, 0, 0, ''))
    AS c(kind, pos, step_index, why) ON runs.rk % 6 = c.kind),
cited AS (
  SELECT c.run_id, row_number() OVER (PARTITION BY c.run_id ORDER BY c.pos) - 1 AS rank, c.step_index, left(s.content, 200) AS excerpt, c.why
  FROM cites c JOIN steps s ON s.run_id = c.run_id AND s.idx = c.step_index)
"""

CARDS = VERDICTS + RESPONSES + """
, rule_hits AS (
  SELECT d.run_id, row_number() OVER (PARTITION BY d.run_id ORDER BY step_index) - 1 AS rank, step_index, label AS excerpt,
    'deterministic fingerprint' AS why FROM dec d JOIN fp USING (run_id) WHERE fp.code = d.rule_code),
rule_proof AS (SELECT * FROM rule_hits WHERE rank < 3),
llm_proof AS (
  SELECT c.run_id, c.rank, c.step_index, c.excerpt, c.why FROM cited c JOIN dec d USING (run_id) WHERE d.rule_id IS NULL),
proof AS (SELECT * FROM rule_proof UNION ALL SELECT * FROM llm_proof),
card AS (
  SELECT d.run_id, d.task_id, d.agent, d.model,
    CASE WHEN rule_id IS NOT NULL THEN rule_code WHEN a.parsed THEN a.primary_category ELSE 'OTHER' END AS primary_category,
    CASE WHEN rule_id IS NULL AND a.parsed THEN a.secondary_category END AS secondary_category,
    CASE WHEN rule_id IS NOT NULL THEN rule_confidence WHEN a.parsed THEN a.confidence ELSE 0 END AS confidence,
    CASE WHEN rule_id IS NULL THEN 'llm' ELSE 'rule' END AS classifier,
    CASE WHEN rule_id IS NULL AND a.parsed THEN a.all_categories ELSE '' END AS all_categories,
    CASE WHEN rule_id IS NOT NULL THEN rule_rationale WHEN a.parsed THEN a.root_cause
      WHEN a.parsed IS NULL THEN 'Classification unavailable: Provider error: no response'
      ELSE 'Classification unavailable: Provider error: No JSON object found in model response' END AS root_cause,
    CASE WHEN rule_id IS NULL THEN 'offline' ELSE 'rule-based' END AS provider
  FROM dec d LEFT JOIN answers a USING (run_id)),
full_card AS (
  SELECT c.*, t.owner, t.recommended_action, t.prevention, t.fix_suggestion, '0.2.0' AS taxonomy_version,
    (SELECT count(*) FROM proof p WHERE p.run_id = c.run_id) AS n_evidence
  FROM card c JOIN taxonomy t ON t.code = c.primary_category)
"""


def _runs(select: str) -> str:
    return f"WITH {RUNS} {select}"


def _sig(select: str) -> str:
    return f"WITH {SIGNALS} {select}"


def _ver(select: str) -> str:
    return f"WITH {VERDICTS} {select}"


def _card(select: str) -> str:
    return f"WITH {CARDS} {select}"


_SIG_COLUMNS = """run_id, task_id, agent, model, step_count, produced_patch, no_file_edits, ran_tests, tests_passed,
 finished_explicitly, finished_without_testing, finished_on_red, hit_resource_limit, framework_error, catastrophic_edit,
 verified_without_editing, unique_files_opened, assertion_after_edit, narrow_file_search, last_edit_step_index,
 n_failed_steps, n_repeated_commands, n_error_fingerprints, n_infra_fps, n_env_fps, n_tool_fps, infra_labels,
 resource_labels, tool_labels, early_env_labels, late_command_labels, has_missing_binary"""

SALIENT = SIGNALS + """
, sized AS (SELECT f.*, p.n FROM flagged f JOIN per_run p USING (run_id)),
kept AS (
  SELECT *, lag(idx) OVER (PARTITION BY run_id ORDER BY idx) AS previous FROM sized
  WHERE failed OR action_type = 'file_edit' OR idx >= n - 6 OR idx < 2),
gapped AS (SELECT *, coalesce(idx - previous - 1, 0) AS skipped FROM kept)
"""
def _json_fields(*names: str) -> str:
    return " || ',' || ".join(f"'\"{c}\":' || coalesce(CAST({c} AS VARCHAR), 'null')" for c in names)


PARTS = SALIENT + f"""
, lines AS (
  SELECT run_id, idx, CASE WHEN skipped > 0 THEN '... [' || skipped || ' step(s) omitted] ...' || chr(10) ELSE '' END
    || '[' || idx || '] ' || action_type || ': ' || content
    || CASE WHEN has_obs THEN chr(10) || '    -> ' || coalesce('exit=' || exit_code || ' | ', '') || obs ELSE '' END AS line
  FROM gapped),
listed AS (
  SELECT run_id, 0 AS section, idx AS o, CAST(idx AS VARCHAR) AS item FROM flagged WHERE failed
  UNION ALL SELECT run_id, 1, first_index, '{{"command":' || CAST(to_json(command) AS VARCHAR) || ',"count":' || n || '}}' FROM commands WHERE n >= 3
  UNION ALL SELECT run_id, 2, step_index, '{{"step":' || step_index || ',"code":"' || code || '","label":' || CAST(to_json(label) AS VARCHAR) || '}}' FROM fp
  UNION ALL SELECT run_id, 3, idx, CAST(to_json(path) AS VARCHAR) FROM flagged WHERE action_type = 'file_edit' AND path IS NOT NULL
  UNION ALL SELECT run_id, 4, idx, line FROM lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, section ORDER BY o) - 1 AS r FROM listed),
lengths AS (SELECT run_id, section, (count(*) + 255) // 256 AS parts FROM listed GROUP BY ALL),
framed AS (SELECT * FROM runs r JOIN sig s USING (run_id)),
heads AS (
  SELECT run_id, '=== TASK ===' || chr(10) || 'task_id: ' || task_id || chr(10)
    || coalesce('repo: ' || repo || chr(10), '') || 'problem_statement:' || chr(10) || left(problem_statement, 1500)
    || CASE WHEN length(problem_statement) > 1500 THEN '...[truncated]' ELSE '' END AS head,
    chr(10) || '=== FINAL PATCH ===' || chr(10) || coalesce(final_patch, '(none produced)') AS patch
  FROM runs),
frames AS (
  SELECT run_id, -1 AS section, head || chr(10) || chr(10) || '=== DETERMINISTIC SIGNALS ===' || chr(10) || '{{' ||
    {_json_fields("produced_patch", "no_file_edits", "ran_tests", "tests_passed", "finished_explicitly", "finished_without_testing", "finished_on_red")}
    || ',"failed_step_indices":[' AS item FROM framed JOIN heads USING (run_id)
  UNION ALL SELECT run_id, 0, '],"repeated_commands":[' FROM framed
  UNION ALL SELECT run_id, 1, '],"error_fingerprints":[' FROM framed
  UNION ALL SELECT run_id, 2, '],' ||
    {_json_fields("hit_resource_limit", "framework_error", "catastrophic_edit", "verified_without_editing", "step_count", "unique_files_opened")}
    || ',"edited_files":[' FROM framed
  UNION ALL SELECT run_id, 3, '],' || {_json_fields("assertion_after_edit", "narrow_file_search")}
    || '}}' || chr(10) || chr(10) || '=== TRAJECTORY (salient steps) ===' FROM framed
  UNION ALL SELECT run_id, 4, chr(10) || patch || CASE WHEN test_passed IS NULL THEN '' ELSE
      chr(10) || chr(10) || '=== TEST RESULT ===' || chr(10) || 'passed=' || CASE WHEN test_passed THEN 'True' ELSE 'False' END
      || ' total=' || coalesce(CAST(total_tests AS VARCHAR), 'None') || ' passed_tests=' || coalesce(CAST(passed_tests AS VARCHAR), 'None')
      || ' failed_tests=' || coalesce(CAST(failed_tests AS VARCHAR), 'None')
      || CASE WHEN raw_log <> '' THEN chr(10) || left(raw_log, 800) ELSE '' END END
    FROM framed JOIN heads USING (run_id)),
pieces AS (
  SELECT i.run_id, coalesce((SELECT sum(parts) FROM lengths l WHERE l.run_id = i.run_id AND l.section < i.section), 0) + 1 + r // 256 AS part,
    section, r, CASE WHEN section = 4 THEN chr(10) WHEN r > 0 THEN ',' ELSE '' END || item AS item FROM ranked i
  UNION ALL
  SELECT f.run_id, coalesce((SELECT sum(parts) FROM lengths l WHERE l.run_id = f.run_id AND l.section <= f.section), 0), section, 1000000000, item FROM frames f),
parts AS (SELECT run_id, CAST(part AS BIGINT) AS part, string_agg(item, '' ORDER BY section, r) AS text FROM pieces GROUP BY 1, 2)
"""
_BASELINE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, {_q(w)})" for w in words) + f" THEN {i}" for i, (_, words) in enumerate(BASELINE_KEYWORDS)
) + " END"

_KAPPA = """
, n AS (SELECT {by} count(*) AS n, count(*) FILTER (WHERE t = p) AS n_agree FROM {src} {group}),
tm AS (SELECT {by} t AS label, count(*) AS c FROM {src} GROUP BY ALL),
pm AS (SELECT {by} p AS label, count(*) AS c FROM {src} GROUP BY ALL)
"""

_TREND = VERDICTS + """
, batch AS (SELECT v.*, CAST(r.ended_at AS DATE) AS day FROM verdicts v JOIN runs r USING (run_id)),
cat AS (SELECT day, primary_category AS v, count(*) AS c FROM batch GROUP BY ALL),
own AS (SELECT day, owner AS v, count(*) AS c FROM batch GROUP BY ALL),
trend AS (
  SELECT CAST(epoch(CAST(day AS TIMESTAMP)) AS DOUBLE) AS ts, count(*) AS count,
    (SELECT '{' || string_agg('"' || v || '":' || c, ',' ORDER BY v) || '}' FROM cat WHERE cat.day = b.day) AS distribution,
    (SELECT '{' || string_agg('"' || v || '":' || c, ',' ORDER BY v) || '}' FROM own WHERE own.day = b.day) AS owner_distribution,
    round(count(*) FILTER (WHERE classifier = 'rule') / count(*), 4) AS rule_rate
  FROM batch b GROUP BY day)
"""
_CORRECTIONS = VERDICTS + f"""
, corrections AS (
  SELECT run_id, primary_category AS auto_label, ({_CODES})[(rk + r * 3) % 10 + 1] AS true_label,
    CASE WHEN rk % 5 <> 0 THEN 'note ' || rk END AS note, CAST(rk * 10 + r AS DOUBLE) AS created_at
  FROM verdicts, (VALUES (0), (1)) AS rounds(r) WHERE rk % 9 = 0 AND (r = 0 OR rk % 2 = 0))
"""
def _resampled(pairs: str, upper: int) -> str:
    """Bounds of accuracy and kappa over 1000 resamples; draw i of replicate b is row md5(42:b:i) modulo n."""
    return f"""
, cell AS (SELECT t, p, count(*) AS n, substr(md5(t || '|' || p), 1, 2) AS bucket FROM {pairs} GROUP BY t, p),
stretch AS (SELECT *, sum(n) OVER (ORDER BY bucket, t, p) AS high, sum(n) OVER () AS total FROM cell),
draw AS (SELECT b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 8))::BIGINT % (SELECT max(total) FROM stretch)::BIGINT AS r
  FROM range(1000) AS bs(b), (SELECT unnest(range((SELECT max(total) FROM stretch)::BIGINT)) AS i)),
drawn AS (SELECT b, t, p, count(*) AS n FROM draw JOIN stretch s ON r >= s.high - s.n AND r < s.high GROUP BY ALL),
side_t AS (SELECT b, t AS label, sum(n) AS n FROM drawn GROUP BY ALL), side_p AS (SELECT b, p AS label, sum(n) AS n FROM drawn GROUP BY ALL),
expect AS (SELECT b, sum(side_t.n::DOUBLE * side_p.n) AS products FROM side_t JOIN side_p USING (b, label) GROUP BY b),
whole AS (SELECT b, sum(n)::DOUBLE AS n, coalesce(sum(n) FILTER (WHERE t = p), 0)::DOUBLE AS good FROM drawn GROUP BY b),
stat AS (SELECT good / n AS a, CASE WHEN coalesce(products, 0) / (n * n) >= 1 THEN 1
    ELSE (good / n - coalesce(products, 0) / (n * n)) / (1 - coalesce(products, 0) / (n * n)) END AS k FROM whole LEFT JOIN expect USING (b)),
bound AS (SELECT list_sort(list(a))[26] AS accuracy_low, list_sort(list(a))[{upper}] AS accuracy_high,
    list_sort(list(k))[26] AS kappa_low, list_sort(list(k))[{upper}] AS kappa_high FROM stat)
"""


_LABELS = """
both_labels AS (
  SELECT CAST(doc_id AS VARCHAR) AS run_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS t,
    CASE WHEN toxic = 0 THEN 'GOOD' ELSE 'BAD' END AS p FROM labels)
"""
_LABELLED = VERDICTS + f"""
, labelled AS (
  SELECT s.*, CASE WHEN (v.rk * 7919) % 10 = 9 THEN ({_CODES})[v.rk % 10 + 1] ELSE v.primary_category END AS true_label
  FROM sig s JOIN verdicts v USING (run_id))
"""
_FEATURE_SQL = ", ".join(
    f"coalesce(CAST({f} AS INTEGER), 0) AS {f}" for f in FEATURES
)
_BIN = "CASE " + " ".join(f"WHEN confidence >= {i}::DOUBLE * 0.2::DOUBLE AND confidence < {i + 1}::DOUBLE * 0.2::DOUBLE THEN {i}" for i in range(5)) + " END"
_BINS = VERDICTS + f"""
, bins AS (
  SELECT bin, round(avg(confidence), 4) AS mean_confidence, round(avg(CAST(t = p AS DOUBLE)), 4) AS accuracy, count(*) AS count
  FROM (SELECT *, {_BIN} AS bin FROM pairs) WHERE bin IS NOT NULL GROUP BY bin)
"""
_SIGMOID = "(1.0 / (1.0 + exp(-(a * g.x + b))))"
_PLATT = VERDICTS + f"""
, g AS (SELECT confidence::DOUBLE AS x, count(*)::DOUBLE AS n, count(*) FILTER (WHERE t = p)::DOUBLE AS k FROM pairs GROUP BY 1),
one AS (SELECT list(x ORDER BY x) AS xs, list(n ORDER BY x) AS ns, list(k ORDER BY x) AS ks, sum(n) AS total FROM g),
fit AS (
  WITH RECURSIVE walk(i, a, b) AS (
    SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT i + 1,
      a - {LEARNING_RATE}::DOUBLE * list_sum([(ns[j] / (1.0 + exp(-(a * xs[j] + b))) - ks[j]) * xs[j] FOR j IN range(1, len(xs) + 1)]) / total,
      b - {LEARNING_RATE}::DOUBLE * list_sum([ns[j] / (1.0 + exp(-(a * xs[j] + b))) - ks[j] FOR j IN range(1, len(xs) + 1)]) / total
    FROM walk, one WHERE i < {STEPS})
  SELECT a, b FROM walk WHERE i = {STEPS})
"""

# ---------------------------------------------------------------------------------------------
# Log formats: the same sentences, unnested into rows

_LINE_BREAK_RE2 = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SENTENCES = rf"""
split AS (SELECT doc_id, string_split(regexp_replace(text, '{_LINE_BREAK_RE2}', '.', 'g'), '.') AS list FROM documents),
sent AS (
  SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) - 1 AS i FROM split),
kinded AS (SELECT doc_id, i, s, (length(s) + i) % 7 AS kind, length(trim(s, {_SPACE})) > 0 AS filled FROM sent)
"""

# Expects ``events(doc_id, i, letter, as_action, alone, text, seen, seen_exit, has_seen)``.
_PAIRING = """
, core AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM events WHERE letter <> 'N'),
islands AS (SELECT *, sum(CASE WHEN letter <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM core),
placed AS (
  SELECT *, first_value(letter) OVER (PARTITION BY doc_id, island ORDER BY nth) AS opener,
    row_number() OVER (PARTITION BY doc_id, island ORDER BY nth) - 1 AS inside FROM islands),
after AS (
  -- Waiting after an event: openers A and a leading B start waiting, O does not; every B flips it.
  SELECT *, (CASE WHEN opener = 'O' THEN 0 ELSE 1 END + inside) % 2 = 1 AS waits_after FROM placed),
state AS (
  SELECT *, coalesce(lag(waits_after) OVER w, false) AS waits, lag(as_action) OVER w AS last_action, lag(text) OVER w AS last_text,
    lead(nth) OVER w IS NULL AS is_last FROM after WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
emitted AS (
  SELECT doc_id, i AS place, last_action AS action_type, last_text AS content, NULL AS seen, NULL AS seen_exit, false AS has_seen
  FROM state WHERE waits AND letter = 'A'
  UNION ALL SELECT doc_id, i, last_action, last_text, seen, seen_exit, has_seen FROM state WHERE waits AND letter <> 'A'
  UNION ALL SELECT doc_id, i, alone, text, seen, seen_exit, has_seen FROM state WHERE NOT waits AND letter = 'O'
  UNION ALL SELECT doc_id, i, alone, text, seen, seen_exit, has_seen FROM events WHERE letter = 'N'
  UNION ALL SELECT doc_id, 4000000000000000000, as_action, text, NULL, NULL, false FROM state WHERE is_last AND waits_after)
"""
_DOC_EVENTS = SENTENCES + """
, doc_events AS (
  SELECT doc_id, i,
    CASE kind WHEN 0 THEN 'A' WHEN 1 THEN 'O' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'N' WHEN 5 THEN 'O' ELSE 'A' END AS letter,
    CASE kind WHEN 0 THEN 'command' WHEN 2 THEN 'file_edit' WHEN 6 THEN 'finish' ELSE 'unknown' END AS as_action,
    CASE kind WHEN 1 THEN 'command' WHEN 4 THEN 'message' WHEN 5 THEN 'error' ELSE 'unknown' END AS alone,
    CASE WHEN kind = 2 THEN 'src/m' || (i % 5) || '.py' WHEN filled THEN s WHEN kind = 6 THEN '{"n": 1, "s": ""}' ELSE '' END AS text,
    CASE WHEN kind IN (1, 3, 4, 5) THEN s END AS seen,
    CASE kind WHEN 1 THEN i % 3 WHEN 3 THEN 1 END AS seen_exit,
    kind IN (1, 3) OR (kind IN (4, 5) AND s <> '') AS has_seen
  FROM kinded)
"""
HISTORY = _DOC_EVENTS + ", events AS (SELECT * FROM doc_events)" + _PAIRING
# The documents of a source as one history; the column that names a history is still called doc_id.
SOURCE_HISTORY = _DOC_EVENTS + """
, events AS (SELECT d.source AS doc_id, e.doc_id * 1048576 + i AS i, letter, as_action, alone, e.text, seen, seen_exit, has_seen
  FROM doc_events e JOIN documents d ON d.doc_id = e.doc_id)
""" + _PAIRING
SDK = SENTENCES + f"""
, events AS (
  SELECT doc_id, i,
    CASE kind WHEN 0 THEN 'A' WHEN 1 THEN 'O' WHEN 2 THEN 'A' WHEN 3 THEN 'O' WHEN 4 THEN 'A' WHEN 5 THEN 'N' ELSE 'A' END AS letter,
    CASE kind WHEN 0 THEN 'command' WHEN 2 THEN 'file_edit' WHEN 4 THEN 'finish' ELSE 'unknown' END AS as_action,
    CASE kind WHEN 3 THEN 'command' WHEN 5 THEN 'message' ELSE 'unknown' END AS alone,
    CASE kind WHEN 0 THEN trim(s, {_SPACE}) WHEN 1 THEN '' WHEN 2 THEN trim(CASE WHEN s = '' THEN 'a' ELSE 'a ' || s END, {_SPACE})
      WHEN 4 THEN CASE WHEN filled THEN s ELSE '' END WHEN 6 THEN 'x' || i
      ELSE CASE WHEN filled THEN s ELSE '' END END AS text,
    CASE WHEN kind IN (3, 5) THEN s END AS seen, NULL::INTEGER AS seen_exit, kind IN (3, 5) AND s <> '' AS has_seen
  FROM kinded)
""" + _PAIRING
_EMITTED = """SELECT {rid} AS run_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS index, action_type, content,
  has_seen AS has_obs, CASE WHEN has_seen THEN seen END AS obs_content, CASE WHEN has_seen THEN seen_exit END AS exit_code FROM emitted"""

_FAIL_MARKS = " OR ".join(f"contains(o, {_q(m)})" for m in ("Error", "error", "Traceback", "FAILED", "exit code: 1"))
ACTIONS = SENTENCES + f"""
, entries AS (
  SELECT doc_id, i, kind, (['bash', 'edit', 'view', 'search_dir', 'finish', 'Submit', 'dance'])[kind + 1] || chr(10) || s AS a,
    CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN s WHEN 2 THEN s || ' Error' WHEN 3 THEN 'exit code: 0 ' || s ELSE '  ' || chr(9) END AS o
  FROM kinded)
"""
_DOC_LINES = SENTENCES + """
, doc_lines AS (
  SELECT doc_id, i, CASE kind WHEN 0 THEN '> ' || s WHEN 1 THEN 'Applied edit to src/m.py' WHEN 2 THEN 'Error: ' || s
    WHEN 3 THEN '> ' || s WHEN 5 THEN '> git commit ' || s ELSE s END AS line FROM kinded)
"""
_BLOCKS = rf"""
, isles AS (
  SELECT *, starts_with(line, '> ') AS opens, sum(CASE WHEN starts_with(line, '> ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block
  FROM lines),
blocks AS (
  SELECT doc_id, block, trim(max(substring(line, 3)) FILTER (WHERE opens), {_SPACE}) AS action,
    trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT opens), ''), {_SPACE}) AS seen,
    block = max(block) OVER (PARTITION BY doc_id) AS is_last
  FROM isles WHERE block > 0 GROUP BY doc_id, block),
made AS (
  SELECT *, CASE WHEN is_last THEN CASE WHEN contains(lower(action), 'commit') THEN 'finish' ELSE 'command' END
    WHEN regexp_matches(seen, '(?i)(?:Applied edit|Edited|Updated|Modified)\s+`?([^`\n]+)`?') THEN 'file_edit' ELSE 'command' END AS action_type,
    CASE WHEN NOT is_last AND regexp_matches(seen, '(?i)(?:Error|Failed|Traceback|Aider v\S+ is not installed)') THEN 1 ELSE 0 END AS code
  FROM blocks WHERE action <> '')
"""
TRANSCRIPTS = _DOC_LINES + ", lines AS (SELECT * FROM doc_lines)" + _BLOCKS
SOURCE_TRANSCRIPTS = _DOC_LINES + """
, lines AS (SELECT d.source AS doc_id, d.doc_id * 1048576 + i AS i, line FROM doc_lines e JOIN documents d ON d.doc_id = e.doc_id)
""" + _BLOCKS
_TRANSCRIPT_STEPS = """SELECT 'aider-{doc}' || doc_id AS run_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS index,
  action_type, action AS content, seen <> '' AS has_obs, nullif(seen, '') AS obs_content, CASE WHEN seen <> '' THEN code END AS exit_code FROM made"""
SUMMARIES = SENTENCES + """
, items AS (
  SELECT doc_id, 0 AS stage, i, 'file_edit' AS action_type, 'edit f' || i || '.py' AS content, 'Applied edit to f' || i || '.py' AS seen, 0 AS code
  FROM kinded WHERE kind = 2
  UNION ALL SELECT doc_id, 1, 0, 'command', '(aider internal)', 'crash ' || doc_id, 1 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 2, 0, 'finish', 'git commit: fix ' || doc_id, 'committed', 0 FROM documents WHERE doc_id % 3 = 0),
sessions AS (
  SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS code, doc_id % 4 = 0 AS crashed,
    EXISTS (SELECT 1 FROM kinded k WHERE k.doc_id = d.doc_id AND kind = 2) AS edited FROM documents d)
"""
CHATS = SENTENCES + """
, calls AS (
  SELECT doc_id, i, 0 AS sub, 'c' || i AS id, 'command' AS action_type,
    'Search_Class(' || '{"q": "' || repeat('ab,: ', CAST(i % 100 AS INTEGER)) || '", "n": [' || i || ', 2]}' || ')' AS content
  FROM kinded WHERE kind = 0
  UNION ALL SELECT doc_id, i, 1, 'c' || i || 'b', 'file_edit', 'write_patch({"raw": "no json, really"})' FROM kinded WHERE kind = 0
  UNION ALL SELECT doc_id, i, 0, 'c' || i, 'file_read', 'view_file({})' FROM kinded WHERE kind = 5),
answers AS (
  SELECT doc_id, id, max_by(content, i) AS content FROM (
    SELECT doc_id, i, 'c' || (i - 1) AS id, s AS content FROM kinded WHERE kind = 1
    UNION ALL SELECT doc_id, i, 'c' || (i - 2) || 'b', s || ' Not Found' FROM kinded WHERE kind = 2
    UNION ALL SELECT doc_id, i, 'c' || (i - 1), 'later answer' FROM kinded WHERE kind = 6) GROUP BY ALL),
all_steps AS (
  SELECT c.doc_id, c.i, c.sub, c.action_type, c.content, nullif(a.content, '') AS seen
  FROM calls c LEFT JOIN answers a ON a.doc_id = c.doc_id AND a.id = c.id
  UNION ALL SELECT doc_id, i, 0, 'unknown', s, NULL FROM kinded WHERE kind = 3 AND s <> '')
"""
_FLAG_VALUES = ", ".join(f"coalesce(CAST({f} AS INTEGER), 0) AS {f}" for f in FLAGS)
_FLAGS_OF_SET = ", ".join(f"CASE WHEN m & {1 << i} > 0 THEN {f} END AS {f}" for i, f in enumerate(FLAGS))
_STOP = ", ".join(_q(w) for w in KEYWORD_STOPWORDS)
_PERCENT = "CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%'"


def _keywords(source: str) -> str:
    """Tokens as maximal runs of word characters that match as a whole."""
    return rf"""SELECT term, count(*) AS count FROM (
      SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM {source})
    WHERE regexp_matches(term, '^[a-z][a-z_]{{2,}}$') AND term NOT IN ({_STOP})
    GROUP BY term ORDER BY count DESC, term LIMIT 20"""


ORACLES: dict[str, str] = {
    "steps_table": _runs("SELECT run_id, idx AS index, action_type, content, obs AS obs_content, exit_code, has_obs FROM steps"),
    "step_failed": _runs("SELECT run_id, action_type, failed, count(*) AS n FROM flagged GROUP BY ALL"),
    "failed_steps": _runs("SELECT run_id, idx AS index, action_type, obs AS obs_content FROM flagged WHERE failed"),
    "last_steps": _runs(
        "SELECT run_id, idx AS index, action_type, content FROM steps "
        "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY idx DESC) <= 5"),
    "run_facts": _runs(
        "SELECT run_id, n_steps AS step_count, final_patch IS NOT NULL AS produced_patch, "
        "coalesce(NOT resolved, NOT test_passed, false) AS failed, "
        "left(sha256(task_id || '|' || agent || '|' || coalesce(model, '') || '|' || coalesce(final_patch, '') || '|' || n_steps), 16) AS content_hash FROM runs"),
    "failed_runs": _runs("SELECT run_id, n_steps AS step_count FROM runs WHERE coalesce(NOT resolved, NOT test_passed, false)"),
    "unique_content": _runs(
        "SELECT DISTINCT left(sha256(task_id || '|' || agent || '|' || coalesce(model, '') || '|' || coalesce(final_patch, '') || '|' || n_steps), 16) AS content_hash FROM runs"),
    "fingerprints": _sig("SELECT run_id, step_index, code, label FROM fp"),
    "edited_files": _runs("SELECT run_id, idx AS step_index, path FROM flagged WHERE action_type = 'file_edit' AND path IS NOT NULL"),
    "files_opened": _runs(
        "SELECT run_id, count(DISTINCT path) AS unique_files_opened, count(*) AS n_opens FROM flagged "
        "WHERE action_type = 'file_read' AND path IS NOT NULL GROUP BY 1"),
    "repeated_commands": _sig("SELECT run_id, command, n AS count, first_index FROM commands WHERE n >= 3"),
    "signals_wide": _sig(f"SELECT {_SIG_COLUMNS} FROM sig"),
    "test_verdicts": _sig("SELECT run_id, ran_tests, tests_passed, finished_explicitly, finished_without_testing, finished_on_red FROM sig"),
    "edit_signals": _sig(
        "SELECT run_id, no_file_edits, last_edit_step_index, assertion_after_edit, catastrophic_edit, "
        "verified_without_editing, narrow_file_search FROM sig"),
    "signal_features": _sig(f"SELECT run_id, {_FEATURE_SQL} FROM sig"),
    "rule_cascade": _ver("SELECT run_id, rule_id, rule_code, rule_confidence, rule_rationale FROM dec"),
    "rule_hits": _ver("SELECT rule_id, count(*) AS count FROM dec GROUP BY 1"),
    "rule_evidence": _card("SELECT * FROM rule_proof"),
    "cards": _card("SELECT * FROM full_card"),
    "card_evidence": _card("SELECT * FROM proof"),
    "card_markdown": _card(f"""
      SELECT run_id, '# Triage: ' || task_id || '  ·  `' || primary_category || '`' || chr(10) || chr(10)
        || '- **Run**: `' || run_id || '`  ·  **Agent**: ' || agent || coalesce('  ·  **Model**: ' || model, '') || chr(10)
        || '- **Confidence**: ' || {_PERCENT} || '  ·  **Classifier**: ' || classifier || chr(10)
        || '- **Owner**: `' || owner || '`' || chr(10)
        || coalesce('- **Secondary**: `' || secondary_category || '`' || chr(10), '')
        || CASE WHEN all_categories <> '' THEN '- **All categories**: `SCOPING` (90%), `REASONING` (20%)' || chr(10) ELSE '' END
        || chr(10) || '## Root cause' || chr(10) || root_cause || chr(10) || chr(10) || '## Evidence' || chr(10)
        || coalesce((SELECT string_agg('- **step ' || step_index || '**: `' || excerpt || '`'
             || CASE WHEN why <> '' THEN chr(10) || '  - ' || why ELSE '' END, chr(10) ORDER BY rank) FROM proof p WHERE p.run_id = c.run_id),
             '- _No specific step evidence captured._')
        || chr(10) || chr(10) || '## Recommended action' || chr(10) || recommended_action || chr(10) || chr(10)
        || '## Prevention (class-level)' || chr(10) || prevention || chr(10) || chr(10)
        || '_taxonomy ' || taxonomy_version || ' · ' || provider || '_' AS markdown
      FROM full_card c"""),
    "card_search": _card(
        "SELECT run_id, primary_category, confidence, root_cause FROM full_card WHERE owner = 'agent_framework' AND confidence >= 0.65 "
        "AND (contains(lower(task_id), 'step') OR contains(lower(run_id), 'step') OR contains(lower(root_cause), 'step'))"),
    "cards_without_rules": _card("""
      SELECT r.run_id, CASE WHEN a.parsed THEN a.primary_category ELSE 'OTHER' END AS primary_category,
        CASE WHEN a.parsed THEN a.secondary_category END AS secondary_category,
        CASE WHEN a.parsed THEN a.confidence ELSE 0 END AS confidence, 'llm' AS classifier,
        CASE WHEN a.parsed THEN a.root_cause WHEN a.parsed IS NULL THEN 'Classification unavailable: Provider error: no response'
          ELSE 'Classification unavailable: Provider error: No JSON object found in model response' END AS root_cause
      FROM runs r LEFT JOIN answers a USING (run_id)"""),
    "response_verdicts": _card(
        "SELECT run_id, parsed, primary_category, secondary_category, confidence, all_categories, root_cause, cited FROM answers"),
    "response_evidence": _card("SELECT * FROM cited"),
    "salient_steps": f"WITH {SALIENT} SELECT run_id, idx AS index, action_type, skipped FROM gapped",
    "compacted_parts": f"WITH {PARTS} SELECT run_id, part, text FROM parts",
    "prompt_parts": f"""WITH {PARTS}, told AS (SELECT run_id, part, CASE WHEN part = 0 THEN
        {_q('FAILURE TAXONOMY (choose primary from these codes only):' + chr(10) + catalog_text() + chr(10) * 4 + 'RUN:' + chr(10))} ELSE '' END || text AS text FROM parts)
      SELECT run_id, part, length(text) AS chars, md5(text) AS digest FROM told""",
    "keyword_baseline": f"""WITH {PARTS}, whole AS (SELECT run_id, lower(head || patch || coalesce(string_agg(line, chr(10) ORDER BY idx), '')) AS t
        FROM heads LEFT JOIN lines USING (run_id) GROUP BY run_id, head, patch)
      SELECT run_id, coalesce(([{', '.join(_q(c) for c, _ in BASELINE_KEYWORDS)}])[{_BASELINE} + 1], 'OTHER') AS primary_category, CAST(0.55 AS DOUBLE) AS confidence FROM whole""",
    "category_distribution": _ver("SELECT primary_category, count(*) AS count, owner FROM verdicts GROUP BY ALL"),
    "owner_distribution": _ver("SELECT owner, count(*) AS count FROM verdicts GROUP BY ALL"),
    "classifier_split": _ver("SELECT classifier, count(*) AS count FROM verdicts GROUP BY ALL"),
    "rule_rate": _ver("SELECT count(*) AS n, round(count(*) FILTER (WHERE classifier = 'rule') / greatest(count(*), 1), 4) AS rule_rate FROM verdicts"),
    "other_rate": _ver("SELECT count(*) AS n, round(count(*) FILTER (WHERE primary_category = 'OTHER') / greatest(count(*), 1), 4) AS other_rate FROM verdicts"),
    "average_confidence": _ver("SELECT count(*) AS n, round(avg(confidence), 6) AS average_confidence FROM verdicts"),
    "calibration_view": _ver("""
      SELECT 'category' AS dimension, primary_category AS value, count(*) AS count, NULL::DOUBLE AS other_rate FROM verdicts GROUP BY 2
      UNION ALL SELECT 'classifier', classifier, count(*), NULL FROM verdicts GROUP BY 2
      UNION ALL SELECT 'total', 'all', greatest(count(*), 1), round(count(*) FILTER (WHERE primary_category = 'OTHER') / greatest(count(*), 1), 4) FROM verdicts"""),
    "summary_tiles": _ver(
        "SELECT count(*) AS n, count(*) FILTER (WHERE owner = 'agent_framework') AS escalations, "
        "CAST(floor(count(*) FILTER (WHERE classifier = 'rule') / greatest(count(*), 1) * 100 + 0.5) AS BIGINT) AS rule_share_percent, "
        "count(DISTINCT primary_category) AS distinct_modes, count(DISTINCT owner) AS owners_seen FROM verdicts"),
    "zero_filled_distribution": _ver("""
      SELECT t.position, t.code AS primary_category, t.owner, coalesce(c, 0) AS count,
        round(coalesce(c, 0) / greatest(max(coalesce(c, 0)) OVER (), 1) * 100, 4) AS bar_percent
      FROM taxonomy t LEFT JOIN (SELECT primary_category, count(*) AS c FROM verdicts GROUP BY 1) v ON v.primary_category = t.code"""),
    "stored_distribution": _ver("""
      SELECT CASE WHEN rk % 11 = 0 THEN 'UNKNOWN' ELSE primary_category END AS primary_category,
        CASE WHEN rk % 13 = 0 THEN 'unknown' ELSE owner END AS owner, count(*) AS count FROM verdicts GROUP BY 1, 2"""),
    "version_pivot": _ver("""
      SELECT primary_category, count(*) FILTER (WHERE v = 'auto') AS auto, count(*) FILTER (WHERE v = 'manual') AS manual FROM (
        SELECT p AS primary_category, 'auto' AS v FROM pairs UNION ALL SELECT t, 'manual' FROM pairs) GROUP BY 1"""),
    "trend": f"WITH {_TREND} SELECT * FROM trend",
    "trend_topk": f"WITH {_TREND} SELECT * FROM trend ORDER BY ts DESC LIMIT 7",
    "trend_size": f"WITH {_TREND} SELECT count(*) AS total_batches_recorded FROM trend",
    "corrections": f"WITH {_CORRECTIONS} SELECT * FROM corrections",
    "corrections_topk": f"WITH {_CORRECTIONS} SELECT * FROM corrections ORDER BY created_at DESC LIMIT 20",
    "correction_overlay": f"""WITH {_CORRECTIONS}, latest AS (SELECT * FROM corrections QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC) = 1)
      SELECT v.run_id, v.primary_category, l.true_label AS human_label, l.note AS human_note FROM verdicts v LEFT JOIN latest l USING (run_id)""",
    "eval_details": _ver("""
      SELECT run_id, task_id, CASE WHEN rk % 3 = 0 THEN 'OTHER' ELSE t END AS "true", p AS predicted,
        (CASE WHEN rk % 3 = 0 THEN 'OTHER' ELSE t END) = p AS correct, confidence, classifier FROM pairs"""),
    "accuracy_kappa": f"WITH {VERDICTS}" + _KAPPA.format(by="", src="pairs", group="") + """
      , e AS (SELECT sum((tm.c / n.n) * (pm.c / n.n)) AS e FROM n, tm JOIN pm USING (label))
      SELECT n.n, n_agree, round(n_agree / n.n, 6) AS accuracy, round(CASE WHEN e >= 1 THEN 1 ELSE (n_agree / n.n - e) / (1 - e) END, 6) AS kappa FROM n, e""",
    "eval_report": f"WITH {VERDICTS}" + _KAPPA.format(by="", src="pairs", group="") + _resampled("pairs", 975) + """
      , e AS (SELECT sum((tm.c / n.n) * (pm.c / n.n)) AS e FROM n, tm JOIN pm USING (label))
      SELECT n.n, round(n_agree / n.n, 4) AS accuracy, round(CASE WHEN e >= 1 THEN 1 ELSE (n_agree / n.n - e) / (1 - e) END, 4) AS kappa,
        round(accuracy_low, 4) AS accuracy_low, round(accuracy_high, 4) AS accuracy_high, round(kappa_low, 4) AS kappa_low,
        round(kappa_high, 4) AS kappa_high FROM n, e, bound""",
    "bootstrap_ci": f"WITH {VERDICTS}" + _resampled("pairs", 975) + "SELECT * FROM bound",
    "annotator_bootstrap_ci": f"WITH {_LABELS}" + _resampled("both_labels", 976) + "SELECT * FROM bound",
    "per_class": _ver("""
      , l AS (SELECT DISTINCT unnest([t, p]) AS label FROM pairs),
      c AS (SELECT label, count(*) FILTER (WHERE t = label AND p = label) AS tp, count(*) FILTER (WHERE p = label) AS pp,
              count(*) FILTER (WHERE t = label) AS tt FROM l, pairs GROUP BY 1),
      r AS (SELECT label, tt AS support, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS pr, CASE WHEN tt > 0 THEN tp / tt ELSE 0 END AS rc FROM c)
      SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall,
        round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM r"""),
    "confusion": _ver("""
      , l AS (SELECT DISTINCT unnest([t, p]) AS label FROM pairs)
      SELECT a.label AS "true", b.label AS predicted, count(pairs.run_id) AS count
      FROM l a CROSS JOIN l b LEFT JOIN pairs ON pairs.t = a.label AND pairs.p = b.label GROUP BY 1, 2"""),
    "half_split": f"""WITH {VERDICTS}, halves AS (SELECT *, ntile(2) OVER (ORDER BY md5('42:' || run_id)) AS half FROM pairs)"""
    + _KAPPA.format(by="half,", src="halves", group="GROUP BY half") + """
      , e AS (SELECT half, sum((tm.c / n.n) * (pm.c / n.n)) AS e FROM n JOIN tm USING (half) JOIN pm USING (half, label) GROUP BY half)
      SELECT half, n.n, n_agree, round(n_agree / n.n, 6) AS accuracy, round((n_agree / n.n - e) / (1 - e), 6) AS kappa FROM n JOIN e USING (half)""",
    "annotator_agreement": f"WITH {_LABELS}" + _KAPPA.format(by="", src="both_labels", group="") + """
      , e AS (SELECT sum((tm.c / n.n) * (pm.c / n.n)) AS e FROM n, tm JOIN pm USING (label)),
      k AS (SELECT n.n, n_agree, (n_agree / n.n - e) / (1 - e) AS k FROM n, e)
      SELECT n, n_agree, round(n_agree / n * 100, 1) AS percent, round(k, 4) AS kappa,
        CASE WHEN k >= 0.8 THEN 'Strong' WHEN k >= 0.6 THEN 'Moderate' WHEN k >= 0.4 THEN 'Fair' ELSE 'Poor' END AS band, n >= 5 AS enough_overlap FROM k""",
    "annotator_disagreements": f"""WITH {_LABELS} SELECT run_id, t AS "true", p AS predicted FROM both_labels WHERE t <> p""",
    "disagreement_pairs": _ver("""SELECT t AS "true", p AS predicted, count(*) AS count FROM pairs WHERE t <> p GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5"""),
    "label_queue": "SELECT doc_id AS run_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 10",
    "reliability_bins": f"""WITH {_BINS} SELECT bin, (bin::DOUBLE * 0.2::DOUBLE + (bin + 1)::DOUBLE * 0.2::DOUBLE) / 2 AS bin_mid, mean_confidence, accuracy, count,
        round(mean_confidence - accuracy, 4) AS gap, CASE WHEN mean_confidence - accuracy > 0.05 THEN '▲' WHEN mean_confidence - accuracy < -0.05 THEN '▼' ELSE '≈' END AS marker FROM bins""",
    "ece_mce": f"""WITH {_BINS} SELECT round((SELECT sum(abs(mean_confidence - accuracy) * count) FROM bins) / count(*), 4) AS ece,
        round((SELECT max(abs(mean_confidence - accuracy)) FROM bins), 4) AS mce, count(*) AS n FROM pairs""",
    "platt_fit": f"WITH {_PLATT} SELECT (SELECT count(*) FROM pairs) AS n, round(a, 6) AS a, round(b, 6) AS b FROM fit",
    "calibrated_confidence": f"WITH {_PLATT} SELECT run_id, confidence, round(1.0 / (1.0 + exp(-(a * confidence + b))), 6) AS calibrated FROM pairs, fit",
    "keyword_frequency": _keywords("documents"),
    "other_card_keywords": _card(
        ", texts AS (SELECT c.root_cause || coalesce((SELECT ' ' || string_agg(excerpt || CASE WHEN why <> '' THEN ' ' || why ELSE '' END, ' ' ORDER BY rank) "
        "FROM proof p WHERE p.run_id = c.run_id), '') AS text FROM full_card c WHERE primary_category = 'OTHER') " + _keywords("texts")),
    "gold_override": _ver("""SELECT run_id, primary_category, CASE WHEN rk % 4 = 0 THEN t ELSE primary_category END AS true_label FROM pairs"""),
    "class_distribution": f"WITH {_LABELLED} SELECT true_label, count(*) AS count FROM labelled GROUP BY 1",
    "rule_mining_cube": f"""WITH {_LABELLED}, flags AS (SELECT {_FLAG_VALUES}, true_label, count(*) AS n FROM labelled GROUP BY ALL),
      counted AS (SELECT m, {_FLAGS_OF_SET}, true_label, sum(n) AS n FROM flags, range({2 ** len(FLAGS)}) AS sets(m) GROUP BY ALL),
      best AS (SELECT m, {', '.join(FLAGS)}, arg_max(true_label, n) AS label, max(n) AS hits, sum(n) AS total FROM counted GROUP BY ALL)
      SELECT {', '.join(FLAGS)}, label, round(hits / total, 4) AS precision, CAST(total AS BIGINT) AS support
      FROM best WHERE hits / total >= 0.85 AND total >= 3""",
    "tfidf_terms": rf"""WITH words AS (
        SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS w
        FROM documents),
      held AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
      SELECT term, count(*) AS count, count(DISTINCT doc_id) AS document_count,
        round(ln((1 + (SELECT count(*) FROM words)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS weight
      FROM held GROUP BY term ORDER BY count DESC, term LIMIT 300""",
    "history_steps": f"WITH {HISTORY} " + _EMITTED.format(rid="'openhands-doc-' || doc_id"),
    "event_table_steps": f"WITH {SOURCE_HISTORY} " + _EMITTED.format(rid="'openhands-' || doc_id"),
    "history_runs": f"""WITH {HISTORY}, sizes AS (SELECT doc_id, count(*) AS c FROM emitted GROUP BY 1)
      SELECT 'openhands-doc-' || doc_id AS run_id, 'openhands' AS agent, 'doc-' || doc_id AS task_id, coalesce(c, 0) AS step_count,
        CASE WHEN doc_id % 2 = 0 THEN 'diff --git' END AS final_patch, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END AS resolved,
        coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END, false) AS passed
      FROM documents LEFT JOIN sizes USING (doc_id)""",
    "ingest_batch": """SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 3 = 2) AS written, count(*) FILTER (WHERE doc_id % 3 <> 2) AS skipped FROM documents""",
    "sdk_steps": f"WITH {SDK} " + _EMITTED.format(rid="CASE WHEN doc_id % 2 = 0 THEN 'sdk-doc-' || doc_id ELSE 'sdk-stem-' || doc_id END"),
    "action_list_steps": f"""WITH {ACTIONS} SELECT 'swe-agent-doc-' || doc_id AS run_id, i AS index,
        (['command', 'file_edit', 'file_read', 'command', 'finish', 'finish', 'unknown'])[kind + 1] AS action_type, a AS content,
        o <> '' AS has_obs, nullif(o, '') AS obs_content,
        CASE WHEN o = '' THEN NULL WHEN contains(o, 'exit code: 0') OR trim(o, {_SPACE}) = '' THEN 0 WHEN {_FAIL_MARKS} THEN 1 END AS exit_code FROM entries""",
    "action_list_runs": """SELECT 'swe-agent-doc-' || doc_id AS run_id, NULL::VARCHAR AS model, '' AS repo, 'No problem statement provided.' AS problem_statement,
        CASE WHEN doc_id % 5 = 0 THEN 'diff a' END AS final_patch, doc_id % 3 = 0 AND doc_id % 4 <> 0 AS resolved,
        CASE WHEN doc_id % 4 = 0 THEN 'exit_cost' ELSE 'submitted' END AS exit_status, CAST(doc_id AS VARCHAR) AS api_calls FROM documents""",
    "transcript_steps": f"WITH {TRANSCRIPTS} " + _TRANSCRIPT_STEPS.format(doc="doc-"),
    "transcript_line_steps": f"WITH {SOURCE_TRANSCRIPTS} " + _TRANSCRIPT_STEPS.format(doc=""),
    "session_summary_steps": f"""WITH {SUMMARIES} SELECT 'aider-doc-' || doc_id AS run_id, row_number() OVER (PARTITION BY doc_id ORDER BY stage, i) - 1 AS index,
        action_type, content, true AS has_obs, seen AS obs_content, code AS exit_code FROM items""",
    "session_summary_runs": f"""WITH {SUMMARIES} SELECT 'aider-doc-' || doc_id AS run_id, code = 0 AND NOT crashed AND edited AS resolved,
        CASE WHEN doc_id % 3 = 0 THEN 'diff --git' END AS final_patch, CASE WHEN crashed THEN 'crash ' || doc_id END AS error,
        CAST(code AS VARCHAR) AS exit_status, '0.25' AS cost FROM sessions""",
    "chat_steps": f"""WITH {CHATS} SELECT 'acr-doc-' || doc_id AS run_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1 AS index, action_type, content,
        seen IS NOT NULL AS has_obs, seen AS obs_content,
        CASE WHEN seen IS NULL THEN NULL WHEN regexp_matches(lower(seen), 'error|traceback|not found|failed') THEN 1 ELSE 0 END AS exit_code FROM all_steps""",
    "sdk_runs": f"""WITH {SDK}, sizes AS (SELECT doc_id, count(*) AS c FROM emitted GROUP BY 1)
      SELECT CASE WHEN doc_id % 2 = 0 THEN 'sdk-doc-' ELSE 'sdk-stem-' END || doc_id AS run_id, 'openhands' AS agent,
        CASE WHEN doc_id % 2 = 0 THEN 'doc-' ELSE 'stem-' END || doc_id AS task_id, coalesce(c, 0) AS step_count, false AS resolved
      FROM documents LEFT JOIN sizes USING (doc_id)""",
    "transcript_runs": f"""WITH {TRANSCRIPTS}, sizes AS (SELECT doc_id, count(*) AS c FROM made GROUP BY 1)
      SELECT 'aider-doc-' || doc_id AS run_id, 'aider' AS agent, 'doc-' || doc_id AS task_id, coalesce(c, 0) AS step_count, true AS resolved
      FROM documents LEFT JOIN sizes USING (doc_id)""",
    "chat_runs": f"""WITH {CHATS}, sizes AS (SELECT doc_id, count(*) AS c FROM all_steps GROUP BY 1)
      SELECT 'acr-doc-' || doc_id AS run_id, 'autocoderover' AS agent, 'doc-' || doc_id AS task_id, coalesce(c, 0) AS step_count,
        false AS resolved, 'diff' AS final_patch FROM documents LEFT JOIN sizes USING (doc_id)""",
    "all_formats": f"""SELECT agent, sum(runs) AS runs, sum(steps) AS steps, sum(failed) AS failed FROM (SELECT *, (SELECT count(*) FROM documents) AS runs FROM (
        SELECT 'openhands' AS agent, (WITH {HISTORY} SELECT count(*) FROM emitted) AS steps, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 1) AS failed
        UNION ALL SELECT 'openhands', (WITH {SDK} SELECT count(*) FROM emitted), (SELECT count(*) FROM documents)
        UNION ALL SELECT 'aider', (WITH {TRANSCRIPTS} SELECT count(*) FROM made), 0
        UNION ALL SELECT 'swe-agent', (WITH {ACTIONS} SELECT count(*) FROM entries), (SELECT count(*) FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 4 <> 0))
        UNION ALL SELECT 'aider', (WITH {SUMMARIES} SELECT count(*) FROM items), (WITH {SUMMARIES} SELECT count(*) FROM sessions WHERE NOT (code = 0 AND NOT crashed AND edited))
        UNION ALL SELECT 'autocoderover', (WITH {CHATS} SELECT count(*) FROM all_steps), (SELECT count(*) FROM documents))) GROUP BY agent""",
    "step_sessions": f"""WITH {RUNS}, marked AS (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM flagged),
      joined AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY ts, idx) AS session FROM marked),
      again AS (SELECT run_id, session, count(*) AS n FROM (
        SELECT run_id, session FROM joined WHERE action_type = 'command' GROUP BY run_id, session, content HAVING count(*) >= 3) GROUP BY ALL)
      SELECT run_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS step_count,
        count(*) FILTER (WHERE failed) AS n_failed_steps, count(*) FILTER (WHERE action_type = 'file_edit') AS n_edits,
        count(*) FILTER (WHERE action_type = 'command' AND {_re('content', TEST_COMMAND)}) AS n_tests,
        count(*) FILTER (WHERE action_type = 'finish') AS n_finish, max(idx) FILTER (WHERE action_type = 'file_edit') AS last_edit,
        count(DISTINCT path) FILTER (WHERE action_type = 'file_read') AS unique_files_opened, coalesce(max(again.n), 0) AS n_repeated_commands
      FROM joined LEFT JOIN again USING (run_id, session) GROUP BY run_id, session""",
    "tumbling_fingerprints": _sig(
        "SELECT strftime(s.ts, '%Y-%m-%d') AS day, f.code, count(*) AS count FROM fp f JOIN steps s ON s.run_id = f.run_id AND s.idx = f.step_index GROUP BY 1, 2"),
}
