"""What one step shows, as SQL expression text over the names of its fields.

The same expressions serve a steps table (plain columns) and steps nested in a run (fields of a lambda
variable), so both forms of signal extraction read a step alike.
"""

from __future__ import annotations

from faultline.functions.sqltext import array_of, matches, regex, strip
from faultline.taxonomy import FINGERPRINTS, LABELS

# The patterns that recognise paths, test commands and test verdicts.
FILE_PATH = r"(?:^|\s)([a-zA-Z0-9_./-]+\.[a-zA-Z]{1,6})(?:\s|$|:)"
TEST_COMMAND = r"\b(pytest|tox|unittest|python -m pytest|npm test|go test|nose)\b"
RUNTESTS_COMMAND = r"\bruntest(s)?\b"
TEST_PASS = r"\b(\d+) passed\b|all tests passed|OK\b"
TEST_FAIL = r"\b(\d+) failed\b|\b(\d+) error(s)?\b|FAILED\b"
ASSERTION = r"assertionerror|assert .*==|expected .* but got"

# The columns of a steps table, as arguments of ``failed``.
STEP_COLUMNS = ("action_type", "has_obs", "exit_code")


def failed(action: str, has_observation: str, exit_code: str) -> str:
    """The environment rejected the step. Without an observation there is no rejection, error or not."""
    return f"({has_observation} AND (coalesce({exit_code} <> 0, false) OR {action} = 'error'))"


def fingerprint(observation: str, step_failed: str = "true") -> str:
    """Position of the first error pattern found in a failed step's observation, else null."""
    cases = " ".join(f"WHEN {observation} RLIKE {regex(p)} THEN {i}" for i, (p, _, _) in enumerate(FINGERPRINTS))
    return f"CASE WHEN {step_failed} THEN CASE {cases} END END"


def code_of(fingerprint_id: str) -> str:
    return f"{array_of([code for _, code, _ in FINGERPRINTS])}[{fingerprint_id}]"


def label_of(fingerprint_id: str) -> str:
    return f"{array_of(LABELS)}[{fingerprint_id}]"


def touched_path(content: str) -> str:
    """First token of the content that looks like a file path, else null."""
    return f"nullif(regexp_extract({content}, {regex(FILE_PATH, ignore_case=False)}, 1), '')"


def edited_path(action: str, content: str) -> str:
    return f"CASE WHEN {action} = 'file_edit' THEN {touched_path(content)} END"


def opened_path(action: str, content: str) -> str:
    return f"CASE WHEN {action} = 'file_read' THEN {touched_path(content)} END"


def command_text(action: str, content: str) -> str:
    return f"CASE WHEN {action} = 'command' THEN {strip(content)} END"


def runs_tests(action: str, content: str) -> str:
    return f"({action} = 'command' AND {matches(content, TEST_COMMAND)})"


def runs_test_harness(action: str, content: str) -> str:
    return f"({action} = 'command' AND {matches(content, RUNTESTS_COMMAND)})"


def harness_ok(is_harness: str, has_observation: str, exit_code: str) -> str:
    """1 or 0 for a run of the test harness by its exit code, null for other steps."""
    return f"CASE WHEN {is_harness} THEN CAST({has_observation} AND coalesce({exit_code} = 0, false) AS INT) END"


def test_verdict(is_test: str, observation: str) -> str:
    """1 passed, 0 failed, null undecided; a failure mark beats a pass mark."""
    return (
        f"CASE WHEN {is_test} THEN CASE WHEN {matches(observation, TEST_FAIL)} THEN 0 "
        f"WHEN {matches(observation, TEST_PASS)} THEN 1 END END"
    )


def assertion_failure(step_failed: str, observation: str) -> str:
    return f"({step_failed} AND {matches(observation, ASSERTION)})"
