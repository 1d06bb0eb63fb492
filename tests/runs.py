"""Small hand-written runs, as plain documents."""


def step(index, action, content, seen=None, code=None):
    observation = None if seen is None else {"content": seen, "exit_code": code, "truncated": False, "extra": {}}
    return {"index": index, "action_type": action, "content": content, "observation": observation}


def run(run_id, steps, patch=None, passed=False, error=None, resolved=False, **task):
    return {
        "run_id": run_id, "agent": "agent", "model": "m1",
        "task": {"task_id": f"t-{run_id}", "source": "test", "problem_statement": "Fix it.", **task},
        "steps": [step(i, *s) for i, s in enumerate(steps)], "final_patch": patch,
        "test_result": None if passed is None else {"passed": passed, "raw_log": ""}, "resolved": resolved, "error": error,
        "metadata": {},
    }


LOOK = ("command", "ls -la", "files", 0)

# (run, the rule that should decide it, its category)
CASES = [
    (run("gutted", [("file_edit", "edit a.py", "ok", 0)], patch="diff" + "\n-x" * 12 + "\n+y"), "E1", "TOOL_USE"),
    (run("throttled", [LOOK, ("model_call", "plan", "Error 429: slow down", 1), ("command", "x", "read timed out", 2)]), "E2", "INFRA_ERROR"),
    (run("capped", [LOOK, ("command", "go", "Reached the limit of steps", 1)]), "E3", "RESOURCE_LIMIT"),
    (run("malformed", [("file_edit", "edit a.py", "malformed patch at line 3", 1)]), "E4", "TOOL_USE"),
    (run("wrong-path", [LOOK, LOOK, ("command", "cat /repo/x", "cat: No such file or directory", 1)]), "E5", "TOOL_USE"),
    (run("no-runner", [("file_edit", "edit a.py", "ok", 0), ("command", "python t.py", "sh: python: command not found", 127)], patch="diff\n+y"), "E6", "VERIFICATION"),
    (run("untouched", [LOOK, ("command", "python runtests.py app", "OK", 0)]), "E7", "VERIFICATION"),
    (run("stalled", [LOOK] * 12), "E8", "IMPLEMENTATION_STALL"),
    (run("broken-env", [("command", "pytest", "ImportError: nope", 1), ("file_edit", "edit a.py", "ok", 0)]), "E9", "ENVIRONMENT"),
    (run("wrong-logic", [("file_edit", "edit src/a.py", "ok", 0), ("command", "pytest", "AssertionError: 1 failed", 1)], patch="diff\n+y"), "E10", "REASONING"),
    (run("narrow", [("file_read", "open src/a.py", "text", 0)] * 21, patch="diff\n+y"), "E11", "CONTEXT_RETRIEVAL"),
    (run("nuanced", [("file_read", "a.py", "text", 0), ("file_edit", "tweak", "ok", 0), ("finish", "done")], patch="diff\n+y"), None, None),
    (run("crash-only", [LOOK, ("error", "maximum iterations reached")]), None, None),
]
