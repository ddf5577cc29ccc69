"""File reviewers in child processes: what hangs, ends or takes too much memory costs one error row."""

import os
import time

from revspark.operators.isolation import Child
from revspark.operators.reviewers import FileReviewer, ReviewerSet, ReviewInputs, run_isolated
from revspark.plans.review import review_files


def _reviewer():
    def odd(path, code):
        match code:
            case "hang":
                time.sleep(600)
            case "exit":
                os._exit(7)
            case "leave":
                raise SystemExit("done")
            case "grow":
                return [b"x" * 2**33]
            case "raise":
                raise ValueError("no")
            case "wrong":
                return [lambda: 0]
        return [dict(line_number=1, severity="low", category="style", message=f"{code} {os.getpid()}", confidence=0.5)]

    return odd  # of a function, so that workers need not import this module


odd = _reviewer()


def test_child_survives_what_its_calls_do():
    child = Child(odd, seconds=1, memory_mb=1024)
    first = child.call("a", "ok")[0][0]["message"]
    assert first != f"ok {os.getpid()}" and child.call("a", "ok")[0][0]["message"] == first  # one process for all
    assert child.call("a", "raise") == (None, "ValueError: no")
    assert child.call("a", "leave") == (None, "SystemExit: done")
    assert child.call("a", "grow")[1].startswith("MemoryError")
    assert child.call("a", "wrong")[0] is None
    assert child.call("a", "ok")[0][0]["message"] == first
    assert child.call("a", "exit") == (None, "ChildProcessError: process ended with code 7")
    second = child.call("a", "ok")[0][0]["message"]
    pid = int(second.split()[1])
    assert second != first
    began = time.time()
    assert child.call("a", "hang") == (None, "TimeoutError: no answer within 1 s") and time.time() - began < 10
    assert not os.path.exists(f"/proc/{pid}") and child.call("a", "x" * 5_000_000)[1] is None
    child.close()
    assert child.process is None


def test_reviewer_that_hangs_or_exits_costs_one_error_row(spark):
    codes = ["ok", "hang", "ok", "exit", "grow", "raise", "ok", None, "exit", "ok"]
    files = spark.createDataFrame([(k, f"f{k}.py", c, "python") for k, c in enumerate(codes)],
                                  "review_id long, file_path string, code string, language string").coalesce(1)
    limited = ReviewerSet([FileReviewer("Odd", "", odd, seconds=2, memory_mb=2048)])
    run = run_isolated(ReviewInputs(files=files), limited)
    errors = {r["review_id"]: r["reason"].split(":")[0] for r in run.file_errors.collect()}
    assert errors == {1: "TimeoutError", 3: "ChildProcessError", 4: "MemoryError", 5: "ValueError", 8: "ChildProcessError"}
    assert sorted(r["review_id"] for r in run.findings.collect()) == [0, 2, 6, 7, 9]
    out = review_files(ReviewInputs(files=files.where("code = 'ok' or code = 'exit'")), limited)
    assert {r["review_id"]: r["status"] for r in out.file_reviews.collect()} == {
        0: "completed", 2: "completed", 3: "failed", 6: "completed", 8: "failed", 9: "completed"}


def test_no_rows_start_no_process(spark):
    files = spark.createDataFrame([], "review_id long, file_path string, code string")
    run = run_isolated(ReviewInputs(files=files), ReviewerSet([FileReviewer("Odd", "", odd, seconds=2)]))
    assert run.findings.collect() == [] and run.file_errors.collect() == []
