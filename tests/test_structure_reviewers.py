from pyspark.sql import functions as F

from revspark.operators.reviewers import (Reviewer, ReviewerSet, ReviewInputs, is_test_file, quality_reviewer,
                                          run_reviewers, security_reviewer,
                                          testing_findings as run_testing_rules)
from revspark.operators.structure import elements_of, extract_elements

PLAIN = """import os

class Greeter:
    def __init__(self, name):
        self.name = name

    async def greet(self):
        for i in range(3):
            print(i)
        return self.name

def add(a, b, c, d, e):
    if a and b or c:
        return a
    elif d:
        pass
    try:
        x = 1
    except ValueError:
        pass
    while e:
        e -= 1
    return b
"""

TEST_SRC = """def helper():
    return 1

class TestThing:
    def check(self):
        x = 1
"""


def test_elements_closed_form():
    el = elements_of(PLAIN)
    fns = {(e[1], e[2]): e for e in el if e[1] in ("function", "async_function")}
    add = fns[("function", "add")]
    assert add[5] == 5 and add[6] == "a,b,c,d,e" and add[7] is True
    # 1 + if + elif(if) + 2 (a and b or c) + except + while
    assert add[9] == 7
    assert fns[("async_function", "greet")][9] == 2
    kinds = [e[1] for e in el]
    assert kinds.count("loop") == 2 and kinds.count("conditional") == 2 and "error_handling" in kinds
    assert [e[2] for e in el if e[1] == "method"] == ["__init__", "greet"]
    assert elements_of("def broken(")[0][1:3] == ("parse_error", "SyntaxError")
    assert elements_of("x = '\x00'")[0][1] == "parse_error"


def test_is_test_file_patterns(spark):
    paths = ["test_a.py", "a_test.py", "tests/x.py", "test/x.py", "a_spec.py", "latest_foo.py", "main.py",
             "test_a.js", "src/contest.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(is_test_file(F.col("p"))).collect()] == \
        [True, True, True, True, True, True, False, False, False]


def test_testing_rules(spark):
    files = spark.createDataFrame([(1, "src/mod.py", PLAIN), (2, "tests/test_thing.py", TEST_SRC),
                                   (3, "src/broken.py", "def broken("), (4, "tests/test_ok.py", "import pytest\n")],
                                  "review_id long, file_path string, code string")
    f = run_testing_rules(files, extract_elements(files))
    got = sorted((r.review_id, r.source_ord, r.line_number, r.severity, r.category) for r in f.collect())
    assert got == sorted([
        (1, 0, 12, "medium", "low_coverage"),     # add: complexity 7
        (1, 0, 12, "low", "missing_test"),        # add: 5 args
        (1, 2, 1, "low", "edge_case"),            # error handling
        (1, 3, 8, "info", "edge_case"),           # for
        (1, 3, 21, "info", "edge_case"),          # while
        (2, 4, 1, "high", "test_quality"),        # no assert / pytest
        (2, 5, 1, "medium", "test_quality"),      # helper/check but no test_ function
    ])


def test_reviewer_set_and_isolation(spark):
    rs = ReviewerSet()
    assert rs.names() == ["QualityAgent", "SecurityAgent", "TestingAgent"]
    assert rs.remove("SecurityAgent") is True and rs.remove("Nope") is False

    def boom(inputs, agent_ord):
        raise RuntimeError("down")

    def custom(inputs, agent_ord):
        return inputs.files.select("review_id", "file_path", F.lit(1).alias("line_number"),
                                   F.lit("LOW").alias("severity"), F.lit("Style").alias("category"),
                                   F.lit("custom").alias("message"), F.lit(0.5).alias("confidence"))

    rs.add(Reviewer("Boom", "fails", boom))
    rs.add(Reviewer("Custom", "one per file", custom))
    files = spark.createDataFrame([(1, "tests/test_x.py", "x = 1\n")], "review_id long, file_path string, code string")
    f, failures = run_reviewers(ReviewInputs(files=files), rs)
    assert [n for n, _ in failures] == ["Boom"]
    got = sorted((r.agent_name, r.agent_ord, r.severity, r.category) for r in f.collect())
    assert got == [("Custom", 3, "low", "style"), ("TestingAgent", 1, "high", "test_quality")]
    assert ReviewerSet([]).names() == ["QualityAgent", "SecurityAgent", "TestingAgent"]


def test_reviewers_enrich_from_stored_answers(spark):
    """J1/J2 through the reviewers: answers are looked up by the finding's prompt key."""
    import json

    from revspark.operators.enrich import with_context
    from revspark.operators.normalize import quality_findings
    from revspark.operators.prompts import finding_prompts
    from revspark.sources.reports import ingest_all
    code = "import os\nx = 1\n" + "y = 2\n" * 5
    files = spark.createDataFrame([(1, "a.py", code)], "review_id long, file_path string, code string")
    ruff = json.dumps([{"code": "E501", "message": "long", "location": {"row": 2, "column": 1}},
                       {"code": "F401", "message": "unused", "location": {"row": 1, "column": 1},
                        "fix": {"message": "remove it"}}])
    bandit = json.dumps({"results": [{"test_id": "B105", "issue_text": "pw", "line_number": 2}]})
    raw = ingest_all(spark.createDataFrame([(1, "a.py", "ruff", ruff), (1, "a.py", "bandit", bandit)],
                                           "review_id long, file_path string, tool string, report string"))
    # stored answer for the E501 finding only (keyed exactly as the reviewer keys it)
    keyed = finding_prompts(with_context(quality_findings(raw), files, 5, "colon"), "suggestion")
    answers = keyed.filter(F.col("rule_id") == "ruff:E501").select(
        "prompt_key", F.lit("Wrap the line").alias("response"), F.lit(False).alias("error"))
    rs = ReviewerSet([Reviewer("QualityAgent", "", quality_reviewer),
                      Reviewer("SecurityAgent", "", security_reviewer)])
    f, failures = run_reviewers(ReviewInputs(files=files, raw_findings=raw, suggestions=answers), rs)
    assert failures == []
    got = {r.rule_id: r.suggestion for r in f.collect()}
    assert got == {"ruff:E501": "Wrap the line", "ruff:F401": "remove it",
                   "bandit:B105": "Review and fix this security vulnerability."}


def test_review_files_with_persisted_findings(spark):
    from revspark.plans.review import review_files
    files = spark.createDataFrame([(1, "src/a.py", "def f(a, b, c, d):\n    return a\n"),
                                   (2, "tests/test_b.py", "x = 1\n"), (3, "src/c.py", "pass\n")],
                                  "review_id long, file_path string, code string")
    out = review_files(ReviewInputs(files=files), persist=True)
    got = {r.review_id: (r.total_lines, r.n_findings, r.overall_score) for r in out.file_reviews.collect()}
    assert got == {1: (2, 1, 99.3), 2: (1, 1, 93.2), 3: (1, 0, 100.0)}
    summ = {r.review_id: dict(r.agent_summaries) for r in out.reviews.collect()}
    assert summ[3] == {"QualityAgent": "No issues found", "SecurityAgent": "No issues found",
                       "TestingAgent": "No issues found"}
    assert summ[2]["TestingAgent"] == "Found 1 high severity issues"
