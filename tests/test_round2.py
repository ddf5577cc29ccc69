"""Inputs that come in parts, repeated keys, rejected findings, the review store, failing reviewers."""
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revspark.operators.enrich import enrich
from revspark.operators.normalize import ai_findings
from revspark.operators.reviewers import Reviewer, ReviewerSet, ReviewInputs, rule_scan, run_reviewers, scan_findings
from revspark.plans.pr import attach_contents, file_key, from_file_key, review_prs
from revspark.plans.review import review_files
from revspark.session import shared_path
from revspark.sources.github import ingest_pr_comments, ingest_prs
from revspark.sources.reports import ingest_all
from revspark.sources.store import get_review, read_findings, store_review

CODE = "def f(a, b, c, d):\n    return a\n"


def test_file_lists_and_comments_in_parts(spark):
    names = [f"f{k}.py" for k in range(7)]
    rows = [(1, p, json.dumps([{"filename": n} for n in names[3 * p:3 * p + 3]])) for p in (2, 0, 1)] + [(2, 0, "null")]
    prs = spark.createDataFrame([(1, 1, "{}"), (2, 2, "{}")], "pr_key long, pr_number int, json string")
    _, files = ingest_prs(prs, spark.createDataFrame(rows, "pr_key long, part int, json string"))
    assert sorted((r.pr_key, r.file_ord, r.filename) for r in files.collect()) == [(1, k + 1, n) for k, n in enumerate(names)]
    rows = [(1, p, json.dumps([{"id": 10 * p + k} for k in range(2)])) for p in (1, 0)]
    got = ingest_pr_comments(spark.createDataFrame(rows, "pr_key long, part int, json string")).collect()
    assert sorted((r.comment_ord, r.comment_id) for r in got) == [(1, 0), (2, 1), (3, 10), (4, 11)]


def test_files_of_a_long_list_stay_with_their_pr(spark):
    """Two eligible files of one PR in two parts, none of the next; keys beyond 2 ** 53."""
    big = 2 ** 60 + 1
    prs_json = spark.createDataFrame([(k, 1, json.dumps({"number": 1, "head": {"sha": "s"}})) for k in (big, big + 1)],
                                     "pr_key long, pr_number int, json string")
    parts = spark.createDataFrame([(big, 0, json.dumps([{"filename": "a.py"}])), (big, 1, json.dumps([{"filename": "b.py"}])),
                                   (big + 1, 0, json.dumps([{"filename": "c.txt"}]))], "pr_key long, part int, json string")
    prs, files = ingest_prs(prs_json, parts)
    prs = prs.withColumn("repo", F.lit("o/r")).withColumn("post_review", F.lit(True))
    contents = spark.createDataFrame([("o/r", "a.py", "s", CODE), ("o/r", "b.py", "s", CODE), ("o/r", "b.py", "s", CODE)],
                                     "repo string, path string, ref string, code string")
    requests = spark.createDataFrame([(big, "o", "r", 1), (big + 1, "o", "r", 1)],
                                     "pr_key long, repo_owner string, repo_name string, pr_number int")
    assert attach_contents(files, prs, contents).count() == 2  # a text stored twice counts once
    out = review_prs(requests, prs, files, contents)
    got = {r.pr_key: (r.files_analyzed, r.n_findings) for r in out.rollup.collect()}
    assert got == {big: (2, 2), big + 1: (0, 0)}
    assert sorted((r.pr_key, r.file_ord) for r in out.findings.collect()) == [(big, 1), (big, 2)]


def test_file_keys_are_exact(spark):
    rows = [(2 ** 62 + 1, 5_000_000_000), (-3, 1), (0, 0)]
    df = spark.createDataFrame(rows, "pr_key long, file_ord long").select(file_key().alias("review_id"))
    assert sorted((r.pr_key, r.file_ord) for r in from_file_key(df).collect()) == sorted(rows)


def test_reports_in_parts_and_numbers_as_text(spark):
    item = lambda k: {"code": "E501", "message": f"m{k}", "location": {"row": str(k), "column": 2}}
    bandit = lambda k: {"test_id": "B105", "issue_text": f"b{k}", "line_number": str(k)}
    rows = [(1, "a.py", "ruff", 1, json.dumps([item(7)])), (1, "a.py", "ruff", 0, json.dumps([item(5), item(6)])),
            (1, "a.py", "bandit", 1, json.dumps({"results": [bandit(3)]})), (1, "a.py", "bandit", 0, json.dumps({"results": [bandit(2)]}))]
    got = ingest_all(spark.createDataFrame(rows, "review_id long, file_path string, tool string, part int, report string")).collect()
    assert sorted((r.tool, r.item_ord, r.line_number) for r in got) == [("bandit", 1, 2), ("bandit", 2, 3), ("ruff", 1, 5), ("ruff", 2, 6), ("ruff", 3, 7)]


def test_a_bad_item_drops_every_part_of_its_call(spark):
    good, bad = {"message": "m", "line_number": 2}, {"message": "", "line_number": 2}
    rows = [(1, "a.py", 0, [good, good]), (1, "a.py", 1, [good]), (2, "b.py", 0, [good]), (2, "b.py", 1, [bad])]
    df = spark.createDataFrame([(i, f, p, json.dumps(x)) for i, f, p, x in rows], "review_id long, file_path string, part int, response string")
    assert sorted((r.review_id, r.item_ord) for r in ai_findings(df, "QualityAgent", 0, 9).collect()) == [(1, 1), (1, 2), (1, 3)]


RULES = [("END", r"bar$", "style", "low", None, "0.50"), ("FLAG", r"(?i)^import", "style", "low", None, "0.50"),
         ("ALT", r"^zzz|^import", "style", "low", None, "0.50")]


def test_rule_scan_of_anchors_flags_and_alternatives(spark):
    files = spark.createDataFrame([(1, "a.py", "x\nfoo bar\nimport os\n"), (2, "b.py", "IMPORT x\n")], "review_id long, file_path string, code string")
    hits = rule_scan(files, RULES)
    assert sorted((r.review_id, r.line_number, r.rule_id) for r in hits.collect()) == [(1, 2, "END"), (1, 3, "ALT"), (1, 3, "FLAG"), (2, 1, "FLAG")]
    many = [(f"R{k}", "^x$", "style", "low", None, "0.50") for k in range(150)]
    orders = [r.item_ord for r in scan_findings(rule_scan(files, many)).collect()]
    assert len(set(orders)) == 150


def test_repeated_answers_keep_one_row_each(spark):
    f = spark.createDataFrame([(1, "a.py", "QualityAgent", "old", "k"), (1, "a.py", "QualityAgent", "old", "q"), (2, "b.py", "QualityAgent", "old", "k"),
                               (2, "b.py", "QualityAgent", "old", "e")], "review_id long, file_path string, agent_name string, suggestion string, prompt_key string")
    r = spark.createDataFrame([("k", "first", False, 1), ("k", "second", False, 2), ("e", None, True, 1)], "prompt_key string, response string, error boolean, ts long")
    got = sorted((x.review_id, x.prompt_key, x.suggestion) for x in enrich(f, r, None).collect())
    assert got == [(1, "k", "second"), (1, "q", "old"), (2, "e", "old"), (2, "k", "old")]


def custom(rows):
    def fn(inputs, agent_ord):
        return inputs.files.sparkSession.createDataFrame(rows, "review_id long, file_path string, line_number int, severity string, category string, "
                                                               "message string, confidence double")
    return Reviewer("Own", "test", fn)


def test_findings_and_rejects_partition_the_input(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1\n"), (2, "b.py", "y = 2\n")], "review_id long, file_path string, code string")
    rs = ReviewerSet()
    for name in list(rs.names()):
        rs.remove(name)
    rs.add(custom([(1, "a.py", 1, "low", "style", "fine", 0.5), (1, "a.py", 1, "low", "style", "too sure", 12.5), (1, "a.py", 0, "low", "style", "line", 0.5),
                   (1, "a.py", 1, "low", "style", "", 0.5)]))
    out = review_files(ReviewInputs(files=files), rs)
    assert [r.message for r in out.findings.collect()] == ["fine"]
    assert sorted((r.message, r.reason) for r in out.rejects.collect()) == [
        ("", "message empty"), ("line", "line_number < 1"), ("too sure", "confidence outside 0..1")]
    assert {r.file_path: r.n_findings for r in out.file_reviews.collect()} == {"a.py": 1, "b.py": 0}
    assert [r["rank"] for r in out.ranked().collect()] == [1]


def test_spark_errors_are_no_reviewers_failure(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1\n")], "review_id long, file_path string, code string")

    def broken(inputs, agent_ord):
        raise ValueError("no plan")

    def job(inputs, agent_ord):
        inputs.files.select(F.raise_error(F.lit("infrastructure"))).collect()

    rs = ReviewerSet()
    rs.add(Reviewer("Broken", "", broken))
    findings, failures = run_reviewers(ReviewInputs(files=files), rs)
    assert [f[0] for f in failures] == ["Broken"] and findings.columns
    rs.add(Reviewer("Job", "", job))
    with pytest.raises(PySparkException):
        run_reviewers(ReviewInputs(files=files), rs)


def test_store_keeps_files_and_findings(spark):
    files = spark.createDataFrame([(1, "tests/test_a.py", "x = 1\n"), (1, "src/b.py", CODE)], "review_id long, file_path string, code string")
    out = review_files(ReviewInputs(files=files))
    path = shared_path(spark, "store")
    for day in (1, 2):
        reviews = out.file_reviews.withColumn("ts", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
        findings = out.findings if day == 1 else out.findings.where("file_path = 'src/b.py'")
        store_review(reviews, findings, path, day)
    got = get_review(spark, path, 1).collect()
    assert sorted((r.file_path, r.write_id) for r in got) == [("src/b.py", 2), ("tests/test_a.py", 2)]
    assert [(r.file_path, r.write_id) for r in read_findings(spark, path, 1).collect()] == [("src/b.py", 2)]
    assert get_review(spark, path, 9).collect() == []


def test_zero_filled_severities_of_clean_reviews(spark):
    from revspark.operators.aggregates import by_severity
    findings = spark.createDataFrame([(1, "low"), (1, "low")], "review_id long, severity string")
    reviews = spark.createDataFrame([(1,), (2,), (2,)], "review_id long")
    got = {(r.review_id, r.severity): r.n for r in by_severity(findings, reviews=reviews).collect()}
    assert len(got) == 10 and got[(1, "low")] == 2 and sum(got.values()) == 2


def test_limits_are_reached(spark):
    from revspark.operators.dedup import top_findings
    from revspark.sources.github import comment_rows
    rows = [(1, "a.py", k % 5, k, "high", "style", f"m{k}", "", None, 0, 0, k, 7, 1 + k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "review_id long, file_path string, severity_rank int, line_number int, severity string, category string, message string, "
                                     "suggestion string, rule_id string, pos_agent_ord int, pos_source_ord int, pos_item_ord long, pr_key long, file_ord long")
    top = top_findings(df, 10).collect()
    best = sorted(range(60), key=lambda k: (k % 5, k))[:10]
    assert top[0].n_top == 10 and top[0].top_lines == "\n".join(f"- [high] m{k}" for k in best)
    got = comment_rows(df, 20).orderBy("comment_ord").collect()
    assert [r.message for r in got] == [f"m{k}" for k in sorted((k for k in range(60) if k % 3 == 0), key=lambda k: (k % 5, k))]
