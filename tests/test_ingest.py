import json

from pyspark.sql import functions as F

from revspark.operators.normalize import ai_findings, to_findings, validate_findings
from revspark.sources.github import decode_contents
from revspark.sources.reports import ingest_all, report_rejects
from revspark.sources.responses import parse_responses

RUFF = json.dumps([{"code": "E501", "message": "long", "location": {"row": 3, "column": 80},
                    "end_location": {"row": 3, "column": 99}, "fix": {"message": "wrap"}},
                   {"code": "F401", "message": "unused", "location": {}, "fix": None}])
PYLINT = json.dumps([{"message-id": "W0612", "message": "unused var", "line": 5, "column": 4,
                      "type": "warning", "symbol": "unused-variable"}])
BANDIT = json.dumps({"results": [{"test_id": "B105", "test_name": "hardcoded_password_string",
                                  "issue_text": "pw", "line_number": 9, "issue_severity": "LOW",
                                  "issue_confidence": "HIGH", "line_range": [9], "code": "pw = 'x'",
                                  "issue_cwe": {"id": 259, "link": "l"}}]})


def test_report_ingest_and_isolation(spark):
    reports = spark.createDataFrame(
        [(1, "a.py", "ruff", RUFF), (1, "a.py", "pylint", PYLINT), (1, "a.py", "bandit", BANDIT),
         (2, "b.py", "ruff", "{not json"), (2, "b.py", "bandit", "[1, 2]")],
        "review_id long, file_path string, tool string, report string")
    raw = ingest_all(reports)
    got = sorted((r.tool, r.item_ord, r.rule_code, r.line_number, r.column, r.tool_severity, r.suggestion)
                 for r in raw.collect())
    assert got == [("bandit", 1, "B105", 9, None, "LOW", ""),
                   ("pylint", 1, "W0612", 5, 4, "high", ""),
                   ("ruff", 1, "E501", 3, 80, "high", "wrap"),
                   ("ruff", 2, "F401", 1, 0, "critical", "")]
    rej = sorted((r.review_id, r.tool) for r in report_rejects(reports).collect())
    assert rej == [(2, "bandit"), (2, "ruff")]


def test_base64_contents(spark):
    import base64
    text = "def f():\n    return 'é'\n"
    b64 = base64.b64encode(text.encode()).decode()
    wrapped = "\n".join(b64[i:i + 10] for i in range(0, len(b64), 10))
    df = spark.createDataFrame([(b64, "base64"), (wrapped, None), ("/w==", "base64"), ("", "base64"),
                                ("plain", "utf-8")], "c string, e string")
    got = [r[0] for r in df.select(decode_contents(F.col("c"), F.col("e"))).collect()]
    assert got == [text, text, None, "", "plain"]


def test_parse_responses_shapes(spark):
    resp = ['[{"line_number": 2, "message": "m"}]', '```json\n[{"message": "x"}]\n```', '{"message": "obj"}',
            'not json', None, '   ', '[]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(resp)], "prompt_key long, response string")
    got = sorted((r.prompt_key, r.item_ord) for r in parse_responses(df).collect())
    assert got == [(0, 1), (1, 1)]


def test_ai_items_defaults_and_batch_rule(spark):
    resp = spark.createDataFrame([
        (1, "a.py", '[{"message": "m1"}, {"line_number": "4", "severity": "HIGH", "category": "XSS", "message": "m2"}]'),
        (2, "b.py", '[{"message": "ok"}, {"line_number": 0, "message": "bad"}]'),
        (3, "c.py", '[{"message": "ok"}, {"message": "m", "severity": null}]'),
        (4, "d.py", '[{"message": "ok", "owasp_category": ""}, {"message": "f", "line_number": 2.5}]'),
    ], "review_id long, file_path string, response string")
    f = ai_findings(resp, "SecurityAgent", 1, 9)
    got = sorted((r.review_id, r.item_ord, r.line_number, r.severity, r.category, r.owasp_category, float(r.confidence))
                 for r in f.collect())
    assert got == [(1, 1, 1, "high", "injection", "A03:2021-Injection", 0.7),
                   (1, 2, 4, "high", "xss", "A03:2021-Injection", 0.7)]


def test_normalise_and_validate(spark):
    df = spark.createDataFrame([(1, "a.py", 1, 5, 3, "HIGH", "Style", "m", "0.5"),
                                (1, "a.py", 2, 0, None, "weird", "nope", "", "1.5")],
                               "review_id long, file_path string, item_ord long, line_number int, end_line_number int, "
                               "severity string, category string, message string, confidence string")
    f = to_findings(df, "QualityAgent", 0, 0)
    r = sorted((x.item_ord, x.severity, x.category, x.end_line_number) for x in f.collect())
    assert r == [(1, "high", "style", 5), (2, "medium", "other", None)]
    ok, rej = validate_findings(f)
    assert ok.count() == 1 and [x.reason for x in rej.collect()] == ["line_number < 1"]


def test_read_files_directory(spark, tmp_path):
    from revspark.sources.files import read_files
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\ndef f():\n    return 1\n")
    (tmp_path / "b.js").write_text("function f() { let x = 1 }\n")
    got = {r.file_path.rsplit("/", 1)[-1]: (r.language, r.code) for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.py"] == ("python", "import os\ndef f():\n    return 1\n")
    assert got["b.js"][0] == "javascript"


def test_review_store_latest_wins_and_lookup(spark):
    import datetime as dt

    from revspark.session import shared_path
    from revspark.sources.store import get_review, read_reviews, write_reviews
    path = shared_path(spark, "test-store")
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    write_reviews(spark.createDataFrame([(1, 90.0, t0), (2, 80.0, t0)], "review_id long, overall_score double, ts timestamp"),
                  path, write_id=0)
    write_reviews(spark.createDataFrame([(2, 70.0, t1)], "review_id long, overall_score double, ts timestamp"),
                  path, write_id=1)
    assert sorted((r.review_id, r.overall_score) for r in read_reviews(spark, path).collect()) == [(1, 90.0), (2, 70.0)]
    assert [r.overall_score for r in get_review(spark, path, 2).collect()] == [70.0]
    assert get_review(spark, path, 3).count() == 0


def test_ai_items_keep_bad_reports_validity(spark):
    resp = spark.createDataFrame([(1, "a.py", '[{"message": "ok"}, {"line_number": 0, "message": "bad"}]'),
                                  (2, "b.py", '[{"message": "fine"}]')],
                                 "review_id long, file_path string, response string")
    rows = sorted((r.review_id, r.item_ord, r.batch_ok, r.item_ok)
                  for r in ai_findings(resp, "QualityAgent", 0, 9, keep_bad=True).collect())
    assert rows == [(1, 1, False, True), (1, 2, False, False), (2, 1, True, True)]


def test_comment_rows_with_ranked_findings(spark):
    from revspark.sources.github import comment_rows
    rows = [(7, f, r, "low", "style", f"m{f}{r}", "", None) for f in (2, 1) for r in range(1, 16)]
    df = spark.createDataFrame(rows, "pr_key long, file_ord long, rank int, severity string, category string, "
                                     "message string, suggestion string, rule_id string")
    got = [(r.file_ord, r.rank) for r in comment_rows(df, 20).orderBy("comment_ord").collect()]
    assert got == [(1, r) for r in range(1, 16)] + [(2, r) for r in range(1, 6)]
