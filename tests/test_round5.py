"""The PR review reads its texts, findings and payloads once, in generated code."""

import ast
import base64
import gc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revspark.functions.text import where_computed
from revspark.operators import reviewers
from revspark.operators.reviewers import RULE_KINDS, is_test_file
from revspark.operators.structure import elements_of, extract_elements
from revspark.sources.github import decode_contents, review_payloads

CODE = """class A:
    async def m(self, a, b=1, *c):
        for i in a[1:2], *c:
            global x, y
            x: int = i or b and None
        try:
            return [k for k in c if k]
        except ValueError as e:
            pass
"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_are_told_in_generated_code(spark):
    """a higher-order function had six candidates built for every element, each with its match of the path."""
    files = spark.createDataFrame([("1/1", "src/a.py", CODE), ("1/2", "tests/a.py", "def helper(a, b, c, d):\n    return a\n"),
                                   ("1/3", "b.py", "def f(a, b, c, d):\n" + "    if a: pass\n" * 5)],
                                  "review_id string, file_path string, code string")
    df = reviewers.testing_findings(None, extract_elements(files, kinds=RULE_KINDS))
    got = sorted((r.review_id, r.source_ord, r.item_ord, r.line_number, r.severity, r.category, r.message) for r in df.collect())
    assert [g[:6] for g in got] == [
        ("1/1", 2, 0, 1, "low", "edge_case"), ("1/1", 3, 4, 3, "info", "edge_case"),
        ("1/2", 4, 0, 1, "high", "test_quality"), ("1/2", 5, 0, 1, "medium", "test_quality"),
        ("1/3", 0, 2, 1, "medium", "low_coverage"), ("1/3", 0, 3, 1, "low", "missing_test")]
    assert got[4][6] == "Function 'f' has high complexity (6) and should have comprehensive tests"
    assert got[5][6] == "Function 'f' has 4 arguments - ensure all parameter combinations are tested"
    assert "lambdafunction" not in plan(df)


def test_paths_of_tests(spark):
    paths = ["test_a.py", "a_test.py", "tests/x.py", "src/b_spec.py", "a_test.pyc", "contest/a.py", "src/a.py", "x\n_test.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    told = {r.p: r.t for r in df.select("p", is_test_file(F.col("p")).alias("t")).collect()}
    assert told == dict(zip(paths, [True, True, True, True, False, True, False, True]))


def test_a_value_is_kept_or_left_in_generated_code(spark):
    df = where_computed(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), F.col("v").isNotNull())
    assert [r.k for r in df.collect()] == [1] and "lambdafunction" not in plan(df)


@pytest.mark.parametrize("code", [CODE, "x", "match x:\n  case {'a': 1, **k}: pass\n", "type X[T] = int\nwith a as b, c: del x\n"])
def test_nodes_keep_the_numbers_of_a_walk(code):
    """nodes that say nothing are numbered, but no longer visited."""
    tree = ast.parse(code)
    numbers = {id(n): i for i, n in enumerate(ast.walk(tree))}
    want = sorted(numbers[id(n)] for n in ast.walk(tree) if isinstance(
        n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.For, ast.While, ast.If, ast.Try, ast.ExceptHandler, ast.ClassDef)))
    told = elements_of(code)
    assert sorted(r[0] for r in told if r[1] not in ("file", "method")) == want
    assert [r for r in elements_of(code, frozenset(RULE_KINDS)) if r[1] in RULE_KINDS] == [r for r in told if r[1] in RULE_KINDS]


def test_the_search_for_cycles_goes_on_after_a_file(spark):
    from revspark.operators.structure import _uncollected
    with _uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_contents_are_decoded_once(spark):
    """every character of a wrapped text was looked up, and the bytes were decoded for the check and for the text."""
    text = "naïve\n" * 40
    b = base64.b64encode(text.encode()).decode()
    lines = [b[i:i + 60] for i in range(0, len(b), 60)]
    rows = [("\n".join(lines), text), ("\n".join(lines) + "\n", text), ("\r\n".join(lines) + "\r\n", text),
            (" \t".join(lines) + "\n \n", text), ("YQ==\n", "a"), ("Y Q=\n=", "a"), ("é" + b, text), ("YQ==YQ==", None), ("Y", None),
            ("/w==\n", None), ("", ""), ("\n", "")]
    df = spark.createDataFrame([(c, w, "base64") for c, w in rows] + [("Y\n", "Y\n", "utf-8")], "c string, want string, e string").repartition(1)
    got = df.select("c", "want", decode_contents(F.col("c"), F.col("e")).alias("got"))
    assert [(r.c, r.got) for r in got.collect()] == [(r.c, r.want) for r in got.collect()]
    assert "StringDecode" not in plan(got)


def _findings(spark, n):
    rows = [(1, 1, "a.py", k, f"m{k}") for k in range(1, n + 1)] + [(2, 1, "b.py", 1, "m"), (4, 1, "c.py", 1, "m")]
    return spark.createDataFrame(rows, "pr_key long, file_ord long, file_path string, line_number int, message string").select(
        "*", F.col("line_number").alias("rank"), F.lit("low").alias("severity"), F.lit("style").alias("category"),
        F.lit("").alias("suggestion"), F.lit(None).cast("string").alias("rule_id"))


@pytest.mark.parametrize("limit", [20, 0])
def test_payloads_read_the_findings_once(spark, tmp_path, limit):
    """they were read for the comments and for the number of findings."""
    _findings(spark, 23).write.parquet(str(tmp_path / "findings"))
    findings = spark.read.parquet(str(tmp_path / "findings"))
    prs = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "z", True)], "pr_key long, head_sha string, post_review boolean")
    summaries = spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 3)], "pr_key long, summary string")
    df = review_payloads(prs, findings, summaries, limit)
    r, = df.select("pr_key", F.from_json("payload", "commit_id string, comments array<struct<path string, line int>>").alias("p")).collect()
    assert r.pr_key == 1 and r.p.commit_id == "x"
    assert [c.line for c in r.p.comments or []] == list(range(1, limit + 1))
    assert limit == 0 or plan(df).count("FileScan") == 1


def test_lists_of_pr_files(spark, tmp_path):
    """lists were grouped and sorted anew; contents were told apart by the texts derived for them."""
    from revspark.plans.queries_pr import _contents, _files_json
    pd.DataFrame({"o_orderkey": [1, 2, 2], "o_orderpriority": "x", "o_custkey": [5, 6, 7]}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [1] * 7 + [2], "l_partkey": [9, 8, 7, 6, 5, 4, 9, 3], "l_suppkey": 1, "l_linenumber": [1, 2, 3, 4, 5, 6, 7, 1],
                  "l_quantity": 2.0, "l_linestatus": "F", "l_returnflag": "A"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": range(1, 10), "p_size": 1}).to_parquet(tmp_path / "part.parquet")
    df = _files_json(spark, str(tmp_path))
    got = {(r.pr_key, r.part): r.names for r in df.select(
        "pr_key", "part", F.from_json("json", "array<struct<filename string>>").filename.alias("names")).where("pr_key = 1").collect()}
    assert got == {(1, 0): ["src/f_9.py", "src/f_8.py", "src/f_7.py"], (1, 1): ["src/f_6.py", "src/f_5.py", "src/f_4.py"],
                   (1, 2): ["src/f_9.py"]}
    assert "ObjectHashAggregate" not in plan(df)
    c = _contents(spark, str(tmp_path))
    assert sorted((r.repo, r.path) for r in c.collect()) == sorted(
        [("org5/repo1", f"src/f_{k}.py") for k in (4, 5, 6, 7, 8, 9)] + [("org6/repo2", "src/f_3.py"), ("org7/repo2", "src/f_3.py")])


def test_findings_are_kept_for_their_readers(spark, tmp_path):
    """the comments and the summary each had the findings told and de-duplicated."""
    from __spark_entry__ import queries
    pd.DataFrame({"o_orderkey": [2, 4], "o_orderpriority": "x", "o_custkey": 5}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [2, 4, 4], "l_partkey": [3, 4, 8], "l_suppkey": 1, "l_linenumber": [1, 1, 2], "l_quantity": 2.0,
                  "l_linestatus": "F", "l_returnflag": "A"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": range(1, 10), "p_size": 3}).to_parquet(tmp_path / "part.parquet")
    df = queries()["review_payloads"](spark, str(tmp_path))
    assert "xplode" not in plan(df)
    assert {r.pr_key: r.n_comments for r in df.collect()} == {2: 2, 4: 7}
