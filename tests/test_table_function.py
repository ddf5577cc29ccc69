"""E1 in SQL gives the rows of the DataFrame call."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from revspark.operators.reviewers import FileReviewer, _file_items
from revspark.operators.table_function import register_reviewers


def make_reviewer():
    def long_lines(path, code):  # nested, so that it travels by value
        if path.endswith(".bad"):
            raise ValueError("cannot read")
        return [dict(line_number=k, severity="low", category="style", message=f"{len(x)} characters", confidence=0.5)
                for k, x in enumerate((code or "").split("\n"), 1) if len(x) > 5]
    return long_lines


long_lines = make_reviewer()


@pytest.fixture
def files(spark):
    register_reviewers(spark, [FileReviewer("Long", "", long_lines), FileReviewer("Limited", "", long_lines, seconds=20)])
    rows = [(f"r{k}", "ab"[k % 2], f"f{k}{'.bad' if k % 5 == 0 else '.py'}", None if k == 3 else "short\n" + "long line " * k, k) for k in range(20)]
    df = spark.createDataFrame(rows, "review_id string, repo string, file_path string, code string, other int")
    df.createOrReplaceTempView("sql_files")
    return df


@pytest.mark.parametrize("how", ["", " partition by repo"])
@pytest.mark.parametrize("name", ["Long", "Limited"])
def test_same_rows_as_the_call(spark, files, name, how):
    got = spark.sql(f"select * from review_files(table(sql_files){how}, reviewer => '{name}')")
    assert got.columns[:3] == ["review_id", "file_path", "agent_name"] and got.schema["review_id"].dataType.simpleString() == "string"
    want = _file_items(files, FileReviewer(name, "", long_lines)).collect()
    assert sorted(map(repr, map(tuple, got.drop("agent_name").collect()))) == sorted(map(repr, map(tuple, want))) and len(want) > 15
    assert got.where(F.col("agent_name") != name).count() == 0
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == bool(how)


@pytest.mark.parametrize("call", ["table(sql_files), reviewer => 'None'", "table(select repo from sql_files), reviewer => 'Long'"])
def test_errors_at_analysis(spark, files, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"select * from review_files({call})")
