"""E1 in SQL: file reviewers as a table function.

    register_reviewers(spark, [FileReviewer("FirstLine", "...", review)])
    select * from review_files(table(files), reviewer => 'FirstLine')
    select * from review_files(table(select ...) partition by repository, reviewer => 'FirstLine')

The function takes any table with review_id, file_path and code and gives a row for each finding, or for a file that failed,
as the DataFrame call does. Its output follows the table: review_id keeps the type that it has there. Only the three columns
go to Python. Without PARTITION BY the files are reviewed where they lie, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf

from revspark.operators.reviewers import _FILE_ITEM, FileReviewer, file_caller, file_rows

NEEDED = ("review_id", "file_path", "code")


def result_schema(files: T.StructType) -> T.StructType:
    missing = [c for c in NEEDED if c not in files.names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return T.StructType([T.StructField("review_id", files["review_id"].dataType), T.StructField("file_path", files["file_path"].dataType),
                         T.StructField("agent_name", T.StringType()), *_FILE_ITEM.fields])


def register_reviewers(spark: SparkSession, reviewers: list[FileReviewer], name: str = "review_files") -> None:
    """Register the table function ``name`` for these reviewers; a reviewer that it does not know is an error of the query's analysis."""
    known = {r.name: r for r in reviewers}

    class ReviewFiles:
        @staticmethod
        def analyze(files: AnalyzeArgument, reviewer: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable:
                raise ValueError("the first argument must be a table")
            if not reviewer.isConstantExpression or reviewer.value not in known:
                raise ValueError(f"reviewer must be one of {', '.join(sorted(known))}")
            return AnalyzeResult(schema=result_schema(files.dataType), select=[SelectedColumn(f"`{c}`") for c in NEEDED])

        def __init__(self):
            self.call = self.close = None

        def eval(self, files, reviewer):
            if self.call is None:
                self.call, self.close = file_caller(known[reviewer])
            for review_id, path, *item in file_rows(self.call, *(files[c] for c in NEEDED)):
                yield (review_id, path, reviewer, *item)

        def terminate(self):
            if self.close is not None:
                self.close()

    spark.udtf.register(name, udtf(ReviewFiles))
