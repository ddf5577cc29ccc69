"""Findings in code elements: the innermost function and class around each finding's line."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines to a cell of the interval join.
CELL = 128

FILE_KEYS = ("review_id", "file_path")


def spans_of(code: str) -> list[tuple]:
    """(kind, name, first_line, last_line) of every function and class; none where the text does not parse. Decorators
    belong to what they decorate."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            rows.append((kind, node.name, min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno))
    return rows


def element_spans(files: DataFrame) -> DataFrame:
    """``files(review_id, file_path, code)`` -> (review_id, file_path, kind, name, first_line, last_line)."""
    key = files.schema["review_id"].dataType
    schema = T.StructType([T.StructField("review_id", key), T.StructField("file_path", T.StringType()),
                           T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())])

    def batches(frames):
        for f in frames:
            rows = [(r, p, *s) for r, p, c in zip(f["review_id"], f["file_path"], f["code"], strict=True) if c is not None
                    for s in spans_of(c)]
            yield pd.DataFrame(rows, columns=schema.names)

    return files.select("review_id", "file_path", "code").mapInPandas(batches, schema)


def locate_findings(findings: DataFrame, spans: DataFrame, cell: int = CELL) -> DataFrame:
    """``findings`` with function_name, function_line, class_name and class_line, null outside of any.

    Spans are dealt to the cells of lines that they meet, the distinct lines of findings to their own cell, so a line meets
    the spans of one cell only, in files of any length. Of the spans around a line the one that starts last is
    the innermost, of equal starts the one that ends first, of equal spans the one whose name sorts first. Lines are
    located once, however many findings they have, and joined back by (file, line). Findings without a line, a review or a
    path stay, unlocated.
    """
    lines = findings.select(*FILE_KEYS, "line_number").where(F.col("line_number").isNotNull()).distinct()
    lines = lines.withColumn("cell", F.floor(F.col("line_number") / cell))
    dealt = spans.select(*FILE_KEYS, "kind", "name", "first_line", "last_line", F.explode(F.sequence(
        F.floor(F.col("first_line") / cell), F.floor(F.col("last_line") / cell))).alias("cell"))
    around = lines.join(dealt, [*FILE_KEYS, "cell"]).where(F.col("line_number").between(F.col("first_line"), F.col("last_line")))
    inner = F.struct((-F.col("first_line")).alias("up"), F.col("last_line").alias("end"), F.col("name").alias("name"))
    found = around.groupBy(*FILE_KEYS, "line_number").agg(
        *(F.min(F.when(F.col("kind") == kind, inner)).alias(kind) for kind in ("function", "class")))
    named = found.select(*(F.col(c).alias(f"__{c}") for c in (*FILE_KEYS, "line_number")),
                         *(x for kind in ("function", "class") for x in (F.col(kind)["name"].alias(f"{kind}_name"),
                                                                       (-F.col(kind)["up"]).alias(f"{kind}_line"))))
    same = [F.col(c) == F.col(f"__{c}") for c in (*FILE_KEYS, "line_number")]
    return findings.join(named, same, "left").drop(*(f"__{c}" for c in (*FILE_KEYS, "line_number")))
