"""Prompt rows for the model work list (our own wording).

``prompts(prompt_key, kind, review_id, file_path, system, user)``.  Keys are
``sha2`` of (system, user), so identical questions share one stored answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import prompt_key
from revspark.operators.reviewers import is_test_file

SYSTEM = {
    "suggestion": "You review Python code. Give one short, concrete fix for the reported issue.",
    "explanation": "You explain security problems in code in plain words and say how to fix them.",
    "quality": "You review Python code for quality problems. Answer with a JSON array of findings "
               "(line_number, severity, category, message, suggestion).",
    "security": "You review Python code for security problems. Answer with a JSON array of findings "
                "(line_number, severity, category, message, suggestion, owasp_category).",
    "testing": "You review Python code for missing tests. Answer with a JSON array of findings "
               "(line_number, severity, category, message, suggestion).",
    "test_quality": "You review Python test code for weak tests. Answer with a JSON array of findings "
                    "(line_number, severity, category, message, suggestion).",
    "summary": "You write a two or three sentence summary of a code review for the author.",
}


def _rows(df: DataFrame, kind: str, user) -> DataFrame:
    system = F.lit(SYSTEM[kind])
    return df.select(prompt_key(system, user).alias("prompt_key"), F.lit(kind).alias("kind"),
                     "review_id", "file_path", system.alias("system"), user.alias("user"))


def finding_prompts(findings: DataFrame, kind: str = "suggestion") -> DataFrame:
    """Per-finding prompts; ``findings`` may carry ``context`` (J7, colon style).

    Returns the findings with ``prompt_key`` added (for J1/J2) — the prompt
    text itself is rebuilt by :func:`build_prompts` for the work list.
    """
    return findings.withColumn("prompt_key", prompt_key(F.lit(SYSTEM[kind]), _finding_user(findings, kind)))


def _finding_user(df: DataFrame, kind: str):
    ctx = F.coalesce(F.col("context"), F.lit("")) if "context" in df.columns else F.lit("")
    if kind == "suggestion":
        return F.concat(F.lit("Issue at line "), F.col("line_number").cast("string"), F.lit(" ("),
                        F.col("category"), F.lit("): "), F.col("message"), F.lit("\n\nCode:\n"), ctx)
    return F.concat(F.lit("Problem at line "), F.col("line_number").cast("string"), F.lit(": "),
                    F.col("category"), F.lit(" / "), F.coalesce(F.col("owasp_category"), F.lit("")),
                    F.lit("\n\nCode:\n"), ctx)


def build_prompts(kind: str, df: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Prompt rows of one kind.

    suggestion / explanation: per finding; quality / security / testing: per
    file (``df`` = files with code); summary: per review (``df`` has
    ``overall_score`` and ``top_lines`` from W3).
    """
    if kind in ("suggestion", "explanation"):
        return _rows(df, kind, _finding_user(df, kind))
    if kind in ("quality", "security"):
        user = F.concat(F.lit("File: "), F.col("file_path"), F.lit("\n\n"), F.col("code"))
        return _rows(df, kind, user)
    if kind == "testing":
        names = None
        if elements is not None:
            names = (elements.filter(F.col("kind").isin("function", "async_function"))
                     .groupBy("review_id", "file_path")
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                         F.when(F.col("kind") == "function", 0).otherwise(1).alias("k"), "walk_ord", "name"))),
                         lambda s: s["name"]), ", ").alias("_names")))
        d = df if names is None else df.join(names, ["review_id", "file_path"], "left")
        fn = F.coalesce(F.col("_names"), F.lit("None detected")) if names is not None else F.lit("None detected")
        test = is_test_file(F.col("file_path"))
        user = F.concat(F.lit("File: "), F.col("file_path"), F.lit("\nFunctions: "), fn,
                        F.lit("\n\n"), F.col("code"))
        system = F.when(test, F.lit(SYSTEM["test_quality"])).otherwise(F.lit(SYSTEM["testing"]))
        return d.select(prompt_key(system, user).alias("prompt_key"),
                        F.when(test, F.lit("test_quality")).otherwise(F.lit("testing")).alias("kind"),
                        "review_id", "file_path", system.alias("system"), user.alias("user"))
    if kind == "summary":
        user = F.concat(F.lit("Score "), F.format_string("%.1f", F.col("overall_score")),
                        F.lit("/100.\nMain findings:\n"),
                        F.coalesce(F.nullif(F.col("top_lines"), F.lit("")), F.lit("No significant issues found.")))
        return _rows(df, "summary", user)
    raise ValueError(f"unknown prompt kind {kind}")
