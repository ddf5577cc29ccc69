"""Canonical table schemas, vocabularies and weights.

The vocabularies and maps below are FIXED VALUES: they must equal the
behaviour being reproduced (finding vocabularies, tool code tables, scoring
weights), so they are written out plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — vocabularies
# ---------------------------------------------------------------------------

# Severity, most severe first (its list index is the severity rank; unknown = 5).
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# Finding categories: 6 quality, 8 security, 4 testing, 5 general.
CATEGORIES = [
    "code_smell", "complexity", "naming", "style", "duplication", "maintainability",
    "sql_injection", "xss", "hardcoded_secret", "insecure_import", "authentication",
    "authorization", "cryptography", "injection",
    "missing_test", "low_coverage", "edge_case", "test_quality",
    "best_practice", "performance", "documentation", "error_handling", "other",
]

REVIEW_STATUSES = ["pending", "in_progress", "completed", "failed"]

# Built-in reviewers, in their fixed run order (agent_ord = list index).
DEFAULT_AGENTS = [
    ("QualityAgent", "Analyzes code quality including style, complexity, and best practices"),
    ("SecurityAgent", "Analyzes security vulnerabilities and maps to OWASP categories"),
    ("TestingAgent", "Analyzes test coverage and suggests missing test cases"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — weights
# ---------------------------------------------------------------------------

# Score deduction per finding (times its confidence); file and PR scores.
SCORE_WEIGHTS = [("critical", "15.0"), ("high", "8.0"), ("medium", "3.0"),
                 ("low", "1.0"), ("info", "0.5")]
SCORE_WEIGHT_DEFAULT = "1.0"

# Complexity score deduction per counted finding; unknown keys weigh 0.
COMPLEXITY_WEIGHTS = [("critical", 25), ("high", 15), ("medium", 5), ("low", 2), ("info", 1)]

# Submission size limit in UTF-8 bytes.
MAX_CODE_BYTES = 1_000_000

# Cache time-to-live for stored model responses, seconds.
CACHE_TTL_SECONDS = 3600

# Per-agent defaults for model-suggested items: (severity, category, confidence).
AI_DEFAULTS = {
    "QualityAgent": ("medium", "code_smell", "0.70"),
    "SecurityAgent": ("high", "injection", "0.70"),
    "TestingAgent": ("low", "missing_test", "0.65"),
}

# Fixed texts.
NO_ISSUES = "No issues found"
SECURITY_FALLBACK_EXPLANATION = "Review and fix this security vulnerability."
DEFAULT_FILE_PATH = "untitled.py"
DEFAULT_LANGUAGE = "python"

# ---------------------------------------------------------------------------
# Table schemas (canonical column order)
# ---------------------------------------------------------------------------

CONFIDENCE_TYPE = T.DoubleType()

FILES = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("code", T.StringType()),
])

RAW_FINDINGS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("item_ord", T.LongType()),
    T.StructField("rule_code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("end_line_number", T.IntegerType()),
    T.StructField("tool_severity", T.StringType()),
    T.StructField("tool_confidence", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("test_name", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("agent_ord", T.IntegerType()),
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("item_ord", T.LongType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("end_line_number", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_rank", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("owasp_category", T.StringType()),
    T.StructField("confidence", CONFIDENCE_TYPE),
])

FINDING_COLUMNS = [f.name for f in FINDINGS.fields]
ORDER_COLUMNS = ["agent_ord", "source_ord", "item_ord"]

CODE_ELEMENTS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("walk_ord", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("n_args", T.IntegerType()),
    T.StructField("args", T.StringType()),
    T.StructField("has_return", T.BooleanType()),
    T.StructField("is_async", T.BooleanType()),
    T.StructField("complexity", T.IntegerType()),
    # per-file summary, set on the one ``kind='file'`` row of every file
    T.StructField("n_lines", T.IntegerType()),
    T.StructField("has_error_handling", T.BooleanType()),
    T.StructField("has_test_function", T.BooleanType()),
    T.StructField("has_public_function", T.BooleanType()),
    T.StructField("parse_failed", T.BooleanType()),
    T.StructField("no_assertions", T.BooleanType()),
])
