"""Registered queries over V7 generated code: X1-X9 (structure job), R1-R7.

The oracle side uses the closed form of the generated code (argument count,
complexity, which blocks exist, their line numbers), so every value checked
here is produced by the Python-AST job on the Spark side and by arithmetic on
the ``part`` table on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.operators.reviewers import (R1_MESSAGE, R1_SUGGESTION, R2_MESSAGE, R2_SUGGESTION, R3_MESSAGE,
                                          R3_SUGGESTION, R4_MESSAGE, R4_SUGGESTION, R5_MESSAGE, R5_SUGGESTION,
                                          R6_MESSAGE, R6_SUGGESTION, RULE_KINDS, testing_findings)
from revspark.operators.structure import extract_elements
from revspark.plans.fixtures import SQL_V7, v7_files

Q = {}
SQL = {}
FUNCTION_KINDS = ("function", "async_function")


def v7_all(spark, sf):
    """V7 files plus a test-file copy of every third part (some renamed to
    ``test_…`` functions, some with an assertion)."""
    v = v7_files(spark, sf)
    pk = F.col("review_id")
    t = v.filter(pk % 3 == 0).select(
        (pk + F.lit(10_000_000)).alias("review_id"),
        F.concat(F.lit("tests/test_part_"), pk.cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.when(pk % 6 == 0, F.regexp_replace("code", "^def f_", "def test_f_")).otherwise(F.col("code")),
                 F.when(pk % 9 == 0, F.lit("assert True\n")).otherwise(F.lit(""))).alias("code"),
        "n_args", "complexity")
    return v.unionByName(t)


# closed-form line numbers of the generated blocks
_SQL_V7_LINES = SQL_V7 + """,
v7l as (select *, cast(p_size % 8 as int) as n_if,
  2 + 2 * (p_size % 8) as for_line,
  3 + 2 * (p_size % 8) + 2 * cast(has_for as int) + 4 * cast(has_try as int) as class_line,
  2 + 2 * (p_size % 8) + 2 * cast(has_for as int) as try_line
from v7),
v7a as (
  select review_id, file_path, n_args, complexity, broken, has_class, has_for, has_try, n_if, for_line, class_line,
         try_line, false as is_test, false as renamed, false as asserts from v7l
  union all
  select review_id + 10000000, concat('tests/test_part_', cast(review_id as varchar), '.py'), n_args, complexity,
         broken, has_class, has_for, has_try, n_if, for_line, class_line, try_line, true,
         review_id % 6 = 0, review_id % 9 = 0 from v7l where review_id % 3 = 0)"""


# --- X1 X2 X8 ------------------------------------------------------------------
def q_functions(spark, sf):
    e = extract_elements(v7_all(spark, sf).select("review_id", "file_path", "code"), kinds=FUNCTION_KINDS)
    return e.filter(F.col("kind").isin(*FUNCTION_KINDS)).select(
        "review_id", "name", "is_async", "line", "n_args", "args", "has_return")


Q["functions"] = q_functions
SQL["functions"] = "with " + _SQL_V7_LINES + """
select review_id, case when renamed then 'test_f_' else 'f_' end || cast(review_id % 10000000 as varchar) as name,
  false as is_async, 1 as line, n_args,
  substring('a0,a1,a2,a3,a4,a5', 1, 3 * n_args - 1) as args, true as has_return
from v7a where not broken
union all
select review_id, 'm', false, class_line + 1, 5, 'self,a,b,c,d', true from v7a where not broken and has_class
union all
select review_id, 'am', true, class_line + 3, 1, 'self', false from v7a where not broken and has_class"""


# --- X3 X4 ---------------------------------------------------------------------
def q_classes_methods(spark, sf):
    # classes and methods are both read from what one parse wrote
    e = extract_elements(v7_all(spark, sf).select("review_id", "file_path", "code"), checkpoint=True,
                         kinds=("class", "method"))
    # a method carries the position of its class, which is unique in the file; names need not be
    m = e.filter(F.col("kind") == "method").select("review_id", "walk_ord", F.col("name").alias("method"), "line", "is_async")
    c = (e.filter(F.col("kind") == "class").select("review_id", "walk_ord", F.col("name").alias("class_name"),
                                                   F.col("line").alias("class_line")))
    return c.join(m, ["review_id", "walk_ord"], "left").drop("walk_ord")


Q["classes_methods"] = q_classes_methods
SQL["classes_methods"] = "with " + _SQL_V7_LINES + """
select review_id, 'C_' || cast(review_id % 10000000 as varchar) as class_name, class_line, 'm' as method,
  class_line + 1 as line, false as is_async from v7a where not broken and has_class
union all
select review_id, 'C_' || cast(review_id % 10000000 as varchar), class_line, 'am', class_line + 3, true
from v7a where not broken and has_class"""


# --- X5 X6 X9 ------------------------------------------------------------------
def q_indicators(spark, sf):
    e = extract_elements(v7_all(spark, sf).select("review_id", "file_path", "code"),
                         kinds=("conditional", "loop", "error_handling", "parse_error", "file"))
    return e.groupBy("review_id").agg(
        F.count_if(F.col("kind") == "conditional").alias("n_conditional"),
        F.count_if(F.col("kind") == "loop").alias("n_loop"),
        F.coalesce(F.sum(F.when(F.col("kind") == "loop", F.col("line"))), F.lit(0)).cast("bigint")
        .alias("loop_line_sum"),
        F.bool_or(F.col("kind") == "error_handling").alias("has_error_handling"),
        F.max(F.when(F.col("kind") == "parse_error", F.col("name"))).alias("parse_error"))


Q["indicators"] = q_indicators
SQL["indicators"] = "with " + _SQL_V7_LINES + """
select review_id,
  cast(case when broken then 0 else n_if end as bigint) as n_conditional,
  cast(case when broken then 0 else cast(has_for as int) + cast(has_class as int) end as bigint) as n_loop,
  cast(case when broken then 0 else (case when has_for then for_line else 0 end)
       + (case when has_class then class_line + 4 else 0 end) end as bigint) as loop_line_sum,
  case when broken then false else has_try end as has_error_handling,
  case when broken then 'SyntaxError' end as parse_error
from v7a"""


# --- X7 ----------------------------------------------------------------------
def q_complexity(spark, sf):
    e = extract_elements(v7_all(spark, sf).select("review_id", "file_path", "code"), kinds=FUNCTION_KINDS)
    return e.filter(F.col("kind").isin(*FUNCTION_KINDS)).select("review_id", "name", "complexity")


Q["complexity"] = q_complexity
SQL["complexity"] = "with " + _SQL_V7_LINES + """
select review_id, case when renamed then 'test_f_' else 'f_' end || cast(review_id % 10000000 as varchar) as name,
  complexity from v7a where not broken
union all select review_id, 'm', 1 from v7a where not broken and has_class
union all select review_id, 'am', 2 from v7a where not broken and has_class"""


# --- R1-R7 ---------------------------------------------------------------------
def _testing(spark, sf):
    files = v7_all(spark, sf).select("review_id", "file_path", "code")
    return testing_findings(files, extract_elements(files, kinds=RULE_KINDS))


def _rule_out(df):
    return df.select("review_id", "file_path", "source_ord", "line_number", "severity", "category", "message",
                     "suggestion", F.col("confidence").cast("double").alias("confidence"))


Q["test_rules"] = lambda s, sf: _rule_out(_testing(s, sf).filter(F.col("source_ord").isin(4, 5)))
SQL["test_rules"] = "with " + _SQL_V7_LINES + f"""
select review_id, file_path, 4 as source_ord, 1 as line_number, 'high' as severity, 'test_quality' as category,
  '{R5_MESSAGE}' as message, '{R5_SUGGESTION}' as suggestion, cast(0.85 as double) as confidence
from v7a where is_test and not asserts
union all
select review_id, file_path, 5, 1, 'medium', 'test_quality', '{R6_MESSAGE.replace("'", "''")}',
  '{R6_SUGGESTION.replace("'", "''")}', 0.9
from v7a where is_test and not broken and not renamed"""


def _sq(s):
    return s.replace("'", "''")


_R1 = _sq(R1_MESSAGE).replace("{name}", "' || fname || '").replace("{c}", "' || cast(complexity as varchar) || '")
_R1S = _sq(R1_SUGGESTION).replace("{c}", "' || cast(complexity as varchar) || '")
_R2F = _sq(R2_MESSAGE).replace("{name}", "' || fname || '").replace("{n}", "' || cast(n_args as varchar) || '")
_R2M = _sq(R2_MESSAGE).replace("{name}", "m").replace("{n}", "5")

SQL_V7_TESTING = _SQL_V7_LINES + f""",
t as (select *, 'f_' || cast(review_id % 10000000 as varchar) as fname from v7a where not is_test and not broken),
tf as (
  select review_id, file_path, 0 as source_ord, 1 as line_number, 'medium' as severity, 'low_coverage' as category,
    '{_R1}' as message, '{_R1S}' as suggestion, 0.8 as confidence, 0 as sub from t where complexity > 5
  union all
  select review_id, file_path, 0, 1, 'low', 'missing_test', '{_R2F}', '{_sq(R2_SUGGESTION)}', 0.7, 1
  from t where n_args > 3
  union all
  select review_id, file_path, 0, class_line + 1, 'low', 'missing_test', '{_R2M}', '{_sq(R2_SUGGESTION)}', 0.7, 1
  from t where has_class
  union all
  select review_id, file_path, 2, 1, 'low', 'edge_case', '{_sq(R3_MESSAGE)}', '{_sq(R3_SUGGESTION)}', 0.75, 0
  from t where has_try
  union all
  select review_id, file_path, 3, for_line, 'info', 'edge_case', '{_sq(R4_MESSAGE)}', '{_sq(R4_SUGGESTION)}', 0.6, 0
  from t where has_for
  union all
  select review_id, file_path, 3, class_line + 4, 'info', 'edge_case', '{_sq(R4_MESSAGE)}', '{_sq(R4_SUGGESTION)}',
    0.6, 0 from t where has_class)"""

Q["coverage_rules"] = lambda s, sf: _rule_out(_testing(s, sf).filter(F.col("source_ord") <= 3))
SQL["coverage_rules"] = "with " + SQL_V7_TESTING + """
select review_id, file_path, source_ord, line_number, severity, category, message, suggestion,
  cast(confidence as double) as confidence from tf"""
