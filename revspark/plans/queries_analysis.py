"""Registered queries over findings as a whole: their code elements, changes between reviews, subtotals (and oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.operators.aggregates import findings_cube
from revspark.operators.changes import change_counts, review_changes
from revspark.operators.locate import element_spans, locate_findings
from revspark.plans.fixtures import SQL_V2, SQL_V7, table, v2_findings, v7_files

Q = {}
SQL = {}


# --- findings in code elements ---------------------------------------------------
def q_located_findings(spark, sf):
    li = table(spark, sf, "lineitem")
    findings = li.select(F.col("l_partkey").alias("review_id"),
                         F.concat(F.lit("src/part_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file_path"),
                         (1 + (7 * F.col("l_suppkey") + F.col("l_linenumber")) % 30).cast("int").alias("line_number"),
                         F.col("l_orderkey").alias("ord1"), F.col("l_linenumber").alias("ord2"))
    return locate_findings(findings, element_spans(v7_files(spark, sf))).select(
        "review_id", "line_number", "ord1", "ord2", "function_name", "function_line", "class_name", "class_line")


Q["located_findings"] = q_located_findings
SQL["located_findings"] = f"""with {SQL_V7},
p as (select *, cast(3 + 2 * (p_size % 8) + 2 * cast(has_for as int) + 4 * cast(has_try as int) as int) as c from v7 where not broken),
spans as (
  select review_id, 'function' as kind, concat('f_', cast(review_id as varchar)) as name, 1 as a, c - 1 as b from p
  union all select review_id, 'class', concat('C_', cast(review_id as varchar)), c, c + 5 from p where has_class
  union all select review_id, 'function', 'm', c + 1, c + 2 from p where has_class
  union all select review_id, 'function', 'am', c + 3, c + 5 from p where has_class),
f as (select l_partkey as review_id, cast(1 + (7 * l_suppkey + l_linenumber) % 30 as int) as line_number, l_orderkey as ord1,
        l_linenumber as ord2, row_number() over () as id from lineitem)
select f.review_id, f.line_number, f.ord1, f.ord2,
  arg_max(s.name, s.a) filter (where s.kind = 'function') as function_name,
  cast(max(s.a) filter (where s.kind = 'function') as int) as function_line,
  arg_max(s.name, s.a) filter (where s.kind = 'class') as class_name,
  cast(max(s.a) filter (where s.kind = 'class') as int) as class_line
from f left join spans s on s.review_id = f.review_id and f.line_number between s.a and s.b
group by f.id, f.review_id, f.line_number, f.ord1, f.ord2"""


# --- changes between two reviews ---------------------------------------------------
def _two_reviews(spark, sf):
    """Findings of lineitem's A, N and R rows: those of an A row are gone in the later review, those of an R row are not
    in the earlier one; an edit moved the later ones down by 40 lines."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    parts = {"before": li.where("l_returnflag != 'R'"), "after": li.where("l_returnflag != 'A'")}
    return {k: _findings(d, 0 if k == "before" else 40) for k, d in parts.items()}


def _findings(li, shift):
    agent = F.when(F.col("l_suppkey") % 3 == 0, "QualityAgent").when(F.col("l_suppkey") % 3 == 1, "SecurityAgent").otherwise("TestingAgent")
    line = (1 + F.col("l_quantity").cast("int") + shift).cast("int")
    return li.select(
        (F.col("l_orderkey") % 100).alias("review_id"),
        F.concat(F.lit("src/mod_"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py")).alias("file_path"),
        agent.alias("agent_name"), F.when(F.col("l_linenumber") % 2 == 0, "style").otherwise("complexity").alias("category"),
        F.when(F.col("l_partkey") % 2 == 0, "high").otherwise("low").alias("severity"),
        F.concat(F.lit("issue at line "), line.cast("string")).alias("message"), line.alias("line_number"))


def q_review_changes(spark, sf):
    return review_changes(*_two_reviews(spark, sf).values())


def q_change_counts(spark, sf):
    return change_counts(review_changes(*_two_reviews(spark, sf).values()))


def _side(shift, gone):
    return f"""(select l_orderkey % 100 as review_id, concat('src/mod_', cast(l_partkey % 7 as varchar), '.py') as file_path,
  case l_suppkey % 3 when 0 then 'QualityAgent' when 1 then 'SecurityAgent' else 'TestingAgent' end as agent_name,
  case when l_linenumber % 2 = 0 then 'style' else 'complexity' end as category,
  case when l_partkey % 2 = 0 then 'high' else 'low' end as severity, 'issue at line #' as message_key,
  cast(1 + cast(l_quantity as int) + {shift} as int) as line_number from lineitem where l_returnflag != '{gone}')"""


_FP = "review_id, file_path, agent_name, category, severity, message_key"
_SQL_CHANGES = f"""with b as {_side(0, 'R')}, a as {_side(40, 'A')},
d as (select 'new' as status, * from (select {_FP} from a except all select {_FP} from b)
  union all select 'fixed', * from (select {_FP} from b except all select {_FP} from a)
  union all select 'open', * from (select {_FP} from a intersect all select {_FP} from b)),
lines as (select {_FP}, min(line_number) filter (where late) as la, min(line_number) filter (where not late) as lb
  from (select *, true as late from a union all select *, false from b) group by all),
changes as (select {_FP}, status, cast(count(*) as bigint) as n, any_value(case when status = 'fixed' then lb else la end) as first_line
  from d join lines using ({_FP}) group by {_FP}, status)"""

Q["review_changes"] = q_review_changes
SQL["review_changes"] = _SQL_CHANGES + """
select * from changes"""

Q["change_counts"] = q_change_counts
SQL["change_counts"] = _SQL_CHANGES + """
select review_id, cast(coalesce(sum(n) filter (where status = 'new'), 0) as bigint) as n_new,
  cast(coalesce(sum(n) filter (where status = 'fixed'), 0) as bigint) as n_fixed,
  cast(coalesce(sum(n) filter (where status = 'open'), 0) as bigint) as n_open
from changes group by review_id"""


# --- subtotals -----------------------------------------------------------------------
_DIMS = ["file_path", "agent_name", "category"]


def q_findings_cube(spark, sf):
    return findings_cube(v2_findings(spark, sf), _DIMS)


Q["findings_cube"] = q_findings_cube
SQL["findings_cube"] = f"""with {SQL_V2}
select file_path, agent_name, category, cast(grouping(file_path, agent_name, category) as bigint) as level,
  cast(count(*) as bigint) as n_findings, cast(count_if(severity = 'critical') as bigint) as n_critical,
  cast(count_if(severity = 'high') as bigint) as n_high, cast(count_if(severity = 'medium') as bigint) as n_medium,
  cast(count_if(severity = 'low') as bigint) as n_low, cast(count_if(severity = 'info') as bigint) as n_info,
  cast(sum(confidence) as double) as sum_confidence
from v2 group by cube (file_path, agent_name, category)"""
