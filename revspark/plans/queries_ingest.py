"""Registered queries over V3 scanner rows: M1-M10 lookups, S4-S7 ingest, F4-F6."""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.functions import lookups as L
from revspark.operators.normalize import (quality_findings, security_findings, to_findings,
                                          validate_findings)
from revspark.plans.fixtures import SQL_V2, SQL_V3, SQL_V3_RAW, v2_findings, v3_raw, v3_scanner_rows
from revspark.sources.reports import build_reports, ingest_all, ingest_bandit, ingest_pylint, ingest_ruff

Q = {}
SQL = {}


def sql_case(expr: str, pairs, default, mode: str = "exact") -> str:
    """SQL CASE text from the same (key, value) tables the Spark side uses."""
    def q(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    whens = []
    if mode in ("exact", "exact_prefix"):
        whens += [f"when {expr} = {q(k)} then {q(v)}" for k, v in pairs]
    if mode in ("prefix", "exact_prefix"):
        whens += [f"when starts_with({expr}, {q(k)}) then {q(v)}" for k, v in pairs]
    return f"(case {' '.join(whens)} else {q(default)} end)"


def _grouped(df, key, value_col, name):
    return df.groupBy(key, value_col.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def _grouped_sql(view_sql, key, case_sql, name, src="v3"):
    return (f"with {view_sql} select {key}, {case_sql} as {name}, cast(count(*) as bigint) as n "
            f"from {src} group by all")


# --- M1 M2 M3 M4 M6 M7 M8 ----------------------------------------------------------
Q["ruff_severity"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "rule_code",
                                            L.ruff_severity(F.col("rule_code")), "severity")
SQL["ruff_severity"] = _grouped_sql(SQL_V3, "rule_code", sql_case(
    "upper(substring(rule_code, 1, 1))", L.RUFF_SEVERITY_BY_LETTER, "medium"), "severity")

Q["pylint_severity"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "pylint_type",
                                              L.pylint_severity(F.col("pylint_type")), "severity")
SQL["pylint_severity"] = _grouped_sql(SQL_V3, "pylint_type", sql_case(
    "lower(pylint_type)", L.PYLINT_SEVERITY_BY_TYPE, "medium"), "severity")

Q["quality_category"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "rule_code",
                                               L.quality_category(F.col("rule_code")), "category")
SQL["quality_category"] = _grouped_sql(SQL_V3, "rule_code", sql_case(
    "rule_code", L.QUALITY_CATEGORY, "code_smell", "exact_prefix"), "category")

Q["quality_severity"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "rule_code",
                                               L.quality_severity(F.col("rule_code")), "severity")
SQL["quality_severity"] = _grouped_sql(SQL_V3, "rule_code", sql_case(
    "rule_code", L.QUALITY_SEVERITY, "medium", "prefix"), "severity")

Q["bandit_severity"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "tool_severity",
                                              L.bandit_severity(F.col("tool_severity")), "severity")
SQL["bandit_severity"] = _grouped_sql(SQL_V3, "tool_severity", sql_case(
    "tool_severity", L.BANDIT_SEVERITY, "high"), "severity")

Q["bandit_category"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "rule_code",
                                              L.bandit_category(F.col("rule_code")), "category")
SQL["bandit_category"] = _grouped_sql(SQL_V3, "rule_code", sql_case(
    "rule_code", L.BANDIT_CATEGORY, "injection"), "category")

Q["bandit_owasp"] = lambda s, sf: _grouped(v3_scanner_rows(s, sf), "rule_code",
                                           L.bandit_owasp(F.col("rule_code")), "owasp_category")
SQL["bandit_owasp"] = _grouped_sql(SQL_V3, "rule_code", sql_case(
    "rule_code", L.BANDIT_OWASP, L.DEFAULT_OWASP), "owasp_category")


# --- M10 ---------------------------------------------------------------------
def q_infer_owasp(spark, sf):
    v = v2_findings(spark, sf)
    raw = F.when(F.col("review_id") % 2 == 0, F.upper("category")).otherwise(F.col("category"))
    return (v.select(raw.alias("category"))
            .groupBy("category", L.infer_owasp(F.col("category")).alias("owasp_category"))
            .agg(F.count(F.lit(1)).alias("n")))


Q["infer_owasp"] = q_infer_owasp
SQL["infer_owasp"] = f"""with {SQL_V2},
c as (select case when review_id % 2 = 0 then upper(category) else category end as category from v2)
select category, {sql_case('lower(category)', L.OWASP_BY_CATEGORY, L.DEFAULT_OWASP)} as owasp_category,
  cast(count(*) as bigint) as n from c group by all"""


# --- M5 / M9 -------------------------------------------------------------------
_FINDING_OUT = ["review_id", "file_path", "source_ord", "item_ord", "line_number", "end_line_number",
                "column", "severity", "severity_rank", "category", "message", "suggestion", "agent_name",
                "rule_id", "code_snippet", "owasp_category"]


def _finding_out(df):
    return df.select(*_FINDING_OUT, F.col("confidence").cast("double").alias("confidence"))


def _sev_rank_sql(e):
    return (f"(case {e} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 "
            f"when 'low' then 3 when 'info' then 4 else 5 end)")


Q["quality_findings"] = lambda s, sf: _finding_out(quality_findings(v3_raw(s, sf)))
_QSEV = sql_case("rule_code", L.QUALITY_SEVERITY, "medium", "prefix")
SQL["quality_findings"] = f"""with {SQL_V3_RAW}
select review_id, file_path, case tool when 'ruff' then 0 else 1 end as source_ord, item_ord, line_number,
  cast(null as int) as end_line_number, cast(null as int) as "column",
  {_QSEV} as severity, {_sev_rank_sql(_QSEV)} as severity_rank,
  {sql_case('rule_code', L.QUALITY_CATEGORY, 'code_smell', 'exact_prefix')} as category,
  message, coalesce(suggestion, '') as suggestion, 'QualityAgent' as agent_name,
  concat(tool, ':', rule_code) as rule_id, cast(null as varchar) as code_snippet,
  cast(null as varchar) as owasp_category, cast(0.9 as double) as confidence
from v3r where tool in ('ruff', 'pylint')"""

Q["bandit_findings"] = lambda s, sf: _finding_out(security_findings(v3_raw(s, sf)))
_BSEV = sql_case("tool_severity", L.BANDIT_SEVERITY, "high")
SQL["bandit_findings"] = f"""with {SQL_V3_RAW}
select review_id, file_path, 0 as source_ord, item_ord, line_number,
  cast(null as int) as end_line_number, cast(null as int) as "column",
  {_BSEV} as severity, {_sev_rank_sql(_BSEV)} as severity_rank,
  {sql_case('rule_code', L.BANDIT_CATEGORY, 'injection')} as category,
  message, '' as suggestion, 'SecurityAgent' as agent_name, concat('bandit:', rule_code) as rule_id,
  code_snippet, {sql_case('rule_code', L.BANDIT_OWASP, L.DEFAULT_OWASP)} as owasp_category,
  cast({sql_case('tool_confidence', L.BANDIT_CONFIDENCE, '0.75')} as double) as confidence
from v3r where tool = 'bandit'"""


# --- F4 / F6 -------------------------------------------------------------------
def _raw_for_normalize(spark, sf):
    r = v3_raw(spark, sf)
    return r.select(
        "review_id", "file_path", "tool", "item_ord", "line_number", "end_line_number", "column",
        F.col("tool_severity").alias("severity"),
        F.when(F.col("item_ord") % 4 == 0, F.lit("Style")).when(F.col("item_ord") % 4 == 1, F.lit("SQL_Injection"))
        .when(F.col("item_ord") % 4 == 2, F.lit("bogus")).otherwise(F.col("pylint_type")).alias("category"),
        F.when(F.col("rule_code") == "I0011", F.lit("")).otherwise(F.col("message")).alias("message"),
        "suggestion",
        F.concat(F.col("tool"), F.lit(":"), F.col("rule_code")).alias("rule_id"),
        F.when(F.col("rule_code") == "B999", F.lit("1.004")).when(F.col("rule_code") == "F401", F.lit("-0.004")).otherwise(F.lit("0.80")).alias("confidence"),
        F.when(F.col("tool") == "ruff", F.lit("QualityAgent")).when(F.col("tool") == "pylint", F.lit("QualityAgent"))
        .otherwise(F.lit("SecurityAgent")).alias("agent_name"),
        F.lit(0).alias("agent_ord"))


_SQL_NORM = "with " + SQL_V3_RAW + """,
n as (select review_id, file_path, tool, item_ord, line_number,
  case when end_line_number < line_number then line_number else end_line_number end as end_line_number,
  "column",
  case when lower(tool_severity) in ('critical','high','medium','low','info') then lower(tool_severity) else 'medium' end as severity,
  case when lower(case item_ord % 4 when 0 then 'Style' when 1 then 'SQL_Injection' when 2 then 'bogus' else pylint_type end)
       in ('code_smell','complexity','naming','style','duplication','maintainability','sql_injection','xss',
           'hardcoded_secret','insecure_import','authentication','authorization','cryptography','injection',
           'missing_test','low_coverage','edge_case','test_quality','best_practice','performance',
           'documentation','error_handling','other')
       then lower(case item_ord % 4 when 0 then 'Style' when 1 then 'SQL_Injection' when 2 then 'bogus' else pylint_type end)
       else 'other' end as category,
  case when rule_code = 'I0011' then '' else message end as message,
  case rule_code when 'B999' then 1.004 when 'F401' then -0.004 else 0.8 end as confidence,
  case when tool = 'bandit' then 'SecurityAgent' else 'QualityAgent' end as agent_name
from v3r)"""


def q_normalize_findings_nojoin(spark, sf):
    r = _raw_for_normalize(spark, sf)
    f = to_findings(r.withColumn("source_ord", F.when(F.col("tool") == "ruff", 0)
                                 .when(F.col("tool") == "pylint", 1).otherwise(2)))
    return f.select("review_id", "file_path", F.col("source_ord").alias("tool_ord"), "item_ord", "line_number",
                    "end_line_number", "severity", "severity_rank", "category", "agent_name",
                    F.col("confidence").cast("double").alias("confidence"))


Q["normalize_findings"] = q_normalize_findings_nojoin
SQL["normalize_findings"] = _SQL_NORM + f"""
select review_id, file_path, case tool when 'ruff' then 0 when 'pylint' then 1 else 2 end as tool_ord,
  item_ord, line_number, end_line_number, severity, {_sev_rank_sql('severity')} as severity_rank, category,
  agent_name, cast(confidence as double) as confidence from n"""


# --- F5 ----------------------------------------------------------------------
def q_reject_findings(spark, sf):
    r = _raw_for_normalize(spark, sf)
    f = to_findings(r.withColumn("source_ord", F.when(F.col("tool") == "ruff", 0)
                                 .when(F.col("tool") == "pylint", 1).otherwise(2)))
    _, rej = validate_findings(f)
    return rej.select("review_id", "file_path", F.col("source_ord").alias("tool_ord"), "item_ord", "reason")


Q["reject_findings"] = q_reject_findings
SQL["reject_findings"] = _SQL_NORM + """
select review_id, file_path, case tool when 'ruff' then 0 when 'pylint' then 1 else 2 end as tool_ord, item_ord,
  case when line_number < 1 then 'line_number < 1'
       when end_line_number < 1 then 'end_line_number < 1'
       when "column" < 0 then 'column < 0'
       when length(message) < 1 then 'message empty'
       when confidence < 0 or confidence > 1 then 'confidence outside 0..1' end as reason
from n
where line_number < 1 or end_line_number < 1 or "column" < 0 or length(message) < 1 or confidence < 0 or confidence > 1"""


# --- S4-S7 ---------------------------------------------------------------------
_RAW_OUT = ["review_id", "file_path", "tool", "item_ord", "rule_code", "message", "line_number", "column",
            "end_line_number", "tool_severity", "tool_confidence", "suggestion", "code_snippet", "symbol",
            "test_name", "cwe_id"]


def _raw_out(df):
    return df.select(*_RAW_OUT, F.array_join(F.transform("line_range", lambda x: x.cast("string")), ",")
                     .alias("line_range"))


def _reports(spark, sf):
    """Tool-shaped JSON reports built from V3; every 13th review's pylint report is
    cut in half (malformed) and every 11th review's bandit report is sent as a
    bare array (wrong shape) to exercise per-tool failure isolation."""
    rep = build_reports(v3_raw(spark, sf))
    bad_pylint = (F.col("tool") == "pylint") & (F.col("review_id") % 13 == 0)
    bad_bandit = (F.col("tool") == "bandit") & (F.col("review_id") % 11 == 0)
    return rep.withColumn("report", F.when(bad_pylint, F.substring("report", 1, 20))
                          .when(bad_bandit, F.regexp_extract("report", r'^\{"results":(.*)\}$', 1))
                          .otherwise(F.col("report")))


_SQL_RUFF = f"""select review_id, file_path, tool, item_ord, rule_code, message, line_number, "column", end_line_number,
  {sql_case('upper(substring(rule_code, 1, 1))', L.RUFF_SEVERITY_BY_LETTER, 'medium')} as tool_severity,
  cast(null as varchar) as tool_confidence, coalesce(suggestion, '') as suggestion, cast(null as varchar) as code_snippet,
  cast(null as varchar) as symbol, cast(null as varchar) as test_name, cast(null as int) as cwe_id,
  cast(null as varchar) as line_range
from v3r where tool = 'ruff'"""
_SQL_PYLINT = f"""select review_id, file_path, tool, item_ord, rule_code, message, line_number, "column",
  cast(null as int) as end_line_number,
  {sql_case('lower(pylint_type)', L.PYLINT_SEVERITY_BY_TYPE, 'medium')} as tool_severity,
  cast(null as varchar) as tool_confidence, '' as suggestion, cast(null as varchar) as code_snippet,
  symbol, cast(null as varchar) as test_name, cast(null as int) as cwe_id, cast(null as varchar) as line_range
from v3r where tool = 'pylint' and review_id % 13 <> 0"""
_SQL_BANDIT = """select review_id, file_path, tool, item_ord, rule_code, message, line_number,
  cast(null as int) as "column", cast(null as int) as end_line_number, tool_severity, tool_confidence,
  '' as suggestion, code_snippet, cast(null as varchar) as symbol, test_name, cwe_id,
  concat(cast(line_number as varchar), ',', cast(line_number + 1 as varchar)) as line_range
from v3r where tool = 'bandit' and review_id % 11 <> 0"""

Q["ingest_ruff"] = lambda s, sf: _raw_out(ingest_ruff(_reports(s, sf)))
SQL["ingest_ruff"] = f"with {SQL_V3_RAW} {_SQL_RUFF}"
Q["ingest_pylint"] = lambda s, sf: _raw_out(ingest_pylint(_reports(s, sf)))
SQL["ingest_pylint"] = f"with {SQL_V3_RAW} {_SQL_PYLINT}"
Q["ingest_bandit"] = lambda s, sf: _raw_out(ingest_bandit(_reports(s, sf)))
SQL["ingest_bandit"] = f"with {SQL_V3_RAW} {_SQL_BANDIT}"
Q["ingest_all"] = lambda s, sf: _raw_out(ingest_all(_reports(s, sf)))
SQL["ingest_all"] = f"with {SQL_V3_RAW} {_SQL_RUFF} union all {_SQL_PYLINT} union all {_SQL_BANDIT}"
