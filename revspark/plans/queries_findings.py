"""Registered queries over V2 findings: W1-W3, A1-A8 (and their oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.operators import aggregates as A
from revspark.operators.dedup import dedup_findings, rank_findings, top_findings
from revspark.plans.fixtures import SQL_V2, SQL_V2_DEDUP, V2_ORDER, v2_findings, v2_total_lines

Q = {}
SQL = {}


def _dedup(spark, sf):
    return dedup_findings(v2_findings(spark, sf), order_cols=V2_ORDER)


# --- W1 ----------------------------------------------------------------------
def q_dedup_findings(spark, sf):
    d = _dedup(spark, sf)
    return d.select("review_id", "file_path", "line_number", "message", "severity", "category",
                    "agent_name", F.col("confidence").cast("double").alias("confidence"),
                    "ord1", "ord2", "ord3", "ord4", "pos_ord1", "pos_ord2", "pos_ord3", "pos_ord4",
                    "n_duplicates")


Q["dedup_findings"] = q_dedup_findings
SQL["dedup_findings"] = f"""with {SQL_V2},
p as (select review_id, file_path, line_number, substring(message, 1, 100) as mk,
        min(struct_pack(a := ord1, b := ord2, c := ord3, d := ord4)) as pos
      from v2 group by all),
{SQL_V2_DEDUP}
select k.review_id, k.file_path, k.line_number, k.message, k.severity, k.category, k.agent_name,
  cast(k.confidence as double) as confidence, k.ord1, k.ord2, k.ord3, k.ord4,
  p.pos.a as pos_ord1, p.pos.b as pos_ord2, p.pos.c as pos_ord3, p.pos.d as pos_ord4,
  k.n_duplicates
from k join p on k.review_id = p.review_id and k.file_path = p.file_path and k.line_number = p.line_number
  and substring(k.message, 1, 100) = p.mk"""

_SQL_RANKED = f"""with {SQL_V2},
p as (select review_id, file_path, line_number, substring(message, 1, 100) as mk,
        min(struct_pack(a := ord1, b := ord2, c := ord3, d := ord4)) as pos
      from v2 group by all),
{SQL_V2_DEDUP},
r as (select k.*, row_number() over (partition by k.review_id, k.file_path
          order by k.severity_rank, k.line_number, p.pos.a, p.pos.b, p.pos.c, p.pos.d) as rank
      from k join p on k.review_id = p.review_id and k.file_path = p.file_path
        and k.line_number = p.line_number and substring(k.message, 1, 100) = p.mk)"""


# --- W2 ----------------------------------------------------------------------
def q_severity_sorted(spark, sf):
    r = rank_findings(_dedup(spark, sf), order_cols=V2_ORDER)
    return r.select("review_id", "file_path", "line_number", "severity", "message",
                    F.col("rank").cast("bigint").alias("rank"))


Q["severity_sorted"] = q_severity_sorted
SQL["severity_sorted"] = _SQL_RANKED + """
select review_id, file_path, line_number, severity, message, cast(rank as bigint) as rank from r"""


# --- W3 ----------------------------------------------------------------------
def q_top10_findings(spark, sf):
    t = top_findings(_dedup(spark, sf), 10, order_cols=V2_ORDER)
    return t.select("review_id", "file_path", F.col("n_top").cast("bigint").alias("n_top"), "top_lines")


Q["top10_findings"] = q_top10_findings
SQL["top10_findings"] = _SQL_RANKED + """
select review_id, file_path, cast(count(*) as bigint) as n_top,
  string_agg(concat('- [', severity, '] ', substring(message, 1, 100)), chr(10) order by rank) as top_lines
from r where rank <= 10 group by review_id, file_path"""


# --- A1 ----------------------------------------------------------------------
_SEV_SQL = """cast(count(*) as bigint) as n_findings,
  cast(count_if(severity = 'critical') as bigint) as n_critical, cast(count_if(severity = 'high') as bigint) as n_high,
  cast(count_if(severity = 'medium') as bigint) as n_medium, cast(count_if(severity = 'low') as bigint) as n_low,
  cast(count_if(severity = 'info') as bigint) as n_info"""


def q_severity_counts(spark, sf):
    return A.severity_counts(_dedup(spark, sf), ["review_id"])


Q["severity_counts"] = q_severity_counts
SQL["severity_counts"] = f"""with {SQL_V2}, {SQL_V2_DEDUP}
select review_id, {_SEV_SQL} from k group by review_id"""


# --- A2 ----------------------------------------------------------------------
def q_by_severity(spark, sf):
    return A.by_severity(_dedup(spark, sf), ["review_id"]).select(
        "review_id", "severity", F.col("n").cast("bigint").alias("n"))


Q["by_severity_zero_filled"] = q_by_severity
SQL["by_severity_zero_filled"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
s(severity) as (values ('critical'), ('high'), ('medium'), ('low'), ('info')),
r as (select distinct review_id from k)
select r.review_id, s.severity, cast(count(k.review_id) as bigint) as n
from r cross join s left join k on k.review_id = r.review_id and k.severity = s.severity
group by r.review_id, s.severity"""


# --- A3 ----------------------------------------------------------------------
def q_by_category(spark, sf):
    return A.by_category(_dedup(spark, sf), ["review_id"]).select(
        "review_id", "category", F.col("n").cast("bigint").alias("n"))


Q["by_category"] = q_by_category
SQL["by_category"] = f"""with {SQL_V2}, {SQL_V2_DEDUP}
select review_id, category, cast(count(*) as bigint) as n from k group by review_id, category"""


# --- A4 + J5 -------------------------------------------------------------------
def q_agent_summaries(spark, sf):
    d = _dedup(spark, sf)
    return A.agent_summaries(d, d.select("review_id")).select(
        "review_id", "agent_name", F.col("n_findings").cast("bigint").alias("n_findings"), "summary")


def _sev_list_sql(c, h, m, lo):
    return (f"concat_ws(', ', case when {c} > 0 then concat({c}, ' critical') end, "
            f"case when {h} > 0 then concat({h}, ' high') end, "
            f"case when {m} > 0 then concat({m}, ' medium') end, "
            f"case when {lo} > 0 then concat({lo}, ' low') end)")


Q["agent_summaries"] = q_agent_summaries
SQL["agent_summaries"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
a(agent_name) as (values ('QualityAgent'), ('SecurityAgent'), ('TestingAgent')),
r as (select distinct review_id from k),
c as (select review_id, agent_name, {_SEV_SQL} from k group by review_id, agent_name),
s as (select coalesce(sp.review_id, c.review_id) as review_id, coalesce(sp.agent_name, c.agent_name) as agent_name,
        coalesce(c.n_findings, 0) as n_findings, coalesce(n_critical, 0) as c1, coalesce(n_high, 0) as c2,
        coalesce(n_medium, 0) as c3, coalesce(n_low, 0) as c4
      from (select * from r cross join a) sp
      full outer join c on sp.review_id = c.review_id and sp.agent_name = c.agent_name)
select review_id, agent_name, cast(n_findings as bigint) as n_findings,
  case when c1 + c2 + c3 + c4 > 0 then concat('Found ', {_sev_list_sql('c1', 'c2', 'c3', 'c4')}, ' severity issues')
       else 'No issues found' end as summary
from s"""


# --- A5 ----------------------------------------------------------------------
_W_SQL = ("cast(case severity when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0 "
          "when 'low' then 1.0 when 'info' then 0.5 else 1.0 end as decimal(4,1)) * confidence")


def q_review_score(spark, sf):
    d = _dedup(spark, sf)
    g = d.groupBy("review_id", "file_path").agg(A.score_deduction().alias("_ded"))
    return g.select("review_id", "file_path",
                    A.file_score_expr(F.col("_ded"), v2_total_lines(F.col("review_id"))).alias("overall_score"))


Q["review_score"] = q_review_score
SQL["review_score"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
a as (select review_id, file_path, sum({_W_SQL}) as ded from k group by review_id, file_path)
select review_id, file_path, cast(round(cast(greatest(cast(0 as double),
   100 - cast(ded as double) / greatest(cast(1 as double), (80 + review_id % 200) / cast(100 as double)))
   as decimal(12,6)), 1) as double) as overall_score
from a"""


# --- A6 ----------------------------------------------------------------------
def q_pr_score(spark, sf):
    return A.pr_scores(_dedup(spark, sf), ["review_id"])


Q["pr_score"] = q_pr_score
SQL["pr_score"] = f"""with {SQL_V2}, {SQL_V2_DEDUP}
select review_id, greatest(cast(0 as double), cast(round(cast(100 as decimal(4,1)) - sum({_W_SQL}), 1) as double)) as overall_score
from k group by review_id"""


# --- A7 ----------------------------------------------------------------------
def q_complexity_score(spark, sf):
    c = A.severity_counts(_dedup(spark, sf), ["review_id"])
    return A.complexity_scores(c, ["review_id"])


Q["complexity_score"] = q_complexity_score
SQL["complexity_score"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
c as (select review_id, {_SEV_SQL} from k group by review_id)
select review_id, greatest(cast(0 as double), least(cast(100 as double),
  100.0 - cast(25 * n_critical + 15 * n_high + 5 * n_medium + 2 * n_low + n_info as double))) as complexity_score
from c"""


# --- A8 ----------------------------------------------------------------------
def q_file_reviews(spark, sf):
    d = _dedup(spark, sf)
    files = d.select("review_id", "file_path").distinct() \
        .withColumn("total_lines", v2_total_lines(F.col("review_id")))
    fr = A.file_reviews(files, d)
    return fr.select("review_id", "file_path", F.col("files_analyzed").cast("bigint").alias("files_analyzed"),
                     F.col("total_lines").cast("bigint").alias("total_lines"), "n_findings",
                     *A.COUNT_COLUMNS, "overall_score", "status", "summary")


Q["file_reviews"] = q_file_reviews
SQL["file_reviews"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
a as (select review_id, file_path, {_SEV_SQL}, sum({_W_SQL}) as ded from k group by review_id, file_path),
s as (select *, cast(80 + review_id % 200 as bigint) as total_lines,
        cast(round(cast(greatest(cast(0 as double), 100 - cast(ded as double) / greatest(cast(1 as double),
          (80 + review_id % 200) / cast(100 as double))) as decimal(12,6)), 1) as double) as overall_score
      from a)
select review_id, file_path, cast(1 as bigint) as files_analyzed, total_lines, n_findings, n_critical, n_high,
  n_medium, n_low, n_info, overall_score, 'completed' as status,
  concat('Code review completed for ', file_path, '. Found ', n_findings, ' issues (',
         {_sev_list_sql('n_critical', 'n_high', 'n_medium', 'n_low')}, ' severity). Score: ',
         printf('%.1f', overall_score), '/100') as summary
from s"""


# --- W3 + T11 summary prompts ---------------------------------------------------
def q_summary_prompts(spark, sf):
    from revspark.plans.review import review_summary_prompts
    d = _dedup(spark, sf)
    files = d.select("review_id", "file_path").distinct() \
        .withColumn("total_lines", v2_total_lines(F.col("review_id")))
    fr = A.file_reviews(files, d)
    p = review_summary_prompts(d, fr, order_cols=V2_ORDER)
    return p.select("review_id", "file_path", "kind", "prompt_key")


def _summary_system():
    from revspark.operators.prompts import SYSTEM
    return SYSTEM["summary"].replace("'", "''")


Q["summary_prompts"] = q_summary_prompts
SQL["summary_prompts"] = _SQL_RANKED + f""",
t as (select review_id, file_path, string_agg(concat('- [', severity, '] ', substring(message, 1, 100)), chr(10)
        order by rank) as top_lines from r where rank <= 10 group by review_id, file_path),
a as (select review_id, file_path, sum({_W_SQL}) as ded from k group by review_id, file_path),
s as (select review_id, file_path, cast(round(cast(greatest(cast(0 as double), 100 - cast(ded as double)
        / greatest(cast(1 as double), (80 + review_id % 200) / cast(100 as double))) as decimal(12,6)), 1) as double)
        as score from a)
select s.review_id, s.file_path, 'summary' as kind,
  sha256(concat_ws(chr(0), '{_summary_system()}', 'Score ' || printf('%.1f', score) || '/100.' || chr(10)
    || 'Main findings:' || chr(10) || coalesce(nullif(top_lines, ''), 'No significant issues found.'))) as prompt_key
from s left join t on t.review_id = s.review_id and t.file_path = s.file_path"""
