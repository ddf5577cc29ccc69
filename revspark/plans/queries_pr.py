"""Registered queries for the pull-request path (V4): S3, S8-S10, F1, J3, A10, W4, S13, S14, T8.

Fixture: every order is a PR, its line items are the changed files; a file's
content at the head commit is the V7 generated source of its part, base64
encoded and line-wrapped like a code host returns it.  PR records, file lists,
contents and comments are turned into the host's JSON shapes and ingested back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.functions import text as TX
from revspark.operators.dedup import dedup_findings
from revspark.operators.reviewers import testing_findings
from revspark.operators.structure import extract_elements
from revspark.plans.fixtures import SQL_V4, table, v4_lists, v4_pr_files, v7_code_expr
from revspark.plans.pr import attach_contents, eligible_files, pr_rollup, review_prs
from revspark.plans.queries_code import SQL_V7_TESTING
from revspark.plans.queries_ingest import sql_case
from revspark.session import write_once
from revspark.sources.files import validate_pr_requests
from revspark.sources.github import (comment_payloads, comment_rows, ingest_contents, ingest_pr_comments,
                                     ingest_prs, review_payloads)

Q = {}
SQL = {}



# ---------------------------------------------------------------------------
# fixture inputs (Spark)
# ---------------------------------------------------------------------------

def _requests(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("pr_key"), F.concat(F.lit("org"), F.col("o_custkey").cast("string")).alias("repo_owner"),
                    F.concat(F.lit("repo"), (k % 10).cast("string")).alias("repo_name"),
                    (k + 1).cast("int").alias("pr_number"), (k % 2 == 0).alias("post_review"),
                    F.col("o_orderpriority").alias("title"))


def _pr_json(spark, sf):
    r = _requests(spark, sf)
    k = F.col("pr_key")
    sha = F.sha1(F.concat(F.lit("head"), k.cast("string")))
    rec = F.struct(F.col("pr_number").alias("number"), F.col("title").alias("title"),
                   F.lit(None).cast("string").alias("body"), F.lit("open").alias("state"),
                   F.struct(F.col("repo_owner").alias("login")).alias("user"),
                   F.struct(sha.alias("sha"), F.lit("feature").alias("ref")).alias("head"),
                   F.struct(F.sha1(F.concat(F.lit("base"), k.cast("string"))).alias("sha"),
                            F.lit("main").alias("ref")).alias("base"),
                   F.lit("").alias("diff_url"), F.lit("").alias("html_url"))
    js = (F.when(k % 37 == 0, F.lit("null"))
          .when(k % 41 == 0, F.to_json(F.struct(F.col("title").alias("title"),
                                                F.struct(sha.alias("sha")).alias("head"))))
          .otherwise(F.to_json(rec)))
    return r.select("pr_key", "pr_number", js.alias("json"))


def _files_json(spark, sf, part_size: int = 3):
    item = F.struct(F.col("filename").alias("filename"),
                    F.col("status").alias("status"), F.col("additions").alias("additions"),
                    F.lit(0).alias("deletions"), F.col("additions").alias("changes"),
                    F.lit(None).cast("string").alias("patch"), F.lit("").alias("contents_url"))
    return v4_lists(spark, sf, item, part_size)


def _contents(spark, sf):
    """Content records (repo, path, ref, content, encoding) at each PR head."""
    # the lines lie by pr_key: what is distinct before repo and ref are derived (another for each order) takes no second shuffle
    v = v4_pr_files(spark, sf).select("pr_key", "o_custkey", "filename", F.col("l_partkey").alias("p_partkey")).distinct()
    p = table(spark, sf, "part").select("p_partkey", "p_size", v7_code_expr().alias("code"))
    k = F.col("pr_key")
    repo = F.concat_ws("/", F.concat(F.lit("org"), F.col("o_custkey").cast("string")),
                       F.concat(F.lit("repo"), (k % 10).cast("string")))
    d = v.join(p, "p_partkey").select(repo.alias("repo"), F.col("filename").alias("path"),
                                      F.sha1(F.concat(F.lit("head"), k.cast("string"))).alias("ref"), "p_partkey", "code")
    pk = F.col("p_partkey")
    b64 = F.regexp_replace(F.base64(F.encode("code", "utf-8")), "(.{60})", "$1\n")
    content = (F.when(pk % 11 == 0, F.lit(""))
               .when(pk % 13 == 0, F.lit("/w==\n"))            # bytes that are not UTF-8
               .when(pk % 17 == 0, F.col("code"))               # already text
               .otherwise(b64))
    enc = F.when((pk % 11 != 0) & (pk % 13 != 0) & (pk % 17 == 0), F.lit("utf-8")).otherwise(F.lit("base64"))
    return d.select("repo", "path", "ref", "p_partkey", content.alias("content"), enc.alias("encoding"))


def _attached(spark, sf):
    """Requests, PR records, PR files and the eligible files with their text."""
    req = _requests(spark, sf)
    prs, files = ingest_prs(_pr_json(spark, sf), _files_json(spark, sf))
    prs = prs.join(req.select("pr_key", F.concat_ws("/", "repo_owner", "repo_name").alias("repo"), "post_review"),
                   "pr_key")
    contents = ingest_contents(_contents(spark, sf)).select("repo", "path", "ref", "code")
    att = attach_contents(files, prs, contents)
    return req, prs, files, att


def _pipeline(spark, sf, materialize: bool = True, keep_findings: bool = False):
    """The fixture inputs reviewed with the library's PR plan (default reviewers:
    without scanner reports or stored answers only the testing rules fire)."""
    req, prs, files, att = _attached(spark, sf)
    if materialize:  # the files' review, the rollup and the payloads read them
        prs = write_once(prs, "prs")
    contents = ingest_contents(_contents(spark, sf)).select("repo", "path", "ref", "code")
    out = review_prs(req, prs, files, contents, materialize=materialize, keep_findings=keep_findings)
    return req, prs, files, att, out.file_stats, out.findings, out


# ---------------------------------------------------------------------------
# oracle fixture (SQL)
# ---------------------------------------------------------------------------

_SQL_REQ = """req as (select o_orderkey as pr_key, 'org' || cast(o_custkey as varchar) as repo_owner,
  'repo' || cast(o_orderkey % 10 as varchar) as repo_name, cast(o_orderkey + 1 as int) as pr_number,
  o_orderkey % 2 = 0 as post_review, o_orderpriority as title, sha1('head' || cast(o_orderkey as varchar)) as head_sha
  from orders)"""

_SQL_PR = "with " + SQL_V7_TESTING + ", " + SQL_V4 + ", " + _SQL_REQ + """,
ef as (select v4.pr_key, v4.file_ord, v4.filename, v4.l_partkey from v4
       where status <> 'removed' and ends_with(filename, '.py') and v4.pr_key % 37 <> 0
         and l_partkey % 11 <> 0 and l_partkey % 13 <> 0),
lines as (select review_id as p, 2 + 2 * n_if + 2 * cast(has_for as int) + 4 * cast(has_try as int)
            + 6 * cast(has_class as int) + cast(broken as int) as total_lines from v7a where not is_test),
pf as (select ef.pr_key, ef.file_ord, ef.filename as file_path, tf.line_number, tf.severity, tf.category, tf.message,
         tf.suggestion, tf.confidence, tf.source_ord,
         case tf.severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as sr
       from ef join tf on tf.review_id = ef.l_partkey),
pr as (select *, row_number() over (partition by pr_key, file_ord order by sr, line_number, source_ord) as rank from pf)"""


# --- S3 ----------------------------------------------------------------------
def q_validate_pr_requests(spark, sf):
    r = _requests(spark, sf)
    k = F.col("pr_key")
    bad = r.select("pr_key",
                   F.when(k % 19 == 0, F.lit("")).otherwise(F.col("repo_owner")).alias("repo_owner"),
                   F.when(k % 23 == 0, F.lit("")).otherwise(F.col("repo_name")).alias("repo_name"),
                   F.when(k % 29 == 0, F.lit(0)).otherwise(F.col("pr_number")).alias("pr_number"))
    ok, rej = validate_pr_requests(bad)
    return ok.select("pr_key", "full_repo_name", F.lit(None).cast("string").alias("reason")) \
        .unionByName(rej.select("pr_key", "full_repo_name", "reason"))


Q["validate_pr_requests"] = q_validate_pr_requests
SQL["validate_pr_requests"] = "with " + _SQL_REQ + """,
b as (select pr_key, case when pr_key % 19 = 0 then '' else repo_owner end as o,
        case when pr_key % 23 = 0 then '' else repo_name end as n,
        case when pr_key % 29 = 0 then 0 else pr_number end as num from req)
select pr_key, o || '/' || n as full_repo_name,
  case when length(o) < 1 then 'repo_owner: should have at least 1 character'
       when length(n) < 1 then 'repo_name: should have at least 1 character'
       when num < 1 then 'pr_number: should be greater than or equal to 1' end as reason
from b"""


# --- S8 ----------------------------------------------------------------------
def q_ingest_prs(spark, sf):
    prs, files = ingest_prs(_pr_json(spark, sf), _files_json(spark, sf))
    j = files.join(prs, "pr_key", "left")
    return j.select("pr_key", F.col("number").cast("bigint").alias("number"), "title", "state", "user", "head_sha",
                    "base_ref", "file_ord", "filename", "status", F.col("additions").cast("bigint").alias("additions"),
                    F.col("deletions").cast("bigint").alias("deletions"),
                    F.col("changes").cast("bigint").alias("changes"))


Q["ingest_prs"] = q_ingest_prs
SQL["ingest_prs"] = "with " + SQL_V4 + ", " + _SQL_REQ + """
select v4.pr_key,
  case when v4.pr_key % 37 = 0 then null else cast(req.pr_number as bigint) end as number,
  case when v4.pr_key % 37 = 0 then null else req.title end as title,
  case when v4.pr_key % 37 = 0 then null else 'open' end as state,
  case when v4.pr_key % 37 = 0 then null when v4.pr_key % 41 = 0 then '' else req.repo_owner end as "user",
  case when v4.pr_key % 37 = 0 then null else req.head_sha end as head_sha,
  case when v4.pr_key % 37 = 0 then null when v4.pr_key % 41 = 0 then '' else 'main' end as base_ref,
  v4.file_ord, v4.filename, v4.status, cast(v4.additions as bigint) as additions, cast(0 as bigint) as deletions,
  cast(v4.additions as bigint) as changes
from v4 join req on req.pr_key = v4.pr_key"""


# --- S9 ----------------------------------------------------------------------
def q_ingest_contents(spark, sf):
    c = ingest_contents(_contents(spark, sf))
    return c.select("repo", "path", "ref", "encoding", F.md5("code").alias("md5"),
                    F.length("code").cast("bigint").alias("n_chars"))


_SQL_V7_CODE = """('def f_' || cast(p_partkey as varchar) || '(' || substring('a0, a1, a2, a3, a4, a5', 1, cast(4 * (1 + p_partkey % 6) - 2 as int))
  || '):' || chr(10) || repeat('    if a0:' || chr(10) || '        pass' || chr(10), cast(p_size % 8 as int))
  || case when p_size % 3 = 0 then '    for i in a0:' || chr(10) || '        pass' || chr(10) else '' end
  || case when p_partkey % 4 = 0 then '    try:' || chr(10) || '        x = a0 and a0 or a0' || chr(10)
       || '    except ValueError:' || chr(10) || '        pass' || chr(10) else '' end
  || '    return a0' || chr(10)
  || case when p_partkey % 5 = 0 then 'class C_' || cast(p_partkey as varchar) || ':' || chr(10)
       || '    def m(self, a, b, c, d):' || chr(10) || '        return a' || chr(10)
       || '    async def am(self):' || chr(10) || '        while a0:' || chr(10) || '            pass' || chr(10) else '' end
  || case when p_partkey % 50 = 0 then 'def broken(' else '' end)"""

Q["ingest_contents"] = q_ingest_contents
SQL["ingest_contents"] = "with " + SQL_V4 + ", " + _SQL_REQ + f""",
d as (select distinct req.repo_owner || '/' || req.repo_name as repo, v4.filename as path, req.head_sha as ref,
        v4.l_partkey as p_partkey from v4 join req on req.pr_key = v4.pr_key),
c as (select d.*, {_SQL_V7_CODE} as code from d join part using (p_partkey))
select repo, path, ref, case when p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 17 = 0 then 'utf-8'
                             else 'base64' end as encoding,
  case when p_partkey % 11 = 0 then md5('') when p_partkey % 13 = 0 then null else md5(code) end as md5,
  cast(case when p_partkey % 11 = 0 then 0 when p_partkey % 13 = 0 then null else length(code) end as bigint) as n_chars
from c"""


# --- S10 ---------------------------------------------------------------------
def _comments_json(spark, sf, part_size: int = 3):
    item = F.struct((F.col("pr_key") * 100 + F.col("file_ord")).alias("id"),
                    F.col("filename").alias("path"), F.col("additions").alias("line"),
                    F.concat(F.lit("Please check "), F.col("filename")).alias("body"),
                    F.struct(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("login")).alias("user"),
                    F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    js = F.when(F.col("pr_key") % 5 == 0, F.to_json(F.struct(F.lit("Not Found").alias("message")))) \
        .otherwise(F.col("json"))
    return v4_lists(spark, sf, item, part_size).select("pr_key", "part", js.alias("json"))


def q_ingest_comments(spark, sf):
    c = ingest_pr_comments(_comments_json(spark, sf))
    return c.select("pr_key", "comment_ord", "comment_id", "path", F.col("line").cast("bigint").alias("line"),
                    "body", "user")


Q["ingest_comments"] = q_ingest_comments
SQL["ingest_comments"] = "with " + SQL_V4 + """
select pr_key, file_ord as comment_ord, pr_key * 100 + file_ord as comment_id, filename as path,
  cast(additions as bigint) as line, 'Please check ' || filename as body, 'u' || cast(l_suppkey as varchar) as "user"
from v4 where pr_key % 5 <> 0"""


# --- F1 ----------------------------------------------------------------------
def q_eligible_files(spark, sf):
    return eligible_files(v4_pr_files(spark, sf)).select("pr_key", "file_ord", "filename", "status")


Q["eligible_files"] = q_eligible_files
SQL["eligible_files"] = "with " + SQL_V4 + """
select pr_key, file_ord, filename, status from v4 where status <> 'removed' and ends_with(filename, '.py')"""


# --- J3 / F2 -------------------------------------------------------------------
def q_pr_contents(spark, sf):
    _, _, _, att = _attached(spark, sf)
    return att.select("pr_key", "file_ord", "filename", F.md5("code").alias("md5"))


Q["pr_contents"] = q_pr_contents
SQL["pr_contents"] = "with " + SQL_V4 + ", " + _SQL_REQ + f""",
ef as (select v4.pr_key, v4.file_ord, v4.filename, v4.l_partkey from v4
       where status <> 'removed' and ends_with(filename, '.py') and v4.pr_key % 37 <> 0
         and l_partkey % 11 <> 0 and l_partkey % 13 <> 0)
select ef.pr_key, ef.file_ord, ef.filename, md5({_SQL_V7_CODE}) as md5
from ef join part on part.p_partkey = ef.l_partkey"""


# --- A10 + T8 ------------------------------------------------------------------
def q_pr_rollup(spark, sf):
    req, prs, _, _, stats, findings, _ = _pipeline(spark, sf)
    out = pr_rollup(req, prs, stats, findings)
    return out.select("pr_key", "status", "files_analyzed", "total_lines", "n_findings", "n_critical", "n_high",
                      "n_medium", "n_low", "n_info", "overall_score")


def _sev_list_sql(c, h, m, lo):
    return (f"concat_ws(', ', case when {c} > 0 then concat({c}, ' critical') end, "
            f"case when {h} > 0 then concat({h}, ' high') end, "
            f"case when {m} > 0 then concat({m}, ' medium') end, "
            f"case when {lo} > 0 then concat({lo}, ' low') end)")


_SQL_ROLL = _SQL_PR + """,
fl as (select ef.pr_key, count(*) as files_analyzed, sum(lines.total_lines) as total_lines
       from ef join lines on lines.p = ef.l_partkey group by ef.pr_key),
fa as (select pr_key, count(*) as n_findings, count_if(severity = 'critical') as n_critical,
         count_if(severity = 'high') as n_high, count_if(severity = 'medium') as n_medium,
         count_if(severity = 'low') as n_low, count_if(severity = 'info') as n_info,
         sum(cast(case severity when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0
           when 'low' then 1.0 when 'info' then 0.5 else 1.0 end as decimal(4,1)) * cast(confidence as decimal(3,2))) as ded
       from pf group by pr_key),
ro as (select req.pr_key, req.pr_number, req.title, req.repo_owner, req.repo_name, req.post_review, req.head_sha,
         req.pr_key % 37 <> 0 as ok, req.pr_key % 41 = 0 as sparse,
         cast(coalesce(fl.files_analyzed, 0) as bigint) as files_analyzed, cast(coalesce(fl.total_lines, 0) as bigint) as total_lines,
         cast(coalesce(n_findings, 0) as bigint) as n_findings, cast(coalesce(n_critical, 0) as bigint) as n_critical,
         cast(coalesce(n_high, 0) as bigint) as n_high, cast(coalesce(n_medium, 0) as bigint) as n_medium,
         cast(coalesce(n_low, 0) as bigint) as n_low, cast(coalesce(n_info, 0) as bigint) as n_info,
         case when ded is null then 100.0 else greatest(cast(0 as double), cast(round(cast(100 as decimal(4,1)) - ded, 1) as double)) end as overall_score
       from req left join fl on fl.pr_key = req.pr_key left join fa on fa.pr_key = req.pr_key)"""

Q["pr_rollup"] = q_pr_rollup
SQL["pr_rollup"] = _SQL_ROLL + """
select pr_key, case when ok then 'completed' else 'failed' end as status,
  case when ok then files_analyzed else 0 end as files_analyzed, case when ok then total_lines else 0 end as total_lines,
  case when ok then n_findings else 0 end as n_findings, case when ok then n_critical else 0 end as n_critical,
  case when ok then n_high else 0 end as n_high, case when ok then n_medium else 0 end as n_medium,
  case when ok then n_low else 0 end as n_low, case when ok then n_info else 0 end as n_info,
  case when ok then overall_score else 100.0 end as overall_score
from ro"""


def q_pr_summary(spark, sf):
    req, prs, _, _, stats, findings, _ = _pipeline(spark, sf)
    return pr_rollup(req, prs, stats, findings).select("pr_key", "summary")


_SQL_PR_SUMMARY = f"""case when not ok then 'Could not fetch PR #' || cast(pr_number as varchar) || ' from ' || repo_owner || '/' || repo_name
       when n_findings = 0 then '✅ Code review completed for PR #' || cast(pr_number as varchar) || ': '
         || case when sparse then title else title end || chr(10) || 'No issues found. Score: ' || printf('%.1f', overall_score) || '/100'
       else 'Code review completed for PR #' || cast(pr_number as varchar) || ': ' || title || chr(10) || 'Found '
         || cast(n_findings as varchar) || ' issues (' || {_sev_list_sql('n_critical', 'n_high', 'n_medium', 'n_low')}
         || ' severity).' || chr(10) || 'Score: ' || printf('%.1f', overall_score) || '/100' end"""

Q["pr_summary"] = q_pr_summary
SQL["pr_summary"] = _SQL_ROLL + f"""
select pr_key, {_SQL_PR_SUMMARY} as summary from ro"""


# --- W4 ----------------------------------------------------------------------
def q_first20_comments(spark, sf):
    _, _, _, _, _, findings, _ = _pipeline(spark, sf, materialize=False)
    c = comment_rows(findings, 20)
    return c.select("pr_key", F.col("comment_ord").cast("bigint").alias("comment_ord"), "file_path", "line_number",
                    "severity", F.md5("body").alias("md5"))


_SQL_BODY = (f"{sql_case('severity', TX.COMMENT_ICONS, TX.COMMENT_ICON_DEFAULT)} || ' **' || upper(severity) || '** - '"
             " || category || chr(10) || chr(10) || message || chr(10) || chr(10)"
             " || case when length(suggestion) > 0 then '**Suggestion:** ' || suggestion || chr(10) else '' end")

Q["first20_comments"] = q_first20_comments
SQL["first20_comments"] = _SQL_PR + f""",
c as (select *, row_number() over (partition by pr_key order by file_ord, rank) as comment_ord from pr)
select pr_key, cast(comment_ord as bigint) as comment_ord, file_path, line_number, severity, md5({_SQL_BODY}) as md5
from c where comment_ord <= 20"""


# --- S13 ---------------------------------------------------------------------
def q_review_payloads(spark, sf):
    *_, out = _pipeline(spark, sf, keep_findings=True)
    # parsed in a column of its own: a field taken from the call has the payload parsed for that field
    parsed = F.from_json("payload", "commit_id string, body string, event string, "
                                    "comments array<struct<path string, line int, body string>>")
    p = out.payloads.select("pr_key", "payload", parsed.alias("p"))
    return p.select("pr_key", F.md5("payload").alias("md5"), F.col("p.commit_id").alias("commit_id"),
                    F.col("p.event").alias("event"), F.size("p.comments").cast("bigint").alias("n_comments"))


Q["review_payloads"] = q_review_payloads
SQL["review_payloads"] = _SQL_ROLL + f""",
c as (select *, row_number() over (partition by pr_key order by file_ord, rank) as comment_ord from pr),
cj as (select pr_key, list(json_object('path', file_path, 'line', line_number, 'body', {_SQL_BODY}) order by comment_ord) as cs,
         count(*) as n from c where comment_ord <= 20 group by pr_key)
select ro.pr_key, md5(json_object('commit_id', head_sha, 'body', {_SQL_PR_SUMMARY}, 'event', 'COMMENT',
    'comments', cs)::varchar) as md5, head_sha as commit_id, 'COMMENT' as event, cast(n as bigint) as n_comments
from ro join cj on cj.pr_key = ro.pr_key
where ok and post_review and n_findings > 0"""


# --- S14 ---------------------------------------------------------------------
def q_comment_payloads(spark, sf):
    _, prs, _, _, _, findings, _ = _pipeline(spark, sf, materialize=False)
    p = comment_payloads(findings, prs.select("pr_key", "head_sha"))
    return p.select("pr_key", "file_path", "line_number", F.md5("payload").alias("md5"))


Q["comment_payloads"] = q_comment_payloads
SQL["comment_payloads"] = _SQL_PR + f"""
select pf.pr_key, file_path, line_number, md5(json_object('body', {_SQL_BODY}, 'commit_id', req.head_sha,
  'path', file_path, 'line', line_number, 'side', 'RIGHT')::varchar) as md5
from pf join req on req.pr_key = pf.pr_key"""
