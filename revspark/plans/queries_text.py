"""Registered queries over V1 files and derived text: A11, T2-T9, M11, M12, F3, S2, J7, J8, A9."""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.functions import lookups as L
from revspark.functions import text as TX
from revspark.operators import aggregates as A
from revspark.operators.enrich import with_context
from revspark.operators.normalize import quality_findings, security_findings
from revspark.operators.reviewers import ReviewInputs, is_test_file, rule_scan
from revspark.plans.fixtures import (SCAN_RULES, SQL_V6_PAGES, v6_files, SQL_V1, SQL_V2, SQL_V2_DEDUP, SQL_V3_RAW, SQL_V4, v1_files,
                                     v2_findings, v2_total_lines, v3_raw, v4_pr_files)
from revspark.plans.queries_ingest import sql_case
from revspark.plans.review import review_files
from revspark.sources.files import validate_submissions

Q = {}
SQL = {}

# DuckDB: Python-style splitlines for the fixture text (only \n, \r\n, \r occur)
SQL_V1_LINES = SQL_V1 + """,
v1a as (select review_id, file_path, code, string_split_regex(code, '\\r\\n|\\n|\\r') as arr from v1),
v1l as (select review_id, file_path, code,
          case when arr[-1] = '' then arr[1:len(arr) - 1] else arr end as ls from v1a)"""


# --- A11 ---------------------------------------------------------------------
def q_line_metrics(spark, sf):
    m = A.line_metrics(v1_files(spark, sf))
    return m.select("review_id", *[F.col(c).cast("bigint").alias(c) for c in
                                   ("total_lines", "blank_lines", "comment_lines", "code_lines")])


Q["line_metrics"] = q_line_metrics
SQL["line_metrics"] = "with " + SQL_V1_LINES + """,
m as (select review_id, len(ls) as t, len(list_filter(ls, lambda x: trim(x) = '')) as b,
        len(list_filter(ls, lambda x: starts_with(trim(x), '#'))) as c from v1l)
select review_id, cast(t as bigint) as total_lines, cast(b as bigint) as blank_lines,
  cast(c as bigint) as comment_lines, cast(t - b - c as bigint) as code_lines from m"""


# --- T2 ----------------------------------------------------------------------
def q_sanitize(spark, sf):
    v = v1_files(spark, sf)
    both = TX.let(TX.sanitize(F.col("code")), lambda s: F.struct(F.length(s).cast("bigint").alias("n_chars"),
                                                                 F.md5(s).alias("md5")))
    return v.select("review_id", both.alias("s")).select("review_id", "s.*")


Q["sanitize"] = q_sanitize
SQL["sanitize"] = f"""with {SQL_V1},
a as (select review_id, string_split(replace(replace(replace(code, chr(0), ''), chr(13) || chr(10), chr(10)),
        chr(13), chr(10)), chr(10)) as arr from v1),
b as (select review_id, array_to_string(list_transform(
        case when arr[-1] = '' then arr[1:len(arr) - 1] else arr end, lambda x: rtrim(x)), chr(10)) as j from a),
c as (select review_id, case when length(j) > 0 and not ends_with(j, chr(10)) then j || chr(10) else j end as s from b)
select review_id, cast(length(s) as bigint) as n_chars, md5(s) as md5 from c"""


# --- T3 ----------------------------------------------------------------------
def q_truncate(spark, sf):
    t = TX.truncate(F.col("code"), 500, "...")
    return v1_files(spark, sf).select("review_id", F.length(t).cast("bigint").alias("n_chars"),
                                      F.md5(t).alias("md5"))


Q["truncate"] = q_truncate
SQL["truncate"] = f"""with {SQL_V1},
t as (select review_id, case when length(code) <= 500 then code else substring(code, 1, 497) || '...' end as s from v1)
select review_id, cast(length(s) as bigint) as n_chars, md5(s) as md5 from t"""


# --- J7 / T4 -------------------------------------------------------------------
def q_context_blocks(spark, sf):
    files = v1_files(spark, sf)
    f = files.select("review_id", "file_path", (1 + F.col("review_id") % 4).cast("int").alias("line_number")) \
        .unionByName(files.select("review_id", "file_path",
                                  (2 + F.col("review_id") % 5).cast("int").alias("line_number")))
    c3 = with_context(f, files, 3, "bar").withColumnRenamed("context", "ctx3")
    c5 = with_context(f.select("review_id", "file_path", "line_number").distinct(), files, 5, "colon") \
        .withColumnRenamed("context", "ctx5")
    j = c3.join(c5, ["review_id", "file_path", "line_number"], "left")
    return j.select("review_id", F.col("line_number").cast("bigint").alias("line_number"),
                    F.md5("ctx3").alias("md5_bar"), F.md5("ctx5").alias("md5_colon"))


def _ctx_sql(k, fmt):
    body = ("printf('%4d | %s', s + i - 1, x)" if fmt == "bar" else "printf('%d: %s', s + i - 1, x)")
    return (f"array_to_string(list_transform(ls[greatest(1, line_number - {k}):least(len(ls), line_number + {k})], "
            f"lambda x, i: (case when greatest(1, line_number - {k}) + i - 1 = line_number then '>>> ' else '    ' end) "
            f"|| {body.replace('s + i', f'greatest(1, line_number - {k}) + i')}), chr(10))")


Q["context_blocks"] = q_context_blocks
SQL["context_blocks"] = "with " + SQL_V1_LINES + f""",
f as (select review_id, 1 + review_id % 4 as line_number from v1 union all
      select review_id, 2 + review_id % 5 from v1)
select f.review_id, cast(f.line_number as bigint) as line_number,
  md5({_ctx_sql(3, 'bar')}) as md5_bar, md5({_ctx_sql(5, 'colon')}) as md5_colon
from f join v1l using (review_id)"""


# --- M12 ---------------------------------------------------------------------
def q_detect_language(spark, sf):
    v = v1_files(spark, sf)
    return v.select("review_id", L.detect_language(F.col("file_path"), F.col("code")).alias("language"))


Q["detect_language"] = q_detect_language
SQL["detect_language"] = f"""with {SQL_V1},
e as (select review_id, code, regexp_extract(lower(file_path), '(\\.[^.]*)$', 1) as ext from v1)
select review_id, coalesce({sql_case('ext', L.LANGUAGE_BY_EXTENSION, 'NULL').replace("'NULL'", 'NULL')},
  case when length(code) = 0 then null
       when starts_with(code, '#!/') and contains(split_part(code, chr(10), 1), 'python') then 'python'
       when starts_with(code, '#!/') and (contains(split_part(code, chr(10), 1), 'node')
            or contains(split_part(code, chr(10), 1), 'js')) then 'javascript'
       when starts_with(code, '#!/') and contains(split_part(code, chr(10), 1), 'ruby') then 'ruby'
       when starts_with(code, '#!/') and (contains(split_part(code, chr(10), 1), 'bash')
            or contains(split_part(code, chr(10), 1), 'sh')) then 'shell'
       when contains(code, 'def ') and contains(code, 'import ') then 'python'
       when contains(code, 'function ') and (contains(code, 'const ') or contains(code, 'let ')
            or contains(code, 'var ')) then 'javascript' end,
  'unknown') as language
from e"""


# --- M11 ---------------------------------------------------------------------
def _raw_language(c_id, lang):
    core = (F.when(c_id % 6 == 0, F.lit("PY")).when(c_id % 6 == 1, F.lit("js")).when(c_id % 6 == 2, F.lit("Go"))
            .when(c_id % 6 == 3, F.lit("cpp")).when(c_id % 6 == 4, F.lit("Rust")).otherwise(lang))
    return F.concat(F.when(c_id % 3 == 0, F.lit(" ")).otherwise(F.lit("")), core,
                    F.when(c_id % 4 == 0, F.lit("  ")).otherwise(F.lit("")))


_SQL_RAW_LANG = ("concat(case when doc_id % 3 = 0 then ' ' else '' end, case doc_id % 6 when 0 then 'PY' "
                 "when 1 then 'js' when 2 then 'Go' when 3 then 'cpp' when 4 then 'Rust' else lang end, "
                 "case when doc_id % 4 = 0 then '  ' else '' end)")


def q_normalize_language(spark, sf):
    from revspark.plans.fixtures import table
    d = table(spark, sf, "documents")
    raw = _raw_language(F.col("doc_id"), F.col("lang"))
    return (d.select(raw.alias("raw_language"))
            .groupBy("raw_language", L.normalize_language(F.col("raw_language")).alias("language"))
            .agg(F.count(F.lit(1)).alias("n")))


Q["normalize_language"] = q_normalize_language
SQL["normalize_language"] = f"""with r as (select {_SQL_RAW_LANG} as raw_language from documents)
select raw_language, {sql_case('lower(trim(raw_language))', L.LANGUAGE_ALIASES, '@@')
                      .replace("'@@'", 'lower(trim(raw_language))')} as language,
  cast(count(*) as bigint) as n from r group by all"""


# --- F3 ----------------------------------------------------------------------
def _path_variants(spark, sf):
    v4 = v4_pr_files(spark, sf)
    ln = F.col("l_linenumber")
    p = (F.when(ln == 1, F.concat(F.lit("tests/"), F.col("filename")))
         .when(ln == 2, F.regexp_replace("filename", r"\.py$", "_test.py"))
         .when(ln == 3, F.regexp_replace("filename", r"\.py$", "_spec.py"))
         .when(ln == 4, F.regexp_replace("filename", "src/f_", "src/latest_"))
         .otherwise(F.col("filename")))
    return v4.select(p.alias("path")).unionByName(v1_files(spark, sf).select(F.col("file_path").alias("path")))


def q_is_test_file(spark, sf):
    return (_path_variants(spark, sf).groupBy("path", is_test_file(F.col("path")).alias("is_test"))
            .agg(F.count(F.lit(1)).alias("n")))


Q["is_test_file"] = q_is_test_file
SQL["is_test_file"] = f"""with {SQL_V4}, {SQL_V1},
p as (select case l_linenumber when 1 then 'tests/' || filename
                               when 2 then regexp_replace(filename, '\\.py$', '_test.py')
                               when 3 then regexp_replace(filename, '\\.py$', '_spec.py')
                               when 4 then replace(filename, 'src/f_', 'src/latest_')
                               else filename end as path from v4
      union all select file_path from v1)
select path, regexp_matches(path, 'test_.*\\.py$|.*_test\\.py$|tests?/.*\\.py$|.*_spec\\.py$') as is_test,
  cast(count(*) as bigint) as n from p group by all"""


# --- S2 ----------------------------------------------------------------------
def q_validate_submissions(spark, sf):
    from revspark.plans.fixtures import table
    d = table(spark, sf, "documents")
    v = v1_files(spark, sf).join(d.select(F.col("doc_id").alias("review_id"), "lang"), "review_id")
    rid = F.col("review_id")
    sub = v.select(
        "review_id",
        F.when(rid % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("file_path")).alias("file_path"),
        F.when(rid % 11 == 0, F.lit(None).cast("string")).otherwise(_raw_language(rid, F.col("lang")))
        .alias("language"),
        F.when(rid % 10 == 0, F.lit(""))
        .when(rid % 97 == 0, F.repeat(F.col("code"), (F.lit(1000001) / F.length("code")).cast("int") + 1))
        .otherwise(F.col("code")).alias("code"))
    ok, rej = validate_submissions(sub)
    cols = ["review_id", "file_path", "language", F.octet_length("code").cast("bigint").alias("n_bytes")]
    return ok.select(*cols, F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(rej.select(*cols, F.lit("rejected").alias("status"), "reason"))


Q["validate_submissions"] = q_validate_submissions
SQL["validate_submissions"] = f"""with {SQL_V1},
s as (select v1.review_id, case when v1.review_id % 7 = 0 then null else file_path end as file_path,
        case when v1.review_id % 11 = 0 then null else {_SQL_RAW_LANG.replace('doc_id', 'v1.review_id')} end as language,
        case when v1.review_id % 10 = 0 then ''
             when v1.review_id % 97 = 0 then repeat(code, cast(floor(1000001 / length(code)) as int) + 1)
             else code end as code
      from v1 join documents d on d.doc_id = v1.review_id)
select review_id, coalesce(file_path, 'untitled.py') as file_path,
  coalesce({sql_case('lower(trim(language))', L.LANGUAGE_ALIASES, '@@').replace("'@@'", 'lower(trim(language))')},
           'python') as language,
  cast(octet_length(encode(code)) as bigint) as n_bytes,
  case when length(code) < 1 or octet_length(encode(code)) > 1000000 then 'rejected' else 'accepted' end as status,
  case when length(code) < 1 then 'code: should have at least 1 character'
       when octet_length(encode(code)) > 1000000 then 'code: size exceeds maximum of 1000000 bytes' end as reason
from s"""


# --- T5 / T6 -------------------------------------------------------------------
def _v3_findings(spark, sf):
    r = v3_raw(spark, sf)
    return quality_findings(r).unionByName(security_findings(r))


def q_finding_markdown(spark, sf):
    f = _v3_findings(spark, sf)
    md = TX.finding_markdown("severity", "category", "file_path", "line_number", "message", "suggestion",
                             "code_snippet", "rule_id", "owasp_category")
    return f.select("review_id", "file_path", "agent_name", "source_ord", "item_ord", F.md5(md).alias("md5"))


def q_finding_comment(spark, sf):
    f = _v3_findings(spark, sf)
    c = TX.finding_comment("severity", "category", "message", "suggestion", "rule_id")
    return f.select("review_id", "file_path", "agent_name", "source_ord", "item_ord", F.md5(c).alias("md5"))


def _opt_sql(c, before, after):
    return f"(case when {c} is not null and length({c}) > 0 then '{before}' || {c} || '{after}' else '' end)"


_SQL_V3F = SQL_V3_RAW + f""",
f as (select review_id, file_path, 'QualityAgent' as agent_name, case tool when 'ruff' then 0 else 1 end as source_ord,
        item_ord, line_number, {sql_case('rule_code', L.QUALITY_SEVERITY, 'medium', 'prefix')} as severity,
        {sql_case('rule_code', L.QUALITY_CATEGORY, 'code_smell', 'exact_prefix')} as category, message,
        coalesce(suggestion, '') as suggestion, tool || ':' || rule_code as rule_id,
        cast(null as varchar) as code_snippet, cast(null as varchar) as owasp_category
      from v3r where tool in ('ruff', 'pylint')
      union all
      select review_id, file_path, 'SecurityAgent', 0, item_ord, line_number,
        {sql_case('tool_severity', L.BANDIT_SEVERITY, 'high')}, {sql_case('rule_code', L.BANDIT_CATEGORY, 'injection')},
        message, '', 'bandit:' || rule_code, code_snippet, {sql_case('rule_code', L.BANDIT_OWASP, L.DEFAULT_OWASP)}
      from v3r where tool = 'bandit')"""

_NL = "' || chr(10) || '"
Q["finding_markdown"] = q_finding_markdown
SQL["finding_markdown"] = "with " + _SQL_V3F + f"""
select review_id, file_path, agent_name, source_ord, item_ord, md5(
  '### ' || {sql_case('severity', TX.MARKDOWN_ICONS, TX.MARKDOWN_ICON_DEFAULT)} || ' ' || upper(severity) || ': '
  || category || chr(10) || chr(10) || '**File:** `' || file_path || '` (line ' || cast(line_number as varchar)
  || ')' || chr(10) || chr(10) || '**Issue:** ' || message || chr(10) || chr(10)
  || {_opt_sql('suggestion', '**Suggestion:** ', _NL + _NL)}
  || {_opt_sql('code_snippet', '```python' + _NL, _NL + '```' + _NL + _NL)}
  || {_opt_sql('rule_id', '_Rule: ', '_' + _NL)}
  || {_opt_sql('owasp_category', '_OWASP: ', '_' + _NL)}) as md5
from f"""

Q["finding_comment"] = q_finding_comment
SQL["finding_comment"] = "with " + _SQL_V3F + f"""
select review_id, file_path, agent_name, source_ord, item_ord, md5(
  {sql_case('severity', TX.COMMENT_ICONS, TX.COMMENT_ICON_DEFAULT)} || ' **' || upper(severity) || '** - ' || category
  || chr(10) || chr(10) || message || chr(10) || chr(10)
  || {_opt_sql('suggestion', '**Suggestion:** ', _NL)}
  || {_opt_sql('rule_id', _NL + '_Rule: ', '_')}) as md5
from f"""


# --- T9 ----------------------------------------------------------------------
def _pr_refs(spark, sf):
    from revspark.plans.fixtures import table
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    n = (k + 1).cast("string")
    repo = F.concat(F.lit("repo"), (k % 10).cast("string"))
    ref = (F.when(k % 7 == 0, F.concat(F.lit("org"), c, F.lit("/"), repo, F.lit("#"), n))
           .when(k % 7 == 1, F.concat(F.lit("https://github.com/org"), c, F.lit("/"), repo, F.lit("/pull/"), n))
           .when(k % 7 == 2, F.concat(F.lit("github.com/org"), c, F.lit("/"), repo, F.lit("/pull/"), n))
           .when(k % 7 == 3, F.concat(F.lit("https://gitlab.com/org"), c, F.lit("/"), repo, F.lit("/pull/"), n))
           .when(k % 7 == 4, F.concat(F.lit("https://github.com/org"), c, F.lit("/"), repo, F.lit("/issues/"), n))
           .when(k % 7 == 5, F.concat(F.lit("  org"), c, F.lit("/"), repo, F.lit("#"), n, F.lit(" ")))
           .otherwise(F.concat(F.lit("https://github.com/org"), c, F.lit("/"), repo, F.lit("/pull/x"), n)))
    pages = table(spark, sf, "pages").select(F.col("url").alias("ref"))
    return o.select(ref.alias("ref")).unionByName(pages)


def q_parse_pr_ref(spark, sf):
    r = _pr_refs(spark, sf)
    p = TX.parse_pr_ref(F.col("ref"))
    return r.select("ref", p["owner"].alias("owner"), p["repo"].alias("repo"),
                    p["pr_number"].cast("bigint").alias("pr_number"))


Q["parse_pr_ref"] = q_parse_pr_ref
SQL["parse_pr_ref"] = r"""with o as (select o_orderkey as k, cast(o_custkey as varchar) as c, cast(o_orderkey + 1 as varchar) as n,
        'repo' || cast(o_orderkey % 10 as varchar) as repo from orders),
r as (select case k % 7 when 0 then 'org' || c || '/' || repo || '#' || n
                        when 1 then 'https://github.com/org' || c || '/' || repo || '/pull/' || n
                        when 2 then 'github.com/org' || c || '/' || repo || '/pull/' || n
                        when 3 then 'https://gitlab.com/org' || c || '/' || repo || '/pull/' || n
                        when 4 then 'https://github.com/org' || c || '/' || repo || '/issues/' || n
                        when 5 then '  org' || c || '/' || repo || '#' || n || ' '
                        else 'https://github.com/org' || c || '/' || repo || '/pull/x' || n end as ref from o
      union all select url from pages),
s as (select ref, trim(ref) as t,
        case when starts_with(ref, 'http://') or starts_with(ref, 'https://') then ref else 'https://' || ref end as u
      from r),
p as (select ref, t, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) as host,
        string_split(trim(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') as parts from s)
select ref,
  case when regexp_matches(t, '^([^/]+)/([^#]+)#([0-9]+)$') then regexp_extract(t, '^([^/]+)/([^#]+)#([0-9]+)$', 1)
       when contains(host, 'github') and len(parts) >= 4 and parts[3] = 'pull' and try_cast(parts[4] as int) is not null
       then parts[1] end as owner,
  case when regexp_matches(t, '^([^/]+)/([^#]+)#([0-9]+)$') then regexp_extract(t, '^([^/]+)/([^#]+)#([0-9]+)$', 2)
       when contains(host, 'github') and len(parts) >= 4 and parts[3] = 'pull' and try_cast(parts[4] as int) is not null
       then parts[2] end as repo,
  cast(case when regexp_matches(t, '^([^/]+)/([^#]+)#([0-9]+)$') then try_cast(regexp_extract(t, '^([^/]+)/([^#]+)#([0-9]+)$', 3) as int)
       when contains(host, 'github') and len(parts) >= 4 and parts[3] = 'pull' then try_cast(parts[4] as int) end as bigint) as pr_number
from p"""


# --- J8 ----------------------------------------------------------------------
def q_rule_scan(spark, sf):
    s = rule_scan(v6_files(spark, sf), SCAN_RULES)
    return s.select("review_id", F.col("line_number").cast("bigint").alias("line_number"), "rule_id", "severity")


def _scan_sql(src_lines):
    parts = []
    for rid, rx, cat, sev, owasp, conf in SCAN_RULES:
        parts.append(f"select review_id, file_path, line_number, '{rid}' as rule_id, '{cat}' as category, "
                     f"'{sev}' as severity, '{owasp}' as owasp_category, {conf} as confidence, line "
                     f"from {src_lines} where regexp_matches(line, '{rx.replace(chr(39), chr(39) * 2)}')")
    return " union all ".join(parts)


SQL_V1_SCAN = SQL_V1_LINES + """,
l as (select review_id, file_path, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as line_number from v1l),
sc as (""" + _scan_sql("l") + ")"

Q["rule_scan"] = q_rule_scan
SQL["rule_scan"] = "with " + SQL_V1_SCAN + ", " + SQL_V6_PAGES + ", sp as (" + _scan_sql("v6l") + """)
select review_id, cast(line_number as bigint) as line_number, rule_id, severity
from (select * from sc union all select * from sp)"""


# --- A9 ----------------------------------------------------------------------
def q_corpus_review(spark, sf):
    out = review_files(ReviewInputs(files=v1_files(spark, sf), scan_rules=SCAN_RULES))
    return out.file_reviews.select("review_id", "file_path", F.col("total_lines").cast("bigint").alias("total_lines"),
                                   "n_findings", *A.COUNT_COLUMNS, "overall_score", "summary")


def _sev_list_sql(c, h, m, lo):
    return (f"concat_ws(', ', case when {c} > 0 then concat({c}, ' critical') end, "
            f"case when {h} > 0 then concat({h}, ' high') end, "
            f"case when {m} > 0 then concat({m}, ' medium') end, "
            f"case when {lo} > 0 then concat({lo}, ' low') end)")


_W = ("cast(case severity when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0 "
      "when 'low' then 1.0 when 'info' then 0.5 else 1.0 end as decimal(4,1)) * cast(confidence as decimal(3,2))")

Q["corpus_review"] = q_corpus_review
SQL["corpus_review"] = "with " + SQL_V1_SCAN + f""",
r5 as (select review_id, file_path, 'high' as severity, 0.85 as confidence from v1l
       where regexp_matches(file_path, 'test_.*\\.py$|.*_test\\.py$|tests?/.*\\.py$|.*_spec\\.py$')
         and not contains(code, 'assert') and not contains(code, 'pytest')),
fa as (select review_id, file_path, severity, confidence from sc union all select * from r5),
a as (select review_id, cast(count(*) as bigint) as n_findings,
        cast(count_if(severity = 'critical') as bigint) as n_critical, cast(count_if(severity = 'high') as bigint) as n_high,
        cast(count_if(severity = 'medium') as bigint) as n_medium, cast(count_if(severity = 'low') as bigint) as n_low,
        cast(count_if(severity = 'info') as bigint) as n_info, sum({_W}) as ded from fa group by review_id),
j as (select v1l.review_id, v1l.file_path, cast(len(ls) as bigint) as total_lines,
        coalesce(n_findings, 0) as n_findings, coalesce(n_critical, 0) as n_critical, coalesce(n_high, 0) as n_high,
        coalesce(n_medium, 0) as n_medium, coalesce(n_low, 0) as n_low, coalesce(n_info, 0) as n_info,
        case when ded is null then 100.0 else cast(round(cast(greatest(cast(0 as double), 100 - cast(ded as double)
          / greatest(cast(1 as double), len(ls) / cast(100 as double))) as decimal(12,6)), 1) as double) end as overall_score
      from v1l left join a using (review_id))
select review_id, file_path, total_lines, n_findings, n_critical, n_high, n_medium, n_low, n_info, overall_score,
  case when n_findings = 0 then 'Code review completed for ' || file_path || '. No issues found. Score: '
         || printf('%.1f', overall_score) || '/100'
       else 'Code review completed for ' || file_path || '. Found ' || cast(n_findings as varchar) || ' issues ('
         || {_sev_list_sql('n_critical', 'n_high', 'n_medium', 'n_low')} || ' severity). Score: '
         || printf('%.1f', overall_score) || '/100' end as summary
from j"""


# --- T7 ----------------------------------------------------------------------
def q_review_summary(spark, sf):
    from revspark.operators.dedup import dedup_findings
    from revspark.plans.fixtures import V2_ORDER
    d = dedup_findings(v2_findings(spark, sf), order_cols=V2_ORDER)
    files = d.select("review_id", "file_path").distinct().withColumn("total_lines", v2_total_lines(F.col("review_id")))
    ai = files.select("review_id", "file_path", F.when(F.col("review_id") % 3 == 0, F.concat(
        F.lit("Overall "), F.col("file_path"), F.lit(" needs attention."))).alias("ai_summary"))
    fr = A.file_reviews(files, d, ai_summaries=ai)
    return fr.select("review_id", "file_path", "summary")


Q["review_summary"] = q_review_summary
SQL["review_summary"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
a as (select review_id, file_path, count(*) as n, count_if(severity = 'critical') as c1, count_if(severity = 'high') as c2,
        count_if(severity = 'medium') as c3, count_if(severity = 'low') as c4,
        sum(cast(case severity when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0
          when 'low' then 1.0 when 'info' then 0.5 else 1.0 end as decimal(4,1)) * confidence) as ded
      from k group by review_id, file_path),
s as (select *, cast(round(cast(greatest(cast(0 as double), 100 - cast(ded as double) / greatest(cast(1 as double),
        (80 + review_id % 200) / cast(100 as double))) as decimal(12,6)), 1) as double) as score from a)
select review_id, file_path,
  'Code review completed for ' || file_path || '. Found ' || cast(n as varchar) || ' issues ('
  || {_sev_list_sql('c1', 'c2', 'c3', 'c4')} || ' severity). Score: ' || printf('%.1f', score) || '/100'
  || case when review_id % 3 = 0 then chr(10) || chr(10) || 'Overall ' || file_path || ' needs attention.' else '' end
  as summary
from s"""


# --- A11 rollup ------------------------------------------------------------------
def q_line_metrics_by_language(spark, sf):
    v = v1_files(spark, sf).withColumn("language", L.detect_language(F.col("file_path"), F.col("code")))
    m = A.line_metrics(v, keys=("review_id", "language"))
    return A.line_metrics_rollup(m, ["language"]).select(
        "language", F.col("n_files").cast("bigint").alias("n_files"), "total_lines", "blank_lines",
        "comment_lines", "code_lines")


Q["line_metrics_by_language"] = q_line_metrics_by_language
_LANG_E, _LANG_SELECT = SQL["detect_language"].split(f"with {SQL_V1},", 1)[1].split("\nselect review_id", 1)
SQL["line_metrics_by_language"] = (
    "with " + SQL_V1_LINES + ", m as (select review_id, len(ls) as t, "
    "len(list_filter(ls, lambda x: trim(x) = '')) as b, "
    "len(list_filter(ls, lambda x: starts_with(trim(x), '#'))) as c from v1l), "
    + _LANG_E.strip() + ", lang as (select review_id" + _LANG_SELECT + ") "
    "select language, cast(count(*) as bigint) as n_files, cast(sum(t) as bigint) as total_lines, "
    "cast(sum(b) as bigint) as blank_lines, cast(sum(c) as bigint) as comment_lines, "
    "cast(sum(t - b - c) as bigint) as code_lines from m join lang using (review_id) group by language")
