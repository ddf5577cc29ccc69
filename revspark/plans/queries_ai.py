"""Registered queries for stored model responses: S11, F7, F8, J1, J2, J4, J6, T10/T11, U1/U2.

Fixture: for every (review, file, tool) group of V3 scanner rows there is one
stored model response (ruff groups answer the quality prompt, pylint groups the
testing prompt, bandit groups the security prompt) holding the group's rows as
a JSON array — sometimes fenced, sometimes a bare object, sometimes not JSON,
sometimes with an invalid item or only a message per item.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.functions import lookups as L
from revspark.operators.enrich import asof_lookup, cache_lookup, enrich
from revspark.operators.normalize import ai_findings, quality_findings, security_findings
from revspark.operators.prompts import SYSTEM, build_prompts, finding_prompts
from revspark.operators.reviewers import Reviewer, ReviewerSet, ReviewInputs, run_reviewers, with_fallback
from revspark.operators.structure import extract_elements
from revspark.plans.fixtures import SCAN_RULES, SQL_V3_RAW, v1_files, v3_raw, v5_events
from revspark.plans.queries_ingest import sql_case
from revspark.plans.queries_text import SQL_V1_SCAN
from revspark.schemas import SECURITY_FALLBACK_EXPLANATION
from revspark.sources.responses import parse_responses, response_items

Q = {}
SQL = {}

AGENT_BY_TOOL = [("ruff", "QualityAgent"), ("pylint", "TestingAgent"), ("bandit", "SecurityAgent")]


def _jstr(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def responses(spark, sf, part_size: int = 1000):
    """(review_id, file_path, agent_name, part, response) built from V3 rows."""
    r = v3_raw(spark, sf)
    tool, rid, io = F.col("tool"), F.col("review_id"), F.col("item_ord")
    line = F.when(tool == "pylint", _jstr(F.col("line_number").cast("string"))).otherwise(
        F.col("line_number").cast("string"))
    cat = (F.when(tool == "ruff", F.lit("Style")).when(tool == "pylint", F.lit("missing_test"))
           .when(io % 3 == 0, F.lit("SQL_Injection")).when(io % 3 == 1, F.lit("xss"))
           .otherwise(F.lit("hardcoded_secret")))
    owasp = (F.when((tool == "bandit") & (io % 2 == 0), F.lit('"owasp_category":"A01:2021-Broken Access Control"'))
             .when((tool == "bandit") & (io % 4 == 1), F.lit('"owasp_category":""')))
    full = F.concat(F.lit("{"), F.concat_ws(
        ",", F.concat(F.lit('"line_number":'), line),
        F.concat(F.lit('"severity":'), _jstr(F.lower("tool_severity"))),
        F.concat(F.lit('"category":'), _jstr(cat)),
        F.concat(F.lit('"message":'), _jstr(F.col("message"))),
        F.when(F.col("suggestion").isNotNull(), F.concat(F.lit('"suggestion":'), _jstr(F.col("suggestion")))),
        owasp), F.lit("}"))
    bare = F.concat(F.lit('{"message":'), _jstr(F.col("message")), F.lit("}"))
    item = F.when(rid % 31 == 0, bare).otherwise(full)
    g = (r.withColumn("part", ((io - 1) / part_size).cast("long"))
         .withColumn("agent_name", L.case_exact(tool, AGENT_BY_TOOL, "QualityAgent"))
         .groupBy("review_id", "file_path", "agent_name", "part")
         .agg(F.array_sort(F.collect_list(F.struct(io.alias("o"), item.alias("j")))).alias("items")))
    js = F.transform("items", lambda s: s["j"])
    extra = F.concat(F.when(rid % 23 == 0, F.lit(',{"line_number":0,"message":"bad"}')).otherwise(F.lit("")),
                     F.when(rid % 29 == 0, F.lit(',{"message":"m","severity":null}')).otherwise(F.lit("")))
    arr = F.concat(F.lit("["), F.array_join(js, ","), extra, F.lit("]"))
    text = (F.when(rid % 19 == 0, F.lit("not json"))
            .when(rid % 17 == 0, F.element_at(js, 1))
            .when(rid % 3 == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
            .otherwise(arr))
    return g.select("review_id", "file_path", "agent_name", "part", text.alias("response"))


_SQL_RESP = SQL_V3_RAW + f""",
rsp as (select review_id, file_path, tool, item_ord, line_number, message,
          {sql_case('tool', AGENT_BY_TOOL, 'QualityAgent')} as agent_name,
          review_id % 19 = 0 or review_id % 17 = 0 as unparsed,
          review_id % 19 <> 0 and review_id % 17 <> 0 and (review_id % 23 = 0 or review_id % 29 = 0) as bad,
          review_id % 31 = 0 as bare,
          lower(tool_severity) as sev_raw,
          case when tool = 'ruff' then 'Style' when tool = 'pylint' then 'missing_test'
               when item_ord % 3 = 0 then 'SQL_Injection' when item_ord % 3 = 1 then 'xss' else 'hardcoded_secret' end as cat_raw,
          coalesce(suggestion, '') as sug,
          case when tool = 'bandit' and item_ord % 2 = 0 then 'A01:2021-Broken Access Control' end as owasp_raw
        from v3r),
grp as (select review_id, file_path, agent_name, max(item_ord) as n, bool_or(unparsed) as unparsed, bool_or(bad) as bad
        from rsp group by all)"""


# --- S11 ---------------------------------------------------------------------
def q_parse_responses(spark, sf):
    p = parse_responses(responses(spark, sf), keys=("review_id", "file_path", "agent_name"))
    return p.select("review_id", "file_path", "agent_name", "item_ord", F.col("n_items").cast("bigint").alias("n_items"),
                    F.try_variant_get("item", "$.message", "string").alias("message"))


Q["parse_responses"] = q_parse_responses
SQL["parse_responses"] = "with " + _SQL_RESP + """,
ext as (select review_id, file_path, agent_name, n + 1 as item_ord, 'bad' as message from grp
          where not unparsed and review_id % 23 = 0
        union all
        select review_id, file_path, agent_name, n + 1 + cast(review_id % 23 = 0 as int), 'm' from grp
          where not unparsed and review_id % 29 = 0),
cnt as (select review_id, file_path, agent_name,
          n + cast(review_id % 23 = 0 as int) + cast(review_id % 29 = 0 as int) as n_items from grp where not unparsed)
select r.review_id, r.file_path, r.agent_name, cast(r.item_ord as bigint) as item_ord, cast(c.n_items as bigint) as n_items,
  r.message
from (select review_id, file_path, agent_name, item_ord, message from rsp where not unparsed
      union all select * from ext) r
join cnt c on c.review_id = r.review_id and c.file_path = r.file_path and c.agent_name = r.agent_name"""


# --- F7 ----------------------------------------------------------------------
_AGENTS = [("QualityAgent", 0), ("SecurityAgent", 1), ("TestingAgent", 2)]


def _ai_all(spark, sf):
    """Every reviewer's stored answers in one pass (defaults chosen per row)."""
    return ai_findings(responses(spark, sf), None, None, 9, agent_ords=dict(_AGENTS))


def q_ai_items(spark, sf):
    f = _ai_all(spark, sf)
    return f.select("review_id", "file_path", "agent_name", "item_ord", "line_number", "severity", "category",
                    "message", "suggestion", "owasp_category", F.col("confidence").cast("double").alias("confidence"))


_CATS = ("'code_smell','complexity','naming','style','duplication','maintainability','sql_injection','xss',"
         "'hardcoded_secret','insecure_import','authentication','authorization','cryptography','injection',"
         "'missing_test','low_coverage','edge_case','test_quality','best_practice','performance',"
         "'documentation','error_handling','other'")

_SQL_AI = _SQL_RESP + f""",
ai as (select review_id, file_path, agent_name, item_ord, case when bare then 1 else line_number end as line_number, message,
    case when bare then case agent_name when 'QualityAgent' then 'medium' when 'SecurityAgent' then 'high' else 'low' end
         when sev_raw in ('critical','high','medium','low','info') then sev_raw else 'medium' end as severity,
    case when bare then case agent_name when 'QualityAgent' then 'code_smell' when 'SecurityAgent' then 'injection' else 'missing_test' end
         when lower(cat_raw) in ({_CATS}) then lower(cat_raw) else 'other' end as category,
    case when bare then '' else sug end as suggestion,
    case when agent_name <> 'SecurityAgent' then null
         when not bare and owasp_raw is not null then owasp_raw
         else {sql_case("lower(case when bare then 'injection' else cat_raw end)", L.OWASP_BY_CATEGORY, L.DEFAULT_OWASP)} end
      as owasp_category,
    case agent_name when 'TestingAgent' then 0.65 else 0.7 end as confidence
  from rsp where not unparsed and not bad)"""

Q["ai_items"] = q_ai_items
SQL["ai_items"] = "with " + _SQL_AI + """
select review_id, file_path, agent_name, cast(item_ord as bigint) as item_ord, line_number, severity, category, message,
  suggestion, owasp_category, cast(confidence as double) as confidence from ai"""


# --- F8 ----------------------------------------------------------------------
def _checker(agent):
    from revspark.operators.normalize import item_checks

    def check(it):
        return item_checks(it, agent)[1]
    return check


def q_bad_batches(spark, sf):
    from revspark.operators.normalize import item_checks
    from revspark.functions.text import let
    resp = responses(spark, sf)
    check = _checker(F.col("agent_name"))
    st = let(response_items(F.col("response")), lambda its: F.struct(
        F.size(its).cast("bigint").alias("n"), F.coalesce(F.forall(its, check), F.lit(False)).alias("ok")))
    out = resp.select("review_id", "file_path", "agent_name", st.alias("_s"))
    return out.select("review_id", "file_path", "agent_name",
                      F.when(F.col("_s.n") >= 0, F.col("_s.n")).alias("n_items"), F.col("_s.ok").alias("batch_ok"))


Q["bad_batches"] = q_bad_batches
SQL["bad_batches"] = "with " + _SQL_RESP + """
select review_id, file_path, agent_name,
  cast(case when unparsed then null else n + cast(review_id % 23 = 0 as int) + cast(review_id % 29 = 0 as int) end as bigint) as n_items,
  not unparsed and not bad as batch_ok
from grp"""


# --- J4 ----------------------------------------------------------------------
def q_ai_fallback(spark, sf):
    r = v3_raw(spark, sf)
    static = quality_findings(r.filter(F.col("tool") == "pylint"))
    ai = ai_findings(responses(spark, sf).filter(F.col("agent_name") == "QualityAgent"), "QualityAgent", 0, 9)
    f = with_fallback(static, ai)
    return f.select("review_id", "file_path", "source_ord", "item_ord", "rule_id", "severity", "message")


Q["ai_fallback"] = q_ai_fallback
SQL["ai_fallback"] = "with " + _SQL_AI + f""",
st as (select review_id, file_path, 1 as source_ord, item_ord, 'pylint:' || rule_code as rule_id,
         {sql_case('rule_code', L.QUALITY_SEVERITY, 'medium', 'prefix')} as severity, message
       from v3r where tool = 'pylint')
select * from st
union all
select review_id, file_path, 9, cast(item_ord as bigint), null, severity, message from ai
where agent_name = 'QualityAgent' and not exists (select 1 from st where st.review_id = ai.review_id and st.file_path = ai.file_path)"""


# --- J1 ----------------------------------------------------------------------
def q_enrich_suggestions(spark, sf):
    static = finding_prompts(quality_findings(v3_raw(spark, sf)), "suggestion")
    resp = static.select(
        "prompt_key",
        F.when(F.col("line_number") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Consider: "), F.col("message")))
        .alias("response"),
        ((F.col("line_number") == 7) & (F.col("category") == "style")).alias("error")).dropDuplicates(["prompt_key"])
    e = enrich(static, resp, fallback=None)
    return e.select("review_id", "file_path", "source_ord", "item_ord", "suggestion")


Q["enrich_suggestions"] = q_enrich_suggestions
SQL["enrich_suggestions"] = "with " + SQL_V3_RAW + f""",
q as (select review_id, file_path, case tool when 'ruff' then 0 else 1 end as source_ord, item_ord, line_number, message,
        {sql_case('rule_code', L.QUALITY_CATEGORY, 'code_smell', 'exact_prefix')} as category,
        coalesce(suggestion, '') as own from v3r where tool in ('ruff', 'pylint')),
b as (select review_id, file_path, bool_or(line_number = 7 and category = 'style') as err from q group by all)
select q.review_id, q.file_path, source_ord, item_ord,
  case when b.err then own when line_number % 3 = 0 then own else 'Consider: ' || message end as suggestion
from q join b on b.review_id = q.review_id and b.file_path = q.file_path"""


# --- J2 ----------------------------------------------------------------------
def q_enrich_security(spark, sf):
    static = finding_prompts(security_findings(v3_raw(spark, sf)), "explanation")
    ln = F.col("line_number")
    resp = static.select(
        "prompt_key",
        F.when(ln % 4 == 0, F.lit(None).cast("string")).when(ln % 4 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("Explain "), F.col("category"))).alias("response"),
        ((ln == 9) & (F.col("category") == "sql_injection")).alias("error")).dropDuplicates(["prompt_key"])
    e = enrich(static, resp, fallback=SECURITY_FALLBACK_EXPLANATION)
    return e.select("review_id", "file_path", "item_ord", "suggestion")


Q["enrich_security"] = q_enrich_security
SQL["enrich_security"] = "with " + SQL_V3_RAW + f""",
q as (select review_id, file_path, item_ord, line_number,
        {sql_case('rule_code', L.BANDIT_CATEGORY, 'injection')} as category from v3r where tool = 'bandit'),
b as (select review_id, file_path, bool_or(line_number = 9 and category = 'sql_injection') as err from q group by all)
select q.review_id, q.file_path, item_ord,
  case when b.err then '' when line_number % 4 in (0, 1) then '{SECURITY_FALLBACK_EXPLANATION}'
       else 'Explain ' || category end as suggestion
from q join b on b.review_id = q.review_id and b.file_path = q.file_path"""


# --- J6 ----------------------------------------------------------------------
CACHE_NOW = "2024-01-30 00:00:00"
CACHE_TTL = 7 * 24 * 3600


def q_cache_lookup(spark, sf):
    ev = v5_events(spark, sf)
    cache = ev.select("prompt_key", "ts", F.when(F.col("submission_id") % 2 == 0,
                                                 F.concat(F.lit("answer "), F.col("prompt_key")))
                      .otherwise(F.lit("")).alias("response"))
    hits, misses = cache_lookup(ev.select("submission_id", "prompt_key"), cache, CACHE_NOW, CACHE_TTL)
    return hits.select(F.lit("hit").alias("status"), "submission_id", "prompt_key", "response") \
        .unionByName(misses.select(F.lit("miss").alias("status"), F.lit(None).cast("long").alias("submission_id"),
                                   "prompt_key", F.lit(None).cast("string").alias("response")))


Q["cache_lookup"] = q_cache_lookup
SQL["cache_lookup"] = f"""with ev as (select event_id as submission_id, ts,
    cast(user_id as varchar) || '/' || event_type as prompt_key from events),
fresh as (select distinct prompt_key from ev where submission_id % 2 = 0
          and ts > timestamp '{CACHE_NOW}' - interval {CACHE_TTL} second and ts <= timestamp '{CACHE_NOW}')
select 'hit' as status, submission_id, prompt_key, 'answer ' || prompt_key as response
from ev where prompt_key in (select prompt_key from fresh)
union all
select distinct 'miss', cast(null as bigint), prompt_key, cast(null as varchar)
from ev where prompt_key not in (select prompt_key from fresh)"""


def q_cache_asof(spark, sf):
    """Each prompt at its own time: odd submissions ask, even ones are answered after ten minutes, every tenth with nothing."""
    ev = v5_events(spark, sf)
    n = F.col("submission_id")
    answers = ev.where(n % 2 == 0).select("prompt_key", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), F.when(
        n % 10 != 0, F.concat(F.lit("answer "), n.cast("string"))).otherwise(F.lit("")).alias("response"))
    out = asof_lookup(ev.where(n % 2 == 1).select("submission_id", "prompt_key", "ts"), answers, CACHE_TTL)
    return out.select("submission_id", "prompt_key", "response", F.col("cached_ts").cast("string").alias("cached_ts"))


Q["cache_asof"] = q_cache_asof
SQL["cache_asof"] = f"""with ev as (select event_id as submission_id, cast(ts as timestamp) as ts,
    cast(user_id as varchar) || '/' || event_type as prompt_key from events),
answers as (select prompt_key, ts + interval 10 minute as ts, max('answer ' || submission_id) as response from ev
            where submission_id % 2 = 0 and submission_id % 10 <> 0 group by 1, 2)
select e.submission_id, e.prompt_key, case when a.ts > e.ts - interval {CACHE_TTL} second then a.response end as response,
  case when a.ts > e.ts - interval {CACHE_TTL} second then cast(a.ts as varchar) end as cached_ts
from (select * from ev where submission_id % 2 = 1) e
asof left join answers a on a.prompt_key = e.prompt_key and e.ts >= a.ts"""


# --- T10 / T11 -----------------------------------------------------------------
def q_prompt_worklist(spark, sf):
    files = v1_files(spark, sf)
    el = extract_elements(files, kinds=("function", "async_function"))
    p = build_prompts("quality", files).unionByName(build_prompts("security", files)) \
        .unionByName(build_prompts("testing", files, el))
    cache = (p.filter((F.col("kind") == "quality") & (F.col("review_id") % 2 == 0))
             .select("prompt_key", F.lit("2024-01-29 23:00:00").cast("timestamp").alias("ts"),
                     F.lit("cached").alias("response")))
    _, misses = cache_lookup(p, cache, CACHE_NOW, 3600 * 2)
    return misses.select("prompt_key", "kind", "review_id")


def _sq(s):
    return s.replace("'", "''")


Q["prompt_worklist"] = q_prompt_worklist
SQL["prompt_worklist"] = "with " + SQL_V1_SCAN.split(",\nv1a as")[0] + f""",
p as (select review_id, 'quality' as kind, '{_sq(SYSTEM['quality'])}' as s,
        'File: ' || file_path || chr(10) || chr(10) || code as u from v1
      union all select review_id, 'security', '{_sq(SYSTEM['security'])}',
        'File: ' || file_path || chr(10) || chr(10) || code from v1
      union all select review_id,
        case when regexp_matches(file_path, 'test_.*\\.py$|.*_test\\.py$|tests?/.*\\.py$|.*_spec\\.py$') then 'test_quality' else 'testing' end,
        case when regexp_matches(file_path, 'test_.*\\.py$|.*_test\\.py$|tests?/.*\\.py$|.*_spec\\.py$')
             then '{_sq(SYSTEM['test_quality'])}' else '{_sq(SYSTEM['testing'])}' end,
        'File: ' || file_path || chr(10) || 'Functions: None detected' || chr(10) || chr(10) || code from v1)
select distinct sha256(concat_ws(chr(0), s, u)) as prompt_key, kind, review_id from p
where not (kind = 'quality' and review_id % 2 = 0)"""


# --- U1 / U2 -------------------------------------------------------------------
def _broken_reviewer(inputs, agent_ord):
    raise RuntimeError("reviewer backend unavailable")


def q_agent_union(spark, sf):
    rs = ReviewerSet()
    rs.add(Reviewer("BrokenReviewer", "always fails", _broken_reviewer))
    inputs = ReviewInputs(files=v1_files(spark, sf), raw_findings=v3_raw(spark, sf),
                          ai_responses=responses(spark, sf), scan_rules=SCAN_RULES)
    f, failures = run_reviewers(inputs, rs)
    assert [n for n, _ in failures] == ["BrokenReviewer"], failures
    return f.groupBy("agent_name", "agent_ord", "source_ord").agg(F.count(F.lit(1)).alias("n"))


Q["agent_union"] = q_agent_union
SQL["agent_union"] = "with " + SQL_V1_SCAN + ", " + _SQL_AI.replace(SQL_V3_RAW, SQL_V3_RAW.replace("with ", "")) + """,
r5 as (select review_id from v1l where regexp_matches(file_path, 'test_.*\\.py$|.*_test\\.py$|tests?/.*\\.py$|.*_spec\\.py$')
         and not contains(code, 'assert') and not contains(code, 'pytest')),
u as (select 'QualityAgent' as agent_name, 0 as agent_ord, case tool when 'ruff' then 0 else 1 end as source_ord
        from v3r where tool in ('ruff', 'pylint')
      union all select 'SecurityAgent', 1, 0 from v3r where tool = 'bandit'
      union all select 'SecurityAgent', 1, 1 from sc
      union all select 'SecurityAgent', 1, 9 from ai where agent_name = 'SecurityAgent'
      union all select 'QualityAgent', 0, 9 from ai where agent_name = 'QualityAgent'
        and not exists (select 1 from v3r where v3r.tool in ('ruff', 'pylint') and v3r.review_id = ai.review_id
                        and v3r.file_path = ai.file_path)
      union all select 'TestingAgent', 2, 4 from r5
      union all select 'TestingAgent', 2, 9 from ai where agent_name = 'TestingAgent')
select agent_name, agent_ord, source_ord, cast(count(*) as bigint) as n from u group by all"""
