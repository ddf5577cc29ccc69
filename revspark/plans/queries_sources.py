"""Registered queries: repositories in archives (S1), rejected reports (S7), sessions and late rows (ST3), sketches, reviewers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from revspark.functions.lookups import LANGUAGE_BY_EXTENSION
from revspark.operators import sketches as K
from revspark.operators.aggregates import by_severity
from revspark.operators.dedup import dedup_findings
from revspark.operators.reviewers import FileReviewer
from revspark.operators.table_function import register_reviewers
from revspark.plans.fixtures import SQL_V1, SQL_V2, SQL_V2_DEDUP, SQL_V3_RAW, V2_ORDER, table, v1_files, v2_findings
from revspark.plans.queries_ingest import _reports
from revspark.plans.queries_misc import first_line_reviewer
from revspark.plans.queries_text import SQL as TEXT_SQL
from revspark.session import shared_path
from revspark.sources.reports import report_rejects
from revspark.sources.repository import read_repository, write_archives
from revspark.streaming.review_stream import read_late, read_sessions, read_stream_table, run_sessions

Q = {}
SQL = {}


# --- S1: archives ------------------------------------------------------------------
LANGUAGES = ["go", "python"]


def q_read_repository(spark, sf):
    """The files of two languages, every third in a zip, a tar and a compressed tar."""
    path = shared_path(spark, "repository")
    files = v1_files(spark, sf)
    for k, kind in enumerate(("zip", "tar", "tar.gz")):
        write_archives(files.where(F.col("review_id") % 3 == k), f"{path}/{kind.replace('.', '-')}", kind)
    found = read_repository(spark, path, languages=LANGUAGES)
    return found.select(F.substring_index("archive", "/", 1).alias("kind"), "file_path", "language", "size", F.md5("code").alias("code_md5"), "error")


_LANG = TEXT_SQL["detect_language"].split(f"with {SQL_V1},", 1)[1].split("\nselect review_id", 1)
Q["read_repository"] = q_read_repository
SQL["read_repository"] = f"""with {SQL_V1}, {_LANG[0].strip()}, lang as (select review_id{_LANG[1]})
select case review_id % 3 when 0 then 'zip' when 1 then 'tar' else 'tar-gz' end as kind, file_path, language,
  cast(strlen(code) as bigint) as size, md5(code) as code_md5, cast(null as varchar) as error
from v1 join lang using (review_id) where language in ({', '.join(f"'{x}'" for x in LANGUAGES)})"""
assert {lang for _, lang in LANGUAGE_BY_EXTENSION} >= set(LANGUAGES)


# --- S7: rejected reports ------------------------------------------------------------
Q["report_rejects"] = lambda s, sf: report_rejects(_reports(s, sf))
SQL["report_rejects"] = f"""with {SQL_V3_RAW}
select distinct review_id, file_path, tool, cast((item_ord - 1) // 10000 as bigint) as part, 'malformed report' as reason
from v3r where tool = 'pylint' and review_id % 13 = 0 or tool = 'bandit' and review_id % 11 = 0"""
SQL["report_rejects"] = f"select review_id, file_path, tool, reason from ({SQL['report_rejects']}) t"


# --- A2: reviews without findings ----------------------------------------------------
def q_by_severity_of_reviews(spark, sf):
    """All five severities of every review, of those without high findings too."""
    kept = dedup_findings(v2_findings(spark, sf), order_cols=V2_ORDER)
    reviews = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    return by_severity(kept.where("severity = 'high'"), ["review_id"], reviews=reviews).select(
        "review_id", "severity", F.col("n").cast("bigint").alias("n"))


Q["by_severity_of_reviews"] = q_by_severity_of_reviews
SQL["by_severity_of_reviews"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
s(severity) as (values ('critical'), ('high'), ('medium'), ('low'), ('info')),
c as (select review_id, severity, count(*) as n from k where severity = 'high' group by all)
select o_orderkey as review_id, s.severity, cast(coalesce(c.n, 0) as bigint) as n
from orders cross join s left join c on c.review_id = o_orderkey and c.severity = s.severity"""


# --- ST3: sessions and late rows -------------------------------------------------------
GAP, DELAY = 6 * 3600, 3 * 86400


def _sessions(spark, sf):
    """Three quarters of the events, then the rest as a second arrival."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    path, out = shared_path(spark, "events"), None
    for later in (False, True):
        events.where((F.col("event_id") % 4 == 3) == later).write.mode("append").parquet(path)
        out = run_sessions(read_stream_table(spark, path, events.schema), "sessions", gap_seconds=GAP, delay_seconds=DELAY, folder=out)
    return out


def q_stream_sessions(spark, sf):
    return read_sessions(spark, _sessions(spark, sf), gap_seconds=GAP).select(
        "client", F.col("session_start").cast("string").alias("session_start"), F.col("session_end").cast("string").alias("session_end"),
        "n", "closed")


def q_stream_late_rows(spark, sf):
    return read_late(spark, _sessions(spark, sf)).select("event_id", "client", F.col("ts").cast("string").alias("ts"))


_EVENTS = f"""e as (select event_id, user_id as client, cast(ts as timestamp) as ts, event_id % 4 = 3 as later from events),
w as (select max(ts) - interval {DELAY} second as mark from e where not later),
r as (select e.*, later and ts < mark as late from e cross join w)"""
Q["stream_sessions"] = q_stream_sessions
SQL["stream_sessions"] = f"""with {_EVENTS},
g as (select client, ts, sum(cast(head as int)) over (partition by client order by ts rows unbounded preceding) as g from (
  select client, ts, coalesce(ts > lag(ts) over (partition by client order by ts) + interval {GAP} second, true) as head
  from r where not late) h)
select client, cast(min(ts) as varchar) as session_start, cast(max(ts) + interval {GAP} second as varchar) as session_end,
  cast(count(*) as bigint) as n,
  max(ts) + interval {GAP} second < (select max(ts) from r where not late) - interval {DELAY} second as closed
from g group by client, g"""
Q["stream_late_rows"] = q_stream_late_rows
SQL["stream_late_rows"] = f"with {_EVENTS} select event_id, client, cast(ts as varchar) as ts from r where late"


# --- sketches by day -----------------------------------------------------------------
def q_sketch_estimates(spark, sf):
    """Distinct parts, and quantiles of prices, by return flag: from sketches of two commits of ship days, against the exact figures."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("ship_day"), F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").cast("double").alias("price"))
    path = shared_path(spark, "sketches")
    for k, half in enumerate((F.month("ship_day") <= 6, F.month("ship_day") > 6)):
        K.store_sketches(spark, path, f"half-{k}", K.day_sketches(rows.where(half), ["flag"], {"parts": "part"}, {"price": "price"}, "ship_day"))
    got = K.estimates(K.merge_sketches(K.read_sketches(spark, path), ["flag"]), (0.5, 0.9))
    told = rows.join(got.select("flag", F.col("n").alias("n_told"), "n_parts", "price_p50", "price_p90"), "flag").groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("n_parts"), F.max("n_told").alias("n_told"),
        F.max("n_parts").alias("told"), *(F.avg((F.col("price") <= F.col(c)).cast("double")).alias(c) for c in ("price_p50", "price_p90")))
    near = lambda c, q: F.abs(F.col(c) - q) <= 2 * K.RANK_ERROR
    return told.select("flag", "n", "n_parts", (F.col("n") == F.col("n_told")).alias("n_exact"),
                       (F.abs(F.col("told") / F.col("n_parts") - 1) <= 4 * K.DISTINCT_ERROR).alias("parts_near"),
                       near("price_p50", 0.5).alias("p50_near"), near("price_p90", 0.9).alias("p90_near"))


Q["sketch_estimates"] = q_sketch_estimates
SQL["sketch_estimates"] = """select l_returnflag as flag, cast(count(*) as bigint) as n,
  cast(count(distinct l_partkey) as bigint) as n_parts, true as n_exact, true as parts_near, true as p50_near, true as p90_near
from lineitem group by l_returnflag"""


# --- E1 in SQL -------------------------------------------------------------------------
def q_sql_reviewer(spark, sf):
    register_reviewers(spark, [FileReviewer("FirstLine", "", first_line_reviewer)])
    v1_files(spark, sf).createOrReplaceTempView("v1_review_files")
    return spark.sql("""select review_id, file_path, agent_name, line_number, message, confidence, error
                        from review_files(table(v1_review_files), reviewer => 'FirstLine')""")


Q["sql_reviewer"] = q_sql_reviewer
SQL["sql_reviewer"] = f"""with {SQL_V1}
select review_id, file_path, 'FirstLine' as agent_name, case when doc_id % 6 <> 2 then 1 end as line_number,
  case when doc_id % 6 <> 2 then 'German file' end as message, case when doc_id % 6 <> 2 then cast(0.6 as double) end as confidence,
  case when doc_id % 6 = 2 then 'ValueError: no parser for .go' end as error
from v1 join documents on doc_id = review_id where doc_id % 6 = 2 or lang = 'de'"""
