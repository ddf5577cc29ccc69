"""Registered queries: review store (S12), streaming (ST1-ST3), custom reviewer."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from revspark.functions.text import splitlines
from revspark.operators import aggregates as A
from revspark.operators.dedup import dedup_findings
from revspark.operators.normalize import to_findings
from revspark.operators.reviewers import FileReviewer, Reviewer, ReviewerSet, ReviewInputs
from revspark.plans.fixtures import SCAN_RULES, SQL_V2, SQL_V2_DEDUP, V2_ORDER, table, v1_files, v1_from_documents, \
    v2_findings
from revspark.plans.queries_text import SQL_V1_SCAN, SQL as TEXT_SQL
from revspark.plans.review import review_files
from revspark.session import shared_path, table_path, write_once
from revspark.sources.store import commit, committed_reviews, committed_rows, compact, read_reviews, write_reviews
from revspark.streaming.review_stream import rate_counts, read_stream_table, review_batch_sink, run_available_now, \
    run_ttl_dedup

Q = {}
SQL = {}


# --- S12 ---------------------------------------------------------------------
def q_store_latest(spark, sf):
    scores = A.pr_scores(dedup_findings(v2_findings(spark, sf), order_cols=V2_ORDER), ["review_id"])
    path = shared_path(spark, "reviews")
    write_reviews(scores.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")), path, write_id=0)
    second = scores.filter(F.col("review_id") % 4 == 0).select(
        "review_id", F.greatest(F.lit(0.0), F.col("overall_score") - 1).alias("overall_score"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts"))
    write_reviews(second, path, write_id=1)
    return read_reviews(spark, path).select("review_id", "overall_score", "write_id")


Q["store_latest"] = q_store_latest
SQL["store_latest"] = f"""with {SQL_V2}, {SQL_V2_DEDUP},
s as (select review_id, greatest(cast(0 as double), cast(round(cast(100 as decimal(4,1)) - sum(cast(case severity
        when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0 when 'low' then 1.0 when 'info' then 0.5
        else 1.0 end as decimal(4,1)) * confidence), 1) as double)) as overall_score from k group by review_id)
select review_id, case when review_id % 4 = 0 then greatest(cast(0 as double), overall_score - 1) else overall_score end
  as overall_score, cast(case when review_id % 4 = 0 then 1 else 0 end as bigint) as write_id
from s"""


# --- ST1 ---------------------------------------------------------------------
def _glob(sf, name):
    """A one-file glob: the file source lists files by pattern, so a single
    parquet file can be a stream source without copying it into a folder."""
    return table_path(sf, f"[{name[0]}]{name[1:]}")


def q_stream_review(spark, sf):
    src = table(spark, sf, "documents")
    stream = v1_from_documents(read_stream_table(spark, _glob(sf, "documents"), src.schema))
    sink = review_batch_sink(lambda b: ReviewInputs(files=b, scan_rules=SCAN_RULES))
    out = run_available_now(stream, "stream-review", sink=sink)
    return committed_reviews(spark, out).select("review_id", "n_findings", "overall_score")


Q["stream_review"] = q_stream_review
SQL["stream_review"] = ("select review_id, n_findings, overall_score from ("
                        + TEXT_SQL["corpus_review"] + ") cr")


# --- ST1 + S12: commits and compaction -------------------------------------------
def q_store_commits(spark, sf):
    """The scores of all reviews, then those of every fourth anew, as two commits that are compacted; findings stay with the
    latest write of their review."""
    # every table of both commits reads the findings and scores: each is computed once, by file
    kept = write_once(dedup_findings(v2_findings(spark, sf), order_cols=V2_ORDER), "kept")
    scores = write_once(A.pr_scores(kept, ["review_id", "file_path"]), "scores")
    path = shared_path(spark, "committed")
    for k, (day, rows) in enumerate((("2024-01-01", scores), ("2024-01-02", scores.filter(F.col("review_id") % 4 == 0)))):
        stamp = {"ts": F.lit(f"{day} 00:00:00").cast("timestamp"), "write_id": F.lit(k).cast("long")}
        own = kept.join(rows.select("review_id", "file_path"), ["review_id", "file_path"], "left_semi")
        own = own if k == 0 else own.filter(F.col("severity") == "high")
        for _ in range(2):  # the second time is a retry: it changes nothing
            commit(spark, path, f"batch-{k}", {"reviews": rows.withColumns(stamp), "findings": own.withColumns(stamp)})
    compact(spark, path)
    n = committed_rows(spark, path, "findings").groupBy("review_id", "file_path").agg(F.count(F.lit(1)).alias("n_findings"))
    return (committed_reviews(spark, path).join(n, ["review_id", "file_path"], "left")
            .select("review_id", "file_path", "overall_score", "write_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings")))


Q["store_commits"] = q_store_commits
SQL["store_commits"] = f"""with {SQL_V2}, {SQL_V2_DEDUP}
select review_id, file_path, greatest(cast(0 as double), cast(round(cast(100 as decimal(4,1)) - sum(cast(case severity
        when 'critical' then 15.0 when 'high' then 8.0 when 'medium' then 3.0 when 'low' then 1.0 when 'info' then 0.5
        else 1.0 end as decimal(4,1)) * confidence), 1) as double)) as overall_score,
  cast(case when review_id % 4 = 0 then 1 else 0 end as bigint) as write_id,
  cast(count_if(review_id % 4 <> 0 or severity = 'high') as bigint) as n_findings
from k group by review_id, file_path"""


# --- ST2 ---------------------------------------------------------------------
def _v5_stream(spark, sf):
    ev = table(spark, sf, "events")
    s = read_stream_table(spark, _glob(sf, "events"), ev.schema)
    return s.select(F.col("event_id").alias("submission_id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("client"),
                    F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("prompt_key"))


def q_stream_ttl_dedup(spark, sf):
    out = run_ttl_dedup(_v5_stream(spark, sf), "stream-ttl")
    return spark.read.parquet(out).select("submission_id", "prompt_key", F.col("ts").cast("string").alias("ts"))


Q["stream_ttl_dedup"] = q_stream_ttl_dedup
SQL["stream_ttl_dedup"] = """with recursive e as (
  select event_id, cast(user_id as varchar) || '/' || event_type as k, cast(ts as timestamp) as ts from events),
p(k, ts) as (
  select k, min(ts) from e group by k
  union all
  select p.k, min(e.ts) from p join e on e.k = p.k and e.ts >= p.ts + interval 1 hour group by p.k)
select min(event_id) as submission_id, e.k as prompt_key, cast(e.ts as varchar) as ts
from e join p on p.k = e.k and p.ts = e.ts group by e.k, e.ts"""


# --- ST3 ---------------------------------------------------------------------
def q_stream_rate_limit(spark, sf):
    c = rate_counts(_v5_stream(spark, sf), "1 day", "client", "ts", limit=3)

    def overwrite(batch, batch_id, out):
        batch.write.mode("overwrite").parquet(out)

    out = run_available_now(c, "stream-rate", sink=overwrite, output_mode="complete")
    r = spark.read.parquet(out)
    return r.select(F.col("window_start").cast("string").alias("window_start"), "client",
                    F.col("n").cast("bigint").alias("n"), "over_limit")


Q["stream_rate_limit"] = q_stream_rate_limit
SQL["stream_rate_limit"] = """select cast(date_trunc('day', ts) as varchar) as window_start, user_id as client,
  cast(count(*) as bigint) as n, count(*) > 3 as over_limit
from events group by all"""


# --- E1 / E2 -------------------------------------------------------------------
LONG_LINE = 200


def line_length_reviewer(inputs: ReviewInputs, agent_ord: int):
    """Example user reviewer (E1): flags lines longer than LONG_LINE characters."""
    f = inputs.files.select("review_id", "file_path", F.posexplode(splitlines(F.col("code"))).alias("p", "line"))
    hits = f.filter(F.length("line") > LONG_LINE).select(
        "review_id", "file_path", (F.col("p") + 1).cast("long").alias("item_ord"),
        (F.col("p") + 1).alias("line_number"), F.lit("low").alias("severity"), F.lit("style").alias("category"),
        F.lit(f"Line longer than {LONG_LINE} characters").alias("message"), F.lit("0.50").alias("confidence"))
    return to_findings(hits, "LineLengthReviewer", agent_ord)


def q_custom_reviewer(spark, sf):
    rs = ReviewerSet()
    assert rs.remove("TestingAgent") and not rs.remove("NoSuchAgent")
    rs.add(Reviewer("LineLengthReviewer", "Flags long lines", line_length_reviewer))
    out = review_files(ReviewInputs(files=v1_files(spark, sf), scan_rules=SCAN_RULES), rs)
    s = A.agent_summaries(out.findings, out.file_reviews.select("review_id"), rs.names())
    return s.select("review_id", "agent_name", F.col("n_findings").cast("bigint").alias("n_findings"), "summary")


# --- U2: isolation by file ------------------------------------------------------
def first_line_reviewer(file_path: str, code: str) -> list:
    """Example file reviewer: it cannot read Go files, and flags German ones on line 1."""
    if file_path.endswith(".go"):
        raise ValueError("no parser for .go")
    german = code.startswith("# de")
    return [dict(line_number=1, severity="info", category="style", message="German file", confidence=0.6)] * german


def q_file_isolation(spark, sf):
    files = v1_files(spark, sf)
    alone = ReviewerSet([FileReviewer("FirstLine", "", first_line_reviewer)])
    one = review_files(ReviewInputs(files=files), alone).file_reviews.select("review_id", "status")
    both = ReviewerSet([Reviewer("LineLengthReviewer", "", line_length_reviewer), *alone.reviewers])
    out = review_files(ReviewInputs(files=files), both)
    errors = out.file_errors.groupBy("review_id").agg(F.max("reason").alias("reason"))
    return (out.file_reviews.select("review_id", "n_findings", "status").join(errors, "review_id", "left")
            .join(one.withColumnRenamed("status", "status_alone"), "review_id"))


Q["file_isolation"] = q_file_isolation
SQL["file_isolation"] = "with " + SQL_V1_SCAN + f""",
d as (select doc_id as review_id, lang = 'de' and doc_id % 6 <> 2 as german, doc_id % 6 = 2 as go from documents),
x as (select distinct review_id, line_number, 'Line longer' as m from l where length(line) > {LONG_LINE}),
n as (select review_id, count(*) as n from x group by review_id)
select review_id, cast(coalesce(n.n, 0) + cast(german as int) as bigint) as n_findings, 'completed' as status,
  case when go then 'ValueError: no parser for .go' end as reason,
  case when go then 'failed' else 'completed' end as status_alone
from d left join n using (review_id)"""

def ending_reviewer(file_path: str, code: str) -> list:
    """Example of a reviewer that ends its process on Go files."""
    if file_path.endswith(".go"):
        os._exit(3)
    return first_line_reviewer(file_path, code)


def q_process_isolation(spark, sf):
    files = v1_files(spark, sf)
    rs = ReviewerSet([FileReviewer("FirstLine", "", ending_reviewer, seconds=60, memory_mb=4096)])
    out = review_files(ReviewInputs(files=files), rs)
    return (out.file_reviews.select("review_id", "n_findings", "status")
            .join(out.file_errors.select("review_id", "reason"), "review_id", "left"))


Q["process_isolation"] = q_process_isolation
SQL["process_isolation"] = """select doc_id as review_id, cast(lang = 'de' and doc_id % 6 <> 2 as bigint) as n_findings,
  case when doc_id % 6 = 2 then 'failed' else 'completed' end as status,
  case when doc_id % 6 = 2 then 'ChildProcessError: process ended with code 3' end as reason
from documents"""

Q["custom_reviewer"] = q_custom_reviewer
SQL["custom_reviewer"] = "with " + SQL_V1_SCAN + f""",
ll as (select review_id, 'low' as severity from l where length(line) > {LONG_LINE}),
fa as (select review_id, 'SecurityAgent' as agent_name, severity from sc
       union all select review_id, 'LineLengthReviewer', severity from ll),
ag(agent_name) as (values ('QualityAgent'), ('SecurityAgent'), ('LineLengthReviewer')),
c as (select review_id, agent_name, count(*) as n, count_if(severity = 'critical') as c1, count_if(severity = 'high') as c2,
        count_if(severity = 'medium') as c3, count_if(severity = 'low') as c4 from fa group by all),
sp as (select review_id, agent_name from v1 cross join ag)
select sp.review_id, sp.agent_name, cast(coalesce(n, 0) as bigint) as n_findings,
  case when coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0) + coalesce(c4, 0) > 0 then 'Found ' || concat_ws(', ',
    case when c1 > 0 then c1 || ' critical' end, case when c2 > 0 then c2 || ' high' end,
    case when c3 > 0 then c3 || ' medium' end, case when c4 > 0 then c4 || ' low' end) || ' severity issues'
  else 'No issues found' end as summary
from sp left join c on c.review_id = sp.review_id and c.agent_name = sp.agent_name"""
