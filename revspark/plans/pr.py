"""Pull-request review.

pr_requests ⟕ prs -> pr_files (F1: not removed, ``.py``) -> J3 contents at the
head sha (F2: empty content skipped and not counted) -> per-file review ->
PR rollup in file order -> payloads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import PR_ERROR, PR_NOT_FOUND, fill, pr_summary, splitlines, where_computed
from revspark.operators import aggregates as A
from revspark.operators.dedup import dedup_findings
from revspark.plans.review import failed_files
from revspark.schemas import FINDING_COLUMNS
from revspark.session import write_once


def eligible_files(pr_files: DataFrame) -> DataFrame:
    """status is not 'removed' and the name ends with '.py' (case-sensitive)."""
    return pr_files.filter((F.col("status") != "removed") & F.col("filename").endswith(".py"))


def attach_contents(pr_files: DataFrame, prs: DataFrame, contents: DataFrame) -> DataFrame:
    """J3 + F2: file text at the PR head.

    ``contents(repo, path, ref, code)``; ``prs(pr_key, repo, head_sha)``.  Files
    are filtered (F1) before the join so no content row is read for them.
    """
    f = eligible_files(pr_files).join(prs.select("pr_key", "repo", "head_sha"), "pr_key")
    # a text under another name than ``.py`` is no eligible file's: Spark can then leave it out before it is decoded
    c = (contents.select("repo", F.col("path").alias("filename"), F.col("ref").alias("head_sha"), "code")
         .filter(F.col("filename").endswith(".py")))
    key = ["repo", "filename", "head_sha"]
    # empty texts stay out of the shuffle; a text stored more than once counts once.  Texts go to their key first, so that they
    # are sorted there only, and not before the shuffle as well; their number of partitions stands: what reads them parses them,
    # and Spark would join partitions by their bytes, which are few
    spark = contents.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    c = (where_computed(c, F.col("code").isNotNull() & (F.length("code") > 0)).repartition(n, *key)
         .groupBy(*key).agg(F.max("code").alias("code")))
    return f.join(c, key)


def pr_rollup(requests: DataFrame, prs: DataFrame, reviewed_files: DataFrame,
              findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A10: one result per PR request.

    ``requests(pr_key, repo_owner, repo_name, pr_number)``; ``reviewed_files``
    (pr_key, file_ord, total_lines) = the files actually reviewed;
    ``findings`` per file (pr_key, file_ord, …) already de-duplicated per file.
    A request without a readable PR record, or with one of ``errors`` (pr_key,
    file_ord, reason), is ``failed`` with a message (the first file's).
    """
    n = reviewed_files.groupBy("pr_key").agg(F.count(F.lit(1)).alias("files_analyzed"),
                                             F.sum("total_lines").alias("total_lines"))
    agg = findings.groupBy("pr_key").agg(*A.severity_count_aggs(), A.score_deduction().alias("_ded"))
    req = requests.select("pr_key", "repo_owner", "repo_name", "pr_number")
    j = (req.join(prs.select("pr_key", "number", "title"), "pr_key", "left")
         .join(n, "pr_key", "left").join(agg, "pr_key", "left"))
    err = F.lit(None).cast("string")
    if errors is not None:
        j = j.join(errors.groupBy("pr_key").agg(F.min_by("reason", "file_ord").alias("_err")), "pr_key", "left")
        err = F.col("_err")
    cnt = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ["n_findings"] + A.COUNT_COLUMNS}
    score = A.pr_score_expr(F.col("_ded"))
    ok = F.col("number").isNotNull() & err.isNull()
    full = F.concat_ws("/", "repo_owner", "repo_name")
    x = j.select("pr_key", "pr_number", "number", "title", ok.alias("_ok"), err.alias("_err"), full.alias("_full"),
                 F.coalesce(F.col("files_analyzed"), F.lit(0)).cast("long").alias("files_analyzed"),
                 F.coalesce(F.col("total_lines"), F.lit(0)).cast("long").alias("total_lines"),
                 *[v.alias(k) for k, v in cnt.items()], score.alias("overall_score"))
    return x.select(
        "pr_key",
        F.when(F.col("_ok"), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.col("_ok"), F.col("files_analyzed")).otherwise(F.lit(0)).alias("files_analyzed"),
        F.when(F.col("_ok"), F.col("total_lines")).otherwise(F.lit(0)).alias("total_lines"),
        *[F.when(F.col("_ok"), F.col(k)).otherwise(F.lit(0)).alias(k) for k in cnt],
        F.when(F.col("_ok"), F.col("overall_score")).otherwise(F.lit(100.0)).alias("overall_score"),
        F.when(F.col("_ok"), pr_summary("number", "title", "n_findings", "n_critical", "n_high",
                                        "n_medium", "n_low", "overall_score"))
        .when(F.col("number").isNotNull(), fill(PR_ERROR, error=F.col("_err")))
        .otherwise(fill(PR_NOT_FOUND, number=F.col("pr_number"), repo=F.col("_full"))).alias("summary"))


def file_line_counts(files: DataFrame) -> DataFrame:
    return files.select("pr_key", "file_ord", F.size(splitlines(F.col("code"))).alias("total_lines"))


def file_key() -> Column:
    """The review id of one file of a PR: ``pr_key/file_ord`` as text, exact for keys and lists of any size."""
    return F.concat_ws("/", F.col("pr_key").cast("string"), F.col("file_ord").cast("string"))


def from_file_key(df: DataFrame) -> DataFrame:
    """``pr_key`` and ``file_ord`` of rows keyed by :func:`file_key`."""
    part = F.split("review_id", "/")
    return df.withColumn("pr_key", part[0].cast("long")).withColumn("file_ord", part[1].cast("long"))


@dataclass
class PRReviewOutput:
    findings: DataFrame      # de-duplicated per file, with pr_key and file_ord
    file_stats: DataFrame    # (pr_key, file_ord, total_lines) of the files reviewed
    rollup: DataFrame        # one row per request (A10 + T8)
    payloads: DataFrame      # review bodies to post (S13)
    failures: list           # reviewers that contributed nothing (U2)
    rejects: DataFrame       # findings that break a rule, with the reason (F5), pr_key and file_ord
    file_errors: DataFrame   # (pr_key, file_ord, review_id, file_path, agent_name, reason): reviewers that failed on a file


def review_prs(requests: DataFrame, prs: DataFrame, pr_files: DataFrame, contents: DataFrame,
               reviewers=None, scan_rules=None, limit: int = 20, materialize: bool = True,
               keep_findings: bool = False) -> PRReviewOutput:
    """Review pull requests end to end.

    ``requests(pr_key, repo_owner, repo_name, pr_number)``; ``prs`` from
    :func:`ingest_prs` plus ``repo`` and ``post_review``; ``pr_files`` from
    :func:`ingest_prs`; ``contents(repo, path, ref, code)``.  Eligible files (F1)
    get their text at the head commit (J3, F2) and are reviewed one by one (the
    syntax tree is parsed once and written: the findings and the line counts
    both read it), findings are validated (F5), de-duplicated per file and rolled
    up per PR in file order (A10); payloads carry the first ``limit`` comments.
    A PR with a file on which every reviewer failed is ``failed``.
    ``materialize=False`` leaves the elements unwritten when only the findings
    will be read.  ``keep_findings=True`` writes the de-duplicated findings once:
    the payloads read them for the comments and for the summary.
    """
    from revspark.operators.normalize import validate_findings
    from revspark.operators.reviewers import RULE_KINDS, ReviewerSet, ReviewInputs, run_isolated
    from revspark.operators.structure import extract_elements
    from revspark.sources.github import review_payloads

    att = attach_contents(pr_files, prs, contents)
    files = att.select(file_key().alias("review_id"), F.col("filename").alias("file_path"), "code")
    el = extract_elements(files, checkpoint=materialize, kinds=RULE_KINDS)
    reviewers = reviewers or ReviewerSet()
    run = run_isolated(ReviewInputs(files=files, elements=el, scan_rules=scan_rules), reviewers)
    valid, rejects = validate_findings(run.findings.select(*FINDING_COLUMNS))
    findings = from_file_key(dedup_findings(valid))
    if keep_findings:
        findings = write_once(findings, "findings")
    lost = failed_files(run, reviewers)
    stats = from_file_key(el.filter(F.col("kind") == "file")).select(
        "pr_key", "file_ord", F.col("n_lines").alias("total_lines"))
    rollup = pr_rollup(requests, prs, stats, findings, None if lost is None else from_file_key(lost))
    payloads = review_payloads(prs.select("pr_key", "head_sha", "post_review"), findings,
                               rollup.select("pr_key", "summary"), limit)
    return PRReviewOutput(findings, stats, rollup, payloads, run.failures, from_file_key(rejects), from_file_key(run.file_errors))
