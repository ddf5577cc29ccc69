"""Review lifecycle as one lazy plan (the file and corpus review, A8/A9).

files -> reviewers (U1/U2) -> validation (F5) -> keep-best dedup (W1)
      -> per-file rollup (A1, A5, A8, T7) + agent summaries (A4/J5)

``review_files`` returns a :class:`ReviewOutput` with the findings table and
the review table; both are DataFrames (nothing is collected).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.operators import aggregates as A
from revspark.operators.dedup import dedup_findings, rank_findings, top_findings
from revspark.operators.normalize import validate_findings
from revspark.operators.reviewers import FileReviewer, ReviewerRun, ReviewerSet, ReviewInputs, run_isolated
from revspark.schemas import FINDING_COLUMNS

FILE_KEY = ["review_id", "file_path"]


@dataclass
class ReviewOutput:
    findings: DataFrame          # valid, de-duplicated findings
    file_reviews: DataFrame      # one row per file (A8)
    reviews: DataFrame           # file_reviews + agent_summaries map
    failures: list               # reviewers that contributed nothing (U2)
    rejects: DataFrame           # findings that break a rule, with the reason (F5)
    file_errors: DataFrame       # (review_id, file_path, agent_name, reason): reviewers that failed on a file

    def ranked(self) -> DataFrame:
        """The findings with their rank in the file (W2); the rollups do not need it."""
        return rank_findings(self.findings)


def review_files(inputs: ReviewInputs, reviewers: ReviewerSet | None = None,
                 ai_summaries: DataFrame | None = None, persist: bool = False) -> ReviewOutput:
    """Review every file of ``inputs.files``.

    ``files`` needs ``total_lines`` or ``code`` (then A11 derives it).  With
    ``persist=True`` the de-duplicated findings are checkpointed to the shared
    checkpoint folder (reliable: survives executor loss) so the several
    outputs do not re-run parsing and ingest.
    """
    reviewers = reviewers or ReviewerSet()
    run = run_isolated(inputs, reviewers)
    raw, failures = run.findings, run.failures
    valid, rejects = validate_findings(raw.select(*FINDING_COLUMNS))
    findings = dedup_findings(valid)
    if persist:
        from revspark.session import checkpoint_root
        checkpoint_root(findings.sparkSession)
        findings = findings.checkpoint(eager=True)
    files = inputs.files
    if "total_lines" not in files.columns:
        files = files.join(A.line_metrics(files).select(*FILE_KEY, "total_lines"), FILE_KEY)
    fr = A.file_reviews(files.select(*FILE_KEY, "total_lines"), findings, ai_summaries=ai_summaries)
    lost = failed_files(run, reviewers)
    if lost is not None:
        fr = (fr.join(lost.select(*FILE_KEY, F.lit(True).alias("_lost")), FILE_KEY, "left").withColumn(
            "status", F.when(F.col("_lost"), F.lit("failed")).otherwise(F.col("status"))).drop("_lost"))
    summ = A.agent_summaries(findings, fr.select(*FILE_KEY), reviewers.names(), FILE_KEY)
    amap = (summ.groupBy(*FILE_KEY)
            .agg(F.map_from_entries(F.collect_list(F.struct("agent_name", "summary"))).alias("agent_summaries")))
    reviews = fr.join(amap, FILE_KEY, "left")
    return ReviewOutput(findings, fr, reviews, failures, rejects, run.file_errors)


def failed_files(run: ReviewerRun, reviewers: ReviewerSet) -> DataFrame | None:
    """(review_id, file_path, reason) of the files on which every reviewer failed: they have not been reviewed.
    One reviewer that fails leaves the others' findings and the status as they are.  None: there can be no such file."""
    if not any(isinstance(r, FileReviewer) for r in reviewers.reviewers):
        return None
    left = len(reviewers.reviewers) - len(run.failures)
    n = run.file_errors.groupBy(*FILE_KEY).agg(F.count_distinct("agent_name").alias("_n"), F.min("reason").alias("reason"))
    return n.where(F.col("_n") >= left).drop("_n")


def review_summary_prompts(findings: DataFrame, file_reviews: DataFrame, order_cols=None) -> DataFrame:
    """W3 + T11: the summary prompt per reviewed file (top 10 findings)."""
    from revspark.operators.prompts import build_prompts
    from revspark.schemas import ORDER_COLUMNS
    f = findings.drop("rank") if "rank" in findings.columns else findings
    top = top_findings(f, 10, order_cols=order_cols or ORDER_COLUMNS)
    d = file_reviews.select(*FILE_KEY, "overall_score").join(top, FILE_KEY, "left")
    return build_prompts("summary", d)
