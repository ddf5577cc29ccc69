"""Counts, zero-filled pivots, agent summaries, scores, rollups.

All per-group work is one-pass conditional aggregation (``count_if`` /
``sum``), which Spark pre-aggregates map-side, so a huge group costs one
partial row per map task.  Score sums are DECIMAL so the result does not
depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.functions import lookups as L
from revspark.functions.text import AGENT_SUMMARY, fill, let, review_summary, severity_list, splitlines, strip
from revspark.schemas import (COMPLEXITY_WEIGHTS, DEFAULT_AGENTS, NO_ISSUES, SCORE_WEIGHT_DEFAULT,
                              SCORE_WEIGHTS, SEVERITIES)

COUNT_COLUMNS = ["n_critical", "n_high", "n_medium", "n_low", "n_info"]


def severity_count_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_findings")] + [
        F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]


def score_deduction() -> Column:
    """Σ weight(severity) × confidence, exact (DECIMAL)."""
    w = L.severity_weight(F.col("severity"), SCORE_WEIGHTS, SCORE_WEIGHT_DEFAULT).cast("decimal(4,1)")
    return F.sum(w * F.col("confidence").cast("decimal(18,15)"))


def severity_counts(findings: DataFrame, keys=("review_id",)) -> DataFrame:
    """A1: findings and per-severity counts per group, one pass."""
    return findings.groupBy(*keys).agg(*severity_count_aggs())


def by_severity(findings: DataFrame, keys=("review_id",), reviews: DataFrame | None = None) -> DataFrame:
    """A2: per group, all five severities present (zero when empty).

    Counted once (A1) and unpivoted with ``stack``.  With ``reviews`` (one row
    per group or more) a review without findings has its five zeros too.
    """
    keys = list(keys)
    c = severity_counts(findings, keys)
    if reviews is not None:
        c = reviews.select(*keys).distinct().join(c, keys, "left").na.fill(0, ["n_findings", *COUNT_COLUMNS])
    stack = "stack(5, " + ", ".join(f"'{s}', n_{s}" for s in SEVERITIES) + ") as (severity, n)"
    return c.select(*keys, F.expr(stack))


def by_category(findings: DataFrame, keys=("review_id",)) -> DataFrame:
    """A3: counts per present category."""
    return findings.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def agent_summary_text(n_critical, n_high, n_medium, n_low) -> Column:
    parts = severity_list(n_critical, n_high, n_medium, n_low)
    return F.when(F.length(parts) > 0, fill(AGENT_SUMMARY, parts=parts)).otherwise(F.lit(NO_ISSUES))


def agent_summaries(findings: DataFrame, reviews: DataFrame, agents=None,
                    key: str | list = "review_id") -> DataFrame:
    """A4 + J5: one summary per (review, agent) for every registered agent and
    every agent that reported something.

    ``agents`` is the small registered list (name[, description]); it becomes a
    literal array exploded per review — its size is the number of registered
    reviewers, never data-dependent.
    """
    names = [a[0] if isinstance(a, (tuple, list)) else a for a in (agents or DEFAULT_AGENTS)]
    # every review gets one row per registered reviewer: a literal array
    # exploded per review (a generator, no join)
    reg = F.array(*[F.struct(F.lit(n).alias("agent_name"), F.lit(i).alias("agent_ord"))
                    for i, n in enumerate(names)])
    keys = [key] if isinstance(key, str) else list(key)
    spine = reviews.select(*keys).distinct().select(*keys, F.inline(reg)).drop("agent_ord")
    counts = findings.groupBy(*keys, "agent_name").agg(*severity_count_aggs())
    j = spine.join(counts, [*keys, "agent_name"], "full_outer")
    return j.select(
        *keys, "agent_name",
        F.coalesce(F.col("n_findings"), F.lit(0)).alias("n_findings"),
        agent_summary_text(*[F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS[:4]]).alias("summary"))


def file_scores(findings: DataFrame, files: DataFrame, keys=("review_id", "file_path"),
                lines_col: str = "total_lines") -> DataFrame:
    """A5: ``100 - Σ(w·conf) / max(1, lines/100)``, floored at 0, one decimal.

    Files without findings score 100.  ``files`` holds one row per file with
    its line count.
    """
    keys = list(keys)
    d = findings.groupBy(*keys).agg(score_deduction().alias("_ded"))
    j = files.select(*keys, lines_col).join(d, keys, "left")
    return j.select(*keys, lines_col, file_score_expr(F.col("_ded"), F.col(lines_col)).alias("overall_score"))


def file_score_expr(ded: Column, lines: Column) -> Column:
    size = F.greatest(F.lit(1.0), lines.cast("double") / F.lit(100.0))
    raw = F.greatest(F.lit(0.0), F.lit(100.0) - ded.cast("double") / size)
    return F.when(ded.isNull(), F.lit(100.0)).otherwise(
        F.round(raw.cast("decimal(12,6)"), 1).cast("double"))


def pr_score_expr(ded: Column) -> Column:
    """``max(0, round(100 - Σ(w·conf), 1))``; no size factor."""
    return F.when(ded.isNull(), F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), F.round(F.lit(100).cast("decimal(4,1)") - ded, 1).cast("double")))


def pr_scores(findings: DataFrame, keys=("review_id",)) -> DataFrame:
    return findings.groupBy(*keys).agg(pr_score_expr(score_deduction()).alias("overall_score"))


def complexity_score_expr(counts: dict) -> Column:
    """From a {severity: count Column} mapping; weights 25/15/5/2/1."""
    ded = F.lit(0)
    weights = dict(COMPLEXITY_WEIGHTS)
    for sev, c in counts.items():
        ded = ded + F.coalesce(c, F.lit(0)) * F.lit(weights.get(sev, 0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - ded.cast("double")))


def complexity_scores(counts: DataFrame, keys=("review_id",)) -> DataFrame:
    keys = list(keys)
    m = {s: F.col(f"n_{s}") for s in SEVERITIES if f"n_{s}" in counts.columns}
    return counts.select(*keys, complexity_score_expr(m).alias("complexity_score"))


def line_metrics(files: DataFrame, keys=("review_id", "file_path"), code_col: str = "code") -> DataFrame:
    """Total / blank / comment / code lines per file (Python ``splitlines``).

    The text is split once and the blank/comment counts come from one
    ``aggregate`` pass over the lines (each line stripped once).
    """
    def count(lines):
        def step(acc, x):
            s = strip(x)
            return F.struct((acc["b"] + F.when(F.length(s) == 0, 1).otherwise(0)).alias("b"),
                            (acc["c"] + F.when(s.startswith("#"), 1).otherwise(0)).alias("c"),
                            (acc["t"] + 1).alias("t"))
        zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("t"))
        return F.aggregate(lines, zero, step)

    m = let(splitlines(F.col(code_col)), count)
    return files.select(*keys, m.alias("_m")).select(
        *keys, F.col("_m.t").alias("total_lines"), F.col("_m.b").alias("blank_lines"),
        F.col("_m.c").alias("comment_lines"), (F.col("_m.t") - F.col("_m.b") - F.col("_m.c")).alias("code_lines"))


def line_metrics_rollup(metrics: DataFrame, by=("language",)) -> DataFrame:
    """A11 rollup: files and line counts per group (language, repository, …)."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.sum(c).cast("long").alias(c) for c in ("total_lines", "blank_lines", "comment_lines", "code_lines")])


def file_reviews(files: DataFrame, findings: DataFrame, keys=("review_id", "file_path"),
                 ai_summaries: DataFrame | None = None) -> DataFrame:
    """One review row per file: lines, counts, score, status, summary.

    ``files`` needs ``total_lines`` (A11); findings are already de-duplicated.
    """
    keys = list(keys)
    agg = findings.groupBy(*keys).agg(*severity_count_aggs(), score_deduction().alias("_ded"))
    j = files.select(*keys, "total_lines").join(agg, keys, "left")
    if ai_summaries is not None:
        j = j.join(ai_summaries, keys, "left")
    cnt = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ["n_findings"] + COUNT_COLUMNS}
    score = file_score_expr(F.col("_ded"), F.col("total_lines"))
    out = j.select(*keys, "total_lines", *[v.alias(k) for k, v in cnt.items()],
                   score.alias("overall_score"),
                   *(["ai_summary"] if ai_summaries is not None else []))
    return out.select(
        *keys, F.lit(1).alias("files_analyzed"), "total_lines", "n_findings", *COUNT_COLUMNS,
        "overall_score", F.lit("completed").alias("status"),
        review_summary(F.col("file_path"), F.col("n_findings"), F.col("n_critical"), F.col("n_high"),
                       F.col("n_medium"), F.col("n_low"), F.col("overall_score"),
                       F.col("ai_summary") if ai_summaries is not None else None).alias("summary"))


def findings_cube(findings: DataFrame, dims, sets=None) -> DataFrame:
    """Counts and summed confidence of findings over grouping sets of ``dims`` (all subsets unless ``sets`` are given), with
    ``level``, the grouping id: bit by bit, first dimension highest, 1 where a dimension is summed over.

    Findings are counted once by all dimensions; only those few counts are expanded to the sets.
    """
    cells = findings.groupBy(*dims).agg(*severity_count_aggs(), F.sum(F.col("confidence").cast("decimal(18,15)")).alias("conf"))
    names = [c for c in cells.columns if c not in {*dims, "conf"}]
    grouped = cells.cube(*dims) if sets is None else cells.groupingSets([[F.col(c) for c in s] for s in sets], *dims)
    return grouped.agg(F.grouping_id(*dims).cast("long").alias("level"), *(F.sum(c).alias(c) for c in names),
                       F.sum("conf").cast("double").alias("sum_confidence"))
