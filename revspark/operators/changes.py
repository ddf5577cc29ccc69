"""Change feed between two reviews of the same code: which findings are new, fixed or still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a finding is known by; its line is left out, as edits above it move it.
FINGERPRINT = ("review_id", "file_path", "agent_name", "category", "severity", "message_key")
STATUSES = ("new", "fixed", "open")


def message_key(message: Column) -> Column:
    """The first 100 characters of a message with its numbers blanked: messages name lines and counts."""
    return F.regexp_replace(F.substring(message, 1, 100), "[0-9]+", "#")


def review_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per fingerprint and status: n, how many findings of it are new, fixed or open (a multiset difference and
    intersection), with first_line, their smallest line in the review that has them (open: in the later one).

    Both sides are counted in one aggregation, combined before the shuffle, so that a fingerprint of any
    number of findings is one row a task. Null fields are equal to each other.
    """
    def side(df: DataFrame, late: bool) -> DataFrame:
        return df.select(*FINGERPRINT[:-1], message_key(F.col("message")).alias("message_key"), "line_number", F.lit(late).alias("late"))

    late = F.col("late")
    counted = side(before, False).union(side(after, True)).groupBy(*FINGERPRINT).agg(
        F.count_if(~late).alias("b"), F.count_if(late).alias("a"),
        F.min(F.when(~late, F.col("line_number"))).alias("line_b"), F.min(F.when(late, F.col("line_number"))).alias("line_a"))
    none = F.lit(0).cast("long")
    n = {"new": F.greatest(F.col("a") - F.col("b"), none), "fixed": F.greatest(F.col("b") - F.col("a"), none),
         "open": F.least("a", "b")}
    rows = F.array(*(F.struct(F.lit(s).alias("status"), n[s].alias("n"),
                              F.col("line_b" if s == "fixed" else "line_a").alias("first_line")) for s in STATUSES))
    return counted.select(*FINGERPRINT, F.inline(rows)).where("n > 0")


def change_counts(changes: DataFrame, keys=("review_id",)) -> DataFrame:
    """n_new, n_fixed and n_open per review (or other keys)."""
    return changes.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in STATUSES))
