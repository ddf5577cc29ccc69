"""Code-file source and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.functions.lookups import detect_language, normalize_language
from revspark.schemas import DEFAULT_FILE_PATH, DEFAULT_LANGUAGE, MAX_CODE_BYTES


def read_files(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Many (path, code) pairs -> ``files(review_id, file_path, language, code)``.

    ``fmt='text'`` reads a directory tree of source files (one row per file,
    whole text); ``fmt='parquet'`` reads a table that already has
    ``file_path, code`` (and optionally ``review_id``).  ``review_id`` defaults
    to a stable hash of the path.
    """
    if fmt == "text":
        # keywords, not .option(): text() passes its own wholetext default
        df = (spark.read.text(path, wholetext=True, recursiveFileLookup=True)
              .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("code")))
    else:
        df = spark.read.format(fmt).load(path)
    if "review_id" not in df.columns:
        df = df.withColumn("review_id", F.xxhash64("file_path"))
    if "language" not in df.columns:
        df = df.withColumn("language", detect_language(F.col("file_path"), F.col("code")))
    return df.select("review_id", "file_path", "language", "code")


def validate_submissions(df: DataFrame):
    """Code present, 1..1,000,000 UTF-8 bytes; defaults for path and language.

    Returns ``(accepted, rejects)``; rejects keep the row and carry ``reason``.
    """
    reason = (F.when(F.col("code").isNull(), F.lit("code: field required"))
              .when(F.length("code") < 1, F.lit("code: should have at least 1 character"))
              .when(F.octet_length("code") > MAX_CODE_BYTES,
                    F.lit(f"code: size exceeds maximum of {MAX_CODE_BYTES} bytes")))
    lang = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
    path = F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string")
    out = (df.withColumn("file_path", F.coalesce(path, F.lit(DEFAULT_FILE_PATH)))
           .withColumn("language", F.coalesce(normalize_language(lang), F.lit(DEFAULT_LANGUAGE)))
           .withColumn("reason", reason))
    return out.filter(F.col("reason").isNull()).drop("reason"), out.filter(F.col("reason").isNotNull())


def validate_pr_requests(df: DataFrame):
    """S3: non-empty owner and name, pr_number >= 1; adds ``full_repo_name``."""
    reason = (F.when(F.col("repo_owner").isNull() | (F.length("repo_owner") < 1),
                     F.lit("repo_owner: should have at least 1 character"))
              .when(F.col("repo_name").isNull() | (F.length("repo_name") < 1),
                    F.lit("repo_name: should have at least 1 character"))
              .when(F.col("pr_number").isNull() | (F.col("pr_number") < 1),
                    F.lit("pr_number: should be greater than or equal to 1")))
    out = (df.withColumn("full_repo_name", F.concat_ws("/", "repo_owner", "repo_name"))
           .withColumn("include_comments", F.coalesce(
               F.col("include_comments") if "include_comments" in df.columns else F.lit(None),
               F.lit(False)))
           .withColumn("post_review", F.coalesce(
               F.col("post_review") if "post_review" in df.columns else F.lit(None), F.lit(False)))
           .withColumn("reason", reason))
    return out.filter(F.col("reason").isNull()).drop("reason"), out.filter(F.col("reason").isNotNull())
