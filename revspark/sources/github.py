"""S8-S10 ingest of pull-request records, S13/S14 review payload sinks.

Inputs are the JSON documents a code host returns (PR record, PR file list,
file contents, PR comments), one per row.  Defaults follow the fields' documented
fallbacks.  Payload sinks produce the JSON bodies a reviewer would post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.functions.text import finding_comment, where_computed

_REF = T.StructType([T.StructField("sha", T.StringType()), T.StructField("ref", T.StringType())])

PR_SCHEMA = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("head", _REF),
    T.StructField("base", _REF),
    T.StructField("diff_url", T.StringType()),
    T.StructField("html_url", T.StringType()),
])

PR_FILES_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("additions", T.IntegerType()),
    T.StructField("deletions", T.IntegerType()),
    T.StructField("changes", T.IntegerType()),
    T.StructField("patch", T.StringType()),
    T.StructField("contents_url", T.StringType()),
    T.StructField("raw_url", T.StringType()),
]))

COMMENTS_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("created_at", T.StringType()),
]))


def _s(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def with_part_offset(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``_before``: how many array items the earlier parts of the same list hold.

    A list may arrive in several rows with a ``part`` number (pages of a long
    list); without that column every row is a whole list.
    """
    if "part" not in df.columns:
        return df.withColumn("_before", F.lit(0).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(F.coalesce(F.json_array_length("json"), F.lit(0))).over(earlier),
                                               F.lit(0)).cast("long"))


def ingest_prs(pr_json: DataFrame, files_json: DataFrame):
    """``pr_json(pr_key, pr_number, json)`` + ``files_json(pr_key, json)`` -> (prs, pr_files).

    ``pr_number`` is the requested number (used when the record has none).
    A PR record that is missing or not an object gives no ``prs`` row, so the
    request later rolls up as failed (A10).
    """
    p = F.when(F.regexp_like(F.col("json"), F.lit(r"^\s*\{")), F.from_json("json", PR_SCHEMA))
    prs = (where_computed(pr_json.withColumn("p", p), F.col("p").isNotNull())
           .select("pr_key",
                   F.coalesce(F.col("p.number"), F.col("pr_number")).alias("number"),
                   _s(F.col("p.title")).alias("title"),
                   F.col("p.body").alias("body"),
                   _s(F.col("p.state"), "open").alias("state"),
                   _s(F.col("p.user.login")).alias("user"),
                   _s(F.col("p.head.sha")).alias("head_sha"),
                   _s(F.col("p.base.sha")).alias("base_sha"),
                   _s(F.col("p.head.ref")).alias("head_ref"),
                   _s(F.col("p.base.ref")).alias("base_ref"),
                   _s(F.col("p.diff_url")).alias("diff_url"),
                   _s(F.col("p.html_url")).alias("html_url")))
    f = F.when(F.regexp_like(F.col("json"), F.lit(r"^\s*\[")), F.from_json("json", PR_FILES_SCHEMA))
    files = (with_part_offset(files_json, "pr_key").select("pr_key", "_before", F.posexplode(f).alias("_pos", "x"))
             .select("pr_key",
                     (F.col("_before") + F.col("_pos") + 1).alias("file_ord"),
                     _s(F.col("x.filename")).alias("filename"),
                     _s(F.col("x.status"), "modified").alias("status"),
                     F.coalesce(F.col("x.additions"), F.lit(0)).alias("additions"),
                     F.coalesce(F.col("x.deletions"), F.lit(0)).alias("deletions"),
                     F.coalesce(F.col("x.changes"), F.lit(0)).alias("changes"),
                     F.col("x.patch").alias("patch"),
                     _s(F.col("x.contents_url")).alias("contents_url"),
                     F.col("x.raw_url").alias("raw_url")))
    return prs, files


BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="


def decode_contents(content: Column, encoding: Column) -> Column:
    """Contents record -> text.  base64 is decoded as UTF-8 (NULL when not
    decodable); other encodings pass through; empty content gives ``""``.

    Characters outside the base64 alphabet (line breaks every 60 characters in
    the form code hosts return) are dropped before decoding.
    """
    enc = F.coalesce(encoding, F.lit("base64"))
    c = F.coalesce(content, F.lit(""))
    # Fast path: Spark's decoder itself passes over breaks and blanks, but for those after the padding, of which the last line's
    # break is the one that occurs.  Only text that it does not take is cleaned: by translate, which looks up every character,
    # and by a regex if non-alphabet characters are left.
    last = (F.when(c.endswith("\r\n"), F.substring(c, F.lit(1), F.length(c) - 2))
            .when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))
    t = F.translate(c, "\n\r \t", "")
    clean = F.when(F.length(F.translate(t, BASE64_ALPHABET, "")) == 0, t) \
        .otherwise(F.regexp_replace(t, "[^A-Za-z0-9+/=]", ""))
    b = F.coalesce(F.try_to_binary(last, F.lit("base64")), F.try_to_binary(clean, F.lit("base64")))
    # the bytes are named once: named in a condition and in its value, they would be decoded twice
    decoded = F.try_validate_utf8(b.cast("string"))
    return F.when((enc == "base64") & (c != ""), decoded).otherwise(c)


def ingest_contents(df: DataFrame) -> DataFrame:
    """S9 over a table ``(…, content, encoding)`` -> adds ``code``."""
    return df.withColumn("code", decode_contents(F.col("content"), F.col("encoding")))


def ingest_pr_comments(df: DataFrame) -> DataFrame:
    """``(pr_key, json[, part])`` where json is a comment array; non-array -> no rows."""
    c = F.when(F.regexp_like(F.col("json"), F.lit(r"^\s*\[")), F.from_json("json", COMMENTS_SCHEMA))
    return (with_part_offset(df, "pr_key").select("pr_key", "_before", F.posexplode(c).alias("_pos", "x"))
            .select("pr_key", (F.col("_before") + F.col("_pos") + 1).alias("comment_ord"),
                    F.col("x.id").alias("comment_id"), F.col("x.path").alias("path"),
                    F.col("x.line").alias("line"), F.col("x.body").alias("body"),
                    F.col("x.user.login").alias("user"), F.col("x.created_at").alias("created_at")))


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------

def comment_rows(findings: DataFrame, limit: int = 20,
                 order_cols=("agent_ord", "source_ord", "item_ord")) -> DataFrame:
    """W4 + T6: the first ``limit`` findings of each PR in file order then rank.

    ``findings`` carries ``pr_key, file_ord`` and either the W2 ``rank`` inside
    the file or the columns to compute it (``severity_rank, line_number,
    pos_*``).  Only a file's first ``limit`` findings can be among its PR's
    first ``limit``, so the per-file rank is computed with ``row_number() <=
    limit`` — both windows plan as window-group limits that trim rows before
    the shuffle: a PR or file with millions of findings ships ``limit`` rows per
    task.
    """
    if "rank" not in findings.columns:
        per_file = Window.partitionBy("pr_key", "file_ord").orderBy(
            "severity_rank", "line_number", *[f"pos_{c}" for c in order_cols])
        findings = findings.withColumn("rank", F.row_number().over(per_file)).filter(F.col("rank") <= limit)
    w = Window.partitionBy("pr_key").orderBy("file_ord", "rank")
    return (findings.withColumn("comment_ord", F.row_number().over(w))
            .filter(F.col("comment_ord") <= limit)
            .withColumn("body", finding_comment("severity", "category", "message",
                                                "suggestion", "rule_id")))


def review_payloads(prs: DataFrame, findings: DataFrame, summaries: DataFrame,
                    limit: int = 20) -> DataFrame:
    """One review body per PR that asked for posting and has findings.

    ``prs(pr_key, head_sha, post_review)``, ``summaries(pr_key, summary)``.
    The comments array is built from at most ``limit`` rows per PR, so the
    grouped list is bounded.
    """
    c = comment_rows(findings, limit)
    comments = (c.groupBy("pr_key")
                .agg(F.sort_array(F.collect_list(F.struct(
                    F.col("comment_ord").alias("_o"), F.col("file_path").alias("path"),
                    F.col("line_number").alias("line"), F.col("body").alias("body")))).alias("cs")))
    body = F.struct(F.col("head_sha").alias("commit_id"), F.col("summary").alias("body"),
                    F.lit("COMMENT").alias("event"),
                    F.when(F.size("cs") > 0,
                           F.transform("cs", lambda s: s.dropFields("_o"))).alias("comments"))
    asked = prs.filter(F.col("post_review"))
    if limit > 0:  # a PR with findings has comments: findings are read once
        asked = asked.join(comments, "pr_key")
    else:
        asked = asked.join(findings.select("pr_key").distinct(), "pr_key").join(comments, "pr_key", "left")
    return asked.join(summaries, "pr_key").select("pr_key", F.to_json(body).alias("payload"))


def comment_payloads(findings: DataFrame, prs: DataFrame) -> DataFrame:
    """One single-comment payload per finding (body, commit, path, line, side)."""
    j = findings.join(prs.select("pr_key", "head_sha"), "pr_key")
    body = F.struct(
        finding_comment("severity", "category", "message", "suggestion", "rule_id").alias("body"),
        F.col("head_sha").alias("commit_id"), F.col("file_path").alias("path"),
        F.col("line_number").alias("line"), F.lit("RIGHT").alias("side"))
    return j.select("pr_key", "file_path", "line_number", F.to_json(body).alias("payload"))
