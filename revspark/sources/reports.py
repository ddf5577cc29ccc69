"""Scanner report ingest (ruff / pylint / bandit JSON -> raw_findings).

Input: ``reports(review_id, file_path, tool, report[, part])`` where ``report``
is the tool's JSON text for one file (optionally split into numbered parts so
no single row grows without bound).  Output: the canonical ``raw_findings``
rows, one per reported item, with the tool's defaults applied.

A malformed report, or a report of the wrong shape (object where an array is
expected and vice versa), yields zero rows for that tool and file only; the
report is listed by :func:`report_rejects`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.functions.lookups import pylint_severity, ruff_severity

# whole numbers are read as text: some tools send them as strings
_POS = T.StructType([T.StructField("row", T.StringType()), T.StructField("column", T.StringType())])

RUFF_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("location", _POS),
    T.StructField("end_location", _POS),
    T.StructField("fix", T.StructType([T.StructField("message", T.StringType())])),
]))

PYLINT_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("message-id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("symbol", T.StringType()),
]))

BANDIT_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("issue_text", T.StringType()),
    T.StructField("line_number", T.StringType()),
    T.StructField("issue_severity", T.StringType()),
    T.StructField("issue_confidence", T.StringType()),
    T.StructField("line_range", T.ArrayType(T.IntegerType())),
    T.StructField("code", T.StringType()),
    T.StructField("issue_cwe", T.StructType([T.StructField("id", T.IntegerType()),
                                             T.StructField("link", T.StringType())])),
])))])

RAW_COLUMNS = ["review_id", "file_path", "tool", "item_ord", "rule_code", "message",
               "line_number", "column", "end_line_number", "tool_severity", "tool_confidence",
               "suggestion", "code_snippet", "symbol", "test_name", "line_range", "cwe_id"]

def _is_array_text(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[\s]*\["))


def _is_object_text(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[\s]*\{"))


def _explode(df: DataFrame, parsed: Column) -> DataFrame:
    """One row per reported item; ``item_ord`` runs on through the parts of a report."""
    before = F.lit(0)
    if "part" in df.columns:
        n = F.when(_is_array_text(F.col("report")), F.json_array_length("report")).otherwise(
            F.json_array_length(F.get_json_object("report", "$.results")))
        earlier = (Window.partitionBy("review_id", "file_path", "tool").orderBy("part")
                   .rowsBetween(Window.unboundedPreceding, -1))
        before = F.coalesce(F.sum(F.coalesce(n, F.lit(0))).over(earlier), F.lit(0))
    return (df.withColumn("_before", before.cast("long"))
            .select("review_id", "file_path", "tool", "_before", F.posexplode(parsed).alias("_pos", "it"))
            .withColumn("item_ord", F.col("_before") + F.col("_pos") + 1))


def _int(c: Column) -> Column:
    """A JSON number, or a number sent as a string."""
    return c.try_cast("int")


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ingest_ruff(reports: DataFrame) -> DataFrame:
    """Ruff JSON array -> raw_findings (tool 'ruff')."""
    r = reports.filter(F.col("tool") == "ruff")
    parsed = F.when(_is_array_text(F.col("report")), F.from_json("report", RUFF_SCHEMA))
    x = _explode(r, parsed)
    return x.select(
        "review_id", "file_path", "tool", "item_ord",
        _s(F.col("it.code")).alias("rule_code"),
        _s(F.col("it.message")).alias("message"),
        F.coalesce(_int(F.col("it.location.row")), F.lit(1)).alias("line_number"),
        F.coalesce(_int(F.col("it.location.column")), F.lit(0)).alias("column"),
        _int(F.col("it.end_location.row")).alias("end_line_number"),
        ruff_severity(F.col("it.code")).alias("tool_severity"),
        F.lit(None).cast("string").alias("tool_confidence"),
        _s(F.col("it.fix.message")).alias("suggestion"),
        F.lit(None).cast("string").alias("code_snippet"),
        F.lit(None).cast("string").alias("symbol"),
        F.lit(None).cast("string").alias("test_name"),
        F.lit(None).cast("array<int>").alias("line_range"),
        F.lit(None).cast("int").alias("cwe_id"),
    )


def ingest_pylint(reports: DataFrame) -> DataFrame:
    """Pylint JSON array -> raw_findings (tool 'pylint')."""
    r = reports.filter(F.col("tool") == "pylint")
    parsed = F.when(_is_array_text(F.col("report")), F.from_json("report", PYLINT_SCHEMA))
    x = _explode(r, parsed)
    return x.select(
        "review_id", "file_path", "tool", "item_ord",
        _s(F.col("it.`message-id`")).alias("rule_code"),
        _s(F.col("it.message")).alias("message"),
        F.coalesce(_int(F.col("it.line")), F.lit(1)).alias("line_number"),
        F.coalesce(_int(F.col("it.column")), F.lit(0)).alias("column"),
        F.lit(None).cast("int").alias("end_line_number"),
        pylint_severity(F.col("it.type")).alias("tool_severity"),
        F.lit(None).cast("string").alias("tool_confidence"),
        F.lit("").alias("suggestion"),
        F.lit(None).cast("string").alias("code_snippet"),
        _s(F.col("it.symbol")).alias("symbol"),
        F.lit(None).cast("string").alias("test_name"),
        F.lit(None).cast("array<int>").alias("line_range"),
        F.lit(None).cast("int").alias("cwe_id"),
    )


def ingest_bandit(reports: DataFrame) -> DataFrame:
    """Bandit JSON object ``{"results": [...]}`` -> raw_findings (tool 'bandit')."""
    r = reports.filter(F.col("tool") == "bandit")
    parsed = F.when(_is_object_text(F.col("report")),
                    F.from_json("report", BANDIT_SCHEMA).getField("results"))
    x = _explode(r, parsed)
    return x.select(
        "review_id", "file_path", "tool", "item_ord",
        _s(F.col("it.test_id")).alias("rule_code"),
        _s(F.col("it.issue_text")).alias("message"),
        F.coalesce(_int(F.col("it.line_number")), F.lit(1)).alias("line_number"),
        F.lit(None).cast("int").alias("column"),
        F.lit(None).cast("int").alias("end_line_number"),
        F.coalesce(F.col("it.issue_severity"), F.lit("MEDIUM")).alias("tool_severity"),
        F.coalesce(F.col("it.issue_confidence"), F.lit("MEDIUM")).alias("tool_confidence"),
        F.lit("").alias("suggestion"),
        _s(F.col("it.code")).alias("code_snippet"),
        F.lit(None).cast("string").alias("symbol"),
        _s(F.col("it.test_name")).alias("test_name"),
        F.coalesce(F.col("it.line_range"), F.array().cast("array<int>")).alias("line_range"),
        F.col("it.issue_cwe.id").alias("cwe_id"),
    )


def ingest_all(reports: DataFrame) -> DataFrame:
    """All three tools; each report is read by its own tool's parser only."""
    return (ingest_ruff(reports)
            .unionByName(ingest_pylint(reports))
            .unionByName(ingest_bandit(reports)))


def report_rejects(reports: DataFrame) -> DataFrame:
    """Reports that yield no rows because they are malformed or mis-shaped."""
    ok = (F.when(F.col("tool") == "ruff",
                 _is_array_text(F.col("report")) & F.from_json("report", RUFF_SCHEMA).isNotNull())
          .when(F.col("tool") == "pylint",
                _is_array_text(F.col("report")) & F.from_json("report", PYLINT_SCHEMA).isNotNull())
          .when(F.col("tool") == "bandit",
                _is_object_text(F.col("report")) & F.from_json("report", BANDIT_SCHEMA).isNotNull())
          .otherwise(F.lit(False)))
    return (reports.withColumn("_ok", F.coalesce(ok, F.lit(False)))
            .filter(~F.col("_ok"))
            .select("review_id", "file_path", "tool",
                    F.when(F.col("tool").isin("ruff", "pylint", "bandit"), F.lit("malformed report"))
                    .otherwise(F.lit("unknown tool")).alias("reason")))


def build_reports(raw: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Inverse of ingest: flat scanner rows -> one JSON report per (file, tool, part).

    Used to turn table rows into tool-shaped JSON.  ``raw`` needs
    ``review_id, file_path, tool, item_ord`` plus the tool fields.  Reports are
    cut into parts of at most ``part_size`` items so a file with a huge number of
    findings never becomes one giant row or one giant group.
    """
    g = raw.withColumn("part", ((F.col("item_ord") - 1) / F.lit(part_size)).cast("long"))
    ruff_item = F.struct(
        F.col("item_ord").alias("_o"),
        F.col("rule_code").alias("code"), F.col("message").alias("message"),
        F.struct(F.col("line_number").alias("row"), F.col("column").alias("column")).alias("location"),
        F.struct(F.col("end_line_number").alias("row"), F.col("column").alias("column")).alias("end_location"),
        F.struct(F.col("suggestion").alias("message")).alias("fix"))
    pylint_item = F.struct(
        F.col("item_ord").alias("_o"),
        F.col("rule_code").alias("message-id"), F.col("message").alias("message"),
        F.col("line_number").alias("line"), F.col("column").alias("column"),
        F.col("pylint_type").alias("type"), F.col("symbol").alias("symbol"))
    bandit_item = F.struct(
        F.col("item_ord").alias("_o"),
        F.col("rule_code").alias("test_id"), F.col("test_name").alias("test_name"),
        F.col("message").alias("issue_text"), F.col("line_number").alias("line_number"),
        F.col("tool_severity").alias("issue_severity"),
        F.col("tool_confidence").alias("issue_confidence"),
        F.col("line_range").alias("line_range"), F.col("code_snippet").alias("code"),
        F.struct(F.col("cwe_id").alias("id"),
                 F.lit("https://cwe.mitre.org/data/definitions/").alias("link")).alias("issue_cwe"))

    def _report(tool, item, wrap):
        items = F.array_sort(F.collect_list(item))
        items = F.transform(items, lambda s: s.dropFields("_o"))
        j = F.to_json(items)
        if wrap:
            j = F.to_json(F.struct(items.alias("results")))
        return (g.filter(F.col("tool") == tool)
                .groupBy("review_id", "file_path", "tool", "part")
                .agg(j.alias("report")))

    return (_report("ruff", ruff_item, False)
            .unionByName(_report("pylint", pylint_item, False))
            .unionByName(_report("bandit", bandit_item, True)))
