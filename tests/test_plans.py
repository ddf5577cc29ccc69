"""Plan-shape tests: the scale properties the design relies on."""
import contextlib
import io

from pyspark.sql import functions as F


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def findings(spark):
    rows = [(r % 5, f"f{r % 3}.py", 0, 0, r, 1 + r % 4, ["critical", "high", "low"][r % 3], r % 3,
             "m" + str(r % 2), "0.50") for r in range(200)]
    return spark.createDataFrame(rows, "review_id long, file_path string, agent_ord int, source_ord int, "
                                       "item_ord long, line_number int, severity string, severity_rank int, "
                                       "message string, confidence string") \
        .withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


def test_dedup_is_partially_aggregated_before_the_shuffle(spark):
    from revspark.operators.dedup import dedup_findings
    p = plan_text(dedup_findings(findings(spark)))
    tree = p.split("\n\n")[0]
    # partial aggregate below the exchange, final aggregate above it
    assert "partial_min" in p and tree.count("Aggregate") >= 2 and "Exchange" in tree
    assert tree.index("Exchange") < tree.rindex("Aggregate")


def test_top_n_uses_window_group_limit(spark):
    from revspark.operators.dedup import dedup_findings, top_findings
    p = plan_text(top_findings(dedup_findings(findings(spark)), 3))
    assert p.count("WindowGroupLimit") >= 2   # partial (before the exchange) and final


def test_no_cross_join_or_nested_loop_in_agent_summaries(spark):
    from revspark.operators import aggregates as A
    f = findings(spark).withColumn("agent_name", F.lit("QualityAgent"))
    p = plan_text(A.agent_summaries(f, f.select("review_id")))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_store_lookup_filter_reaches_the_scan(spark):
    from revspark.session import shared_path
    from revspark.sources.store import get_review, write_reviews
    path = shared_path(spark, "test-store-plan")
    write_reviews(spark.range(50).select(F.col("id").alias("review_id"), F.lit(90.0).alias("overall_score"),
                                         F.current_timestamp().alias("ts")), path)
    p = plan_text(get_review(spark, path, 7))
    assert "EqualTo(review_id,7)" in p


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries
    p = plan_text(queries()["review_score"](spark, "/root/testdata/sf0.001"))
    schema = [line for line in p.splitlines() if line.startswith("ReadSchema")][0]
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema
