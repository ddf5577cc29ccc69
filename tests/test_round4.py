"""Work that is heavy by row runs on many tasks, once, and in bounded pieces."""


import pandas as pd
from pyspark.sql import functions as F

from revspark.operators.structure import elements_of, extract_elements

CODE = "class A:\n    def m(self):\n        if self:\n            return 1\n"


def test_part_files_are_parsed_by_many_tasks(spark, tmp_path):
    """a narrow file of one row group was parsed by one task."""
    from revspark.plans.fixtures import v7_files
    n = 45_000
    pd.DataFrame({"p_partkey": range(n), "p_size": 1}).to_parquet(tmp_path / "part.parquet")
    files = v7_files(spark, str(tmp_path))
    assert files.select(F.spark_partition_id()).distinct().count() > 1
    assert files.count() == n


def test_only_wanted_kinds_leave_the_worker(spark):
    files = spark.createDataFrame([(1, "a.py", CODE), (2, "b.py", "x ="), (3, "c.py", None)],
                                  "review_id long, file_path string, code string")
    everything = [(r.review_id, r.walk_ord, r.kind) for r in extract_elements(files).collect()]
    wanted = [(r.review_id, r.walk_ord, r.kind) for r in extract_elements(files, kinds=("class", "method")).collect()]
    assert sorted(wanted) == sorted(x for x in everything if x[2] in ("class", "method")) and len(wanted) == 2


def test_elements_keep_their_places():
    told = [(r[0], r[1], r[2]) for r in elements_of(CODE)]
    assert told == [(1, "class", "A"), (1, "method", "m"), (4, "conditional", None), (2, "function", "m"), (-1, "file", None)]


def test_classes_and_methods_are_parsed_once(spark, tmp_path):
    """both sides of the join parsed the files."""
    from __spark_entry__ import queries
    pd.DataFrame({"p_partkey": [5, 10, 50], "p_size": [1, 2, 3]}).to_parquet(tmp_path / "part.parquet")
    df = queries()["classes_methods"](spark, str(tmp_path))
    assert "MapIn" not in df._jdf.queryExecution().toString()
    assert sorted((r.review_id, r.method) for r in df.collect()) == [(5, "am"), (5, "m"), (10, "am"), (10, "m")]


def test_pr_files_are_shuffled_once_by_pr(spark, tmp_path):
    """the window, the lists and their offsets each shuffled and sorted the rows anew."""
    from revspark.plans.queries_pr import q_ingest_comments
    n = 600
    pd.DataFrame({"o_orderkey": range(n), "o_orderpriority": "x", "o_custkey": 1}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [k % n for k in range(4 * n)], "l_partkey": range(4 * n), "l_suppkey": 1,
                  "l_linenumber": [k // n for k in range(4 * n)], "l_quantity": 2.0, "l_linestatus": "F",
                  "l_returnflag": "A"}).to_parquet(tmp_path / "lineitem.parquet")
    df = q_ingest_comments(spark, str(tmp_path))
    assert df.where("pr_key = 7").orderBy("comment_ord").select("path").collect()[3].path == f"src/f_{7 + 3 * n}.py"
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 4 * n * 4 // 5 and "Window" in plan
    assert executed.count("Exchange hashpartitioning(pr_key") <= 2  # at most one a table


def test_by_key_bounds_a_task(spark):
    from revspark.plans.fixtures import by_key
    df = spark.range(10)
    assert by_key(df, 10, "id") is df
    assert by_key(df, 1000, "id", per_task=100).rdd.getNumPartitions() == 10


def test_ttl_of_many_keys_builds_few_tables():
    """a table was built for every key."""
    from revspark.streaming.review_stream import _passing
    n = 3000
    b = pd.DataFrame({"k": [f"{i // 3:05d}" for i in range(n)], "us": range(n), "order": range(n), "state": False})
    out = list(_passing("k", 2)(iter([b])))
    assert len(out) <= 3
    rows = pd.concat(out)
    assert (~rows["state"]).sum() == 2000 and rows["state"].sum() == 1000


def test_store_commits_computes_the_findings_once(spark, tmp_path, monkeypatch):
    """every table of both commits de-duplicated the findings anew."""
    from revspark.plans import queries_misc as m
    written = []
    real = m.write_once
    monkeypatch.setattr(m, "write_once", lambda df, name: written.append(name) or real(df, name))
    pd.DataFrame({"l_orderkey": [4, 4, 5], "l_partkey": [1, 2, 3], "l_suppkey": 1, "l_linenumber": [1, 2, 3],
                  "l_quantity": 2.0}).to_parquet(tmp_path / "lineitem.parquet")
    rows = {(r.review_id, r.write_id, r.n_findings) for r in m.q_store_commits(spark, str(tmp_path)).collect()}
    assert written == ["kept", "scores"] and rows == {(4, 1, 1), (4, 1, 0), (5, 0, 1)}


def test_file_reviewers_get_small_batches(spark):
    """with the session's default a worker and its child each held 10,000 texts."""
    from revspark.operators.reviewers import FileReviewer, _file_items
    from revspark.session import BATCH_ROWS
    before, seen = spark.conf.get(BATCH_ROWS), []
    from revspark import session
    real = session.write_once
    spark.conf.set(BATCH_ROWS, "10000")
    try:
        session.write_once = lambda df, name: seen.append(spark.conf.get(BATCH_ROWS)) or real(df, name)
        files = spark.createDataFrame([(1, "a", "x")], "review_id long, file_path string, code string")
        _file_items(files, FileReviewer("R", "", lambda p, c: []))
        assert seen == ["500"] and spark.conf.get(BATCH_ROWS) == "10000"
    finally:
        session.write_once = real
        spark.conf.set(BATCH_ROWS, before)


def test_contents_are_sorted_after_the_shuffle_only(spark):
    """The texts were sorted before they were shuffled, too."""
    from revspark.plans.pr import attach_contents
    files = spark.createDataFrame([(1, 1, "a.py", "added")], "pr_key long, file_ord long, filename string, status string")
    prs = spark.createDataFrame([(1, "o/r", "s")], "pr_key long, repo string, head_sha string")
    texts = spark.createDataFrame([("o/r", "a.py", "s", "x"), ("o/r", "a.py", "s", "y"), ("o/r", "a.py", "s", "")],
                                  "repo string, path string, ref string, code string")
    df = attach_contents(files, prs, texts)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_max") < plan.index("REPARTITION_BY_NUM")
    assert [(r.pr_key, r.code) for r in df.collect()] == [(1, "y")]
