"""Confidence as given, one run of user code, isolation and status, the committed store, bounded TTL, as-of lookup."""
import datetime as dt
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from revspark.operators.dedup import dedup_findings
from revspark.operators.normalize import to_findings, validate_findings
from revspark.operators.reviewers import FileReviewer, Reviewer, ReviewerSet, ReviewInputs
from revspark.plans.review import review_files
from revspark.session import local_fs_path, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

FILES = "review_id long, file_path string, code string"


def only(*reviewers):
    return ReviewerSet(list(reviewers))


def found(message, confidence=0.5):
    return dict(line_number=1, severity="low", category="style", message=message, confidence=confidence)


def test_confidence_is_validated_as_given(spark):
    rows = [(1, "a.py", 0, k, 1, "low", "style", m, "A", c) for k, (m, c) in enumerate(
        [("high", "1.004"), ("low", "-0.004"), ("same", "0.951"), ("same", "0.954"), ("one", "1"), ("text", "much"), ("nan", "NaN"), ("big", "1e9")])]
    raw = spark.createDataFrame(rows, "review_id long, file_path string, agent_ord int, item_ord long, line_number int, severity string, "
                                      "category string, message string, agent_name string, confidence string")
    valid, rejects = validate_findings(to_findings(raw))
    assert sorted(r.message for r in rejects.collect()) == ["big", "high", "low", "nan", "text"]
    kept = {r.message: r.confidence for r in dedup_findings(valid).collect()}
    assert kept == {"same": 0.954, "one": 1.0}


def calls(folder):
    return sum(len(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


def test_a_file_reviewer_runs_once_a_file(spark, tmp_path):
    folder = str(tmp_path)

    def review(path, code):
        with open(os.path.join(folder, str(os.getpid())), "a") as f:
            f.write("x")
        if path == "f3.py":
            raise ValueError("cannot read")
        return [found("seen")]

    files = spark.createDataFrame([(k, f"f{k}.py", "x = 1\n") for k in range(20)], FILES).repartition(4)
    out = review_files(ReviewInputs(files=files), only(FileReviewer("Own", "", review)))
    assert out.findings.count() == 19 and out.file_errors.count() == 1 and out.rejects.count() == 0
    assert {r.review_id: r.status for r in out.reviews.collect()} == {k: "failed" if k == 3 else "completed" for k in range(20)}
    assert calls(folder) == 20


def pr_tables(spark):
    requests = spark.createDataFrame([(1, "o", "r", 11), (2, "o", "r", 12), (3, "o", "r", 13)],
                                     "pr_key long, repo_owner string, repo_name string, pr_number int")
    prs = spark.createDataFrame([(1, 11, "one", "h1", "o/r", True), (2, 12, "two", "h2", "o/r", True)],
                                "pr_key long, number int, title string, head_sha string, repo string, post_review boolean")
    files = spark.createDataFrame([(1, 0, "a.py", "added"), (1, 1, "b.py", "added"), (2, 0, "a.py", "added"), (2, 1, "bad.py", "added")],
                                  "pr_key long, file_ord long, filename string, status string")
    contents = spark.createDataFrame([("o/r", f, ref, "x = 1\n") for f in ("a.py", "b.py", "bad.py") for ref in ("h1", "h2")],
                                     "repo string, path string, ref string, code string")
    return requests, prs, files, contents


def odd(path, code):
    if path == "bad.py":
        raise ValueError("cannot read")
    return [found("fine"), found("too sure", 1.004)]


def test_pr_review_validates_and_reports_errors(spark):
    from revspark.plans.pr import review_prs
    out = review_prs(*pr_tables(spark), reviewers=only(FileReviewer("Own", "", odd)))
    assert sorted((r.pr_key, r.file_ord, r.message) for r in out.findings.collect()) == [(1, 0, "fine"), (1, 1, "fine"), (2, 0, "fine")]
    assert sorted((r.pr_key, r.file_ord, r.reason) for r in out.rejects.collect()) == [
        (p, f, "confidence outside 0..1") for p, f in ((1, 0), (1, 1), (2, 0))]
    assert [(r.pr_key, r.file_ord, r.agent_name, r.reason) for r in out.file_errors.collect()] == [(2, 1, "Own", "ValueError: cannot read")]
    rollup = {r.pr_key: (r.status, r.files_analyzed, r.n_findings, r.overall_score) for r in out.rollup.collect()}
    assert rollup == {1: ("completed", 2, 2, 99.0), 2: ("failed", 0, 0, 100.0), 3: ("failed", 0, 0, 100.0)}
    assert {r.pr_key: r.summary for r in out.rollup.collect()}[2] == "Error reviewing PR: ValueError: cannot read"


def test_one_failed_reviewer_leaves_a_pr_completed(spark):
    from revspark.plans.pr import review_prs
    out = review_prs(*pr_tables(spark), reviewers=only(FileReviewer("Own", "", odd), FileReviewer("Other", "", lambda p, c: [])))
    assert {r.pr_key: r.status for r in out.rollup.collect()} == {1: "completed", 2: "completed", 3: "failed"}
    assert out.file_errors.count() == 1


# ---- the committed store

def reviews(spark, rows, write_id):
    return (spark.createDataFrame(rows, "review_id long, file_path string, status string")
            .withColumns({"write_id": F.lit(write_id).cast("long"), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp")}))


def snapshot(spark, path):
    from revspark.sources.store import committed_reviews, committed_rows
    return (sorted((r.review_id, r.status, r.write_id) for r in committed_reviews(spark, path).collect()),
            sorted((r.review_id, r.status, r.write_id) for r in committed_rows(spark, path, "findings").collect()))


def test_commits_are_seen_whole_or_not_at_all(spark):
    from revspark.sources.store import commit, compact, current_commits, read_committed
    path = shared_path(spark, "committed")
    with pytest.raises(LookupError):
        read_committed(spark, path, "reviews")
    first = {"reviews": reviews(spark, [(1, "a", "x"), (2, "b", "x")], 0), "findings": reviews(spark, [(1, "a", "f1"), (2, "b", "f2")], 0)}
    assert commit(spark, path, "batch-0", first)
    before = snapshot(spark, path)

    # a batch that dies between its tables: its second table cannot be written
    broken = reviews(spark, [(1, "a", "new")], 1)
    with pytest.raises(Exception):
        commit(spark, path, "batch-1", {"reviews": broken, "findings": broken.withColumn("status", F.raise_error(F.lit("lost")).cast("string"))})
    assert snapshot(spark, path) == before

    # its retry is seen, a second retry and one of an earlier batch change nothing
    second = {"reviews": broken, "findings": reviews(spark, [], 1)}
    assert commit(spark, path, "batch-1", second)
    after = snapshot(spark, path)
    assert after == ([(1, "new", 1), (2, "x", 0)], [(2, "f2", 0)])
    assert not commit(spark, path, "batch-1", second) and not commit(spark, path, "batch-0", first)

    # compaction: one commit, the same rows; what it replaced still counts as committed
    assert compact(spark, path) and snapshot(spark, path) == after
    assert len(current_commits(spark, path)) == 1 and not compact(spark, path)
    assert not commit(spark, path, "batch-0", first) and commit(spark, path, "batch-2", {"reviews": reviews(spark, [(3, "c", "y")], 2)})
    assert compact(spark, path) and snapshot(spark, path) == (after[0] + [(3, "y", 2)], after[1])


def test_a_manifest_being_written_is_not_read(spark):
    from revspark.sources.store import commit, current_commits
    path = shared_path(spark, "committed")
    commit(spark, path, "batch-0", {"reviews": reviews(spark, [(1, "a", "x")], 0)})
    os.makedirs(f"{local_fs_path(path)}/manifest/batch-1/_temporary/0")
    assert [c.commit_name for c in current_commits(spark, path)] == ["batch-0"]
    assert commit(spark, path, "batch-1", {"reviews": reviews(spark, [(2, "b", "x")], 1)})


def test_stream_commits_rejects_and_errors(spark):
    from revspark.sources.store import committed_reviews, committed_rows
    from revspark.streaming.review_stream import review_batch_sink

    def broken(inputs, agent_ord):
        raise ValueError("no plan")

    files = spark.createDataFrame([(1, "a.py", "x = 1\n"), (2, "bad.py", "x = 1\n")], FILES)
    sink = review_batch_sink(lambda b: ReviewInputs(files=b), only(Reviewer("Broken", "", broken), FileReviewer("Own", "", odd)))
    out = shared_path(spark, "sink")
    sink(files, 0, out)
    sink(files, 0, out)
    assert {r.review_id: r.status for r in committed_reviews(spark, out).collect()} == {1: "completed", 2: "failed"}
    assert [r.message for r in committed_rows(spark, out, "rejects").collect()] == ["too sure"]
    assert sorted((r.review_id, r.agent_name) for r in committed_rows(spark, out, "errors").collect()) == [(1, "Broken"), (2, "Broken"), (2, "Own")]


# ---- ST2 against plain Python

def greedy(rows, ttl):
    out, last = [], {}
    for n, ts, key in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in last or ts - last[key] >= ttl:
            out.append(n)
            last[key] = ts
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 5])
def test_ttl_with_a_hot_key(spark, cuts):
    """A key with half of all requests, a null key, equal times, several batches."""
    from revspark.streaming.review_stream import read_stream_table, run_ttl_dedup
    rng = random.Random(cuts)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted(((t0 + dt.timedelta(seconds=rng.randrange(200_000), microseconds=rng.randrange(3)), rng.choice(["hot", "hot", "a", "b", None, "c"]))
                   for _ in range(3000)), key=lambda r: r[0])
    rows = [(k, ts, key) for k, (ts, key) in enumerate(rows)]
    src = shared_path(spark, "ttl-src")
    size = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * size:(k + 1) * size], "submission_id long, ts timestamp, prompt_key string").coalesce(1).write.parquet(f"{src}/b{k}")
    stream = read_stream_table(spark, f"{src}/b*/*.parquet", "submission_id long, ts timestamp, prompt_key string", max_files_per_trigger=1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # a key spans many Arrow batches
    try:
        got = spark.read.parquet(run_ttl_dedup(stream, "ttl"))
        assert sorted(r.submission_id for r in got.collect()) == greedy(rows, dt.timedelta(hours=1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# ---- J6 at each prompt's own time

def test_asof_lookup_over_range_borders(spark):
    from revspark.operators.enrich import asof_lookup
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    when = lambda: t0 + dt.timedelta(seconds=rng.randrange(5000))
    keys = ["hot", "hot", "hot", "a", "b", None]
    prompts = [(k, rng.choice(keys), rng.choice([when(), when(), None])) for k in range(400)]
    answers = [(rng.choice(keys), when(), rng.choice(["", None, f"r{k % 7}"])) for k in range(150)]
    want = {}
    for n, key, ts in prompts:
        old = [(t, r) for k, t, r in answers if k == key and key and r and ts and t <= ts]
        best = max(old, default=None)
        want[n] = best[::-1] if best and best[0] > ts - dt.timedelta(seconds=300) else (None, None)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges: the hot key spans several
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = asof_lookup(spark.createDataFrame(prompts, "n long, prompt_key string, ts timestamp"),
                          spark.createDataFrame(answers, "prompt_key string, ts timestamp, response string"), 300).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.n: (r.response, r.cached_ts) for r in out} == want and len(out) == 400
    assert sum(v[0] is not None for v in want.values()) > 50
