"""Review store — append-only parquet, latest write wins on read.

Writes append one row per (review_id, file, write) partitioned by write date; a
read keeps, per ``review_id`` and file, the row with the greatest ``(ts,
write_id)``.  The findings of a write go to a table beside it and are read for
the latest writes only.  The lookup by id is a plain filter, pushed down to the
parquet scan.

A store that several tables belong to (reviews, findings, rejects, errors) is
written by ``commit``: readers see all tables of a commit or none, and
``compact`` joins commits without a reader noticing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reviews(df: DataFrame, path: str, write_id: int | None = None) -> None:
    """Append ``df`` (needs ``review_id`` and ``ts``) under ``path``.

    Rows are sorted by ``review_id`` inside each written file (a local sort, no
    shuffle), so parquet row-group statistics let a lookup by id skip almost
    every row group of every date partition.
    """
    out = df.withColumn("write_id", F.lit(write_id if write_id is not None else 0).cast("long")) \
        .withColumn("ts_date", F.to_date("ts"))
    out.sortWithinPartitions("ts_date", "review_id").write.mode("append").partitionBy("ts_date").parquet(path)


def findings_path(path: str) -> str:
    return path.rstrip("/") + "-findings"


def store_review(reviews: DataFrame, findings: DataFrame, path: str, write_id: int | None = None) -> None:
    """Write the rows of one review run: the findings first, so that no stored review lacks them.

    ``reviews`` needs ``review_id, file_path, ts``; a finding takes the ``ts`` of its file's row.
    """
    ts = reviews.select("review_id", "file_path", "ts")
    write_reviews(findings.join(ts, ["review_id", "file_path"]), findings_path(path), write_id)
    write_reviews(reviews, path, write_id)


def review_keys(df: DataFrame) -> list[str]:
    """What identifies a stored row: the review, and the file where rows are by file."""
    return [c for c in ("review_id", "file_path") if c in df.columns]


def latest_reviews(df: DataFrame) -> DataFrame:
    """Latest row per review and file.

    ``max_by`` over a struct aggregates map-side first (partial aggregation),
    so a review written a very large number of times still ships one row per
    map task rather than every version.
    """
    keys = review_keys(df)
    other = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in other]), F.struct("ts", "write_id"))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return latest_reviews(spark.read.parquet(path))


def get_review(spark: SparkSession, path: str, review_id) -> DataFrame:
    """Lookup by id: a row for each file of the review (the filter reaches the scan)."""
    return latest_reviews(spark.read.parquet(path).filter(F.col("review_id") == F.lit(review_id)))


def read_findings(spark: SparkSession, path: str, review_id=None) -> DataFrame:
    """The findings stored with the latest write of every review (or of one) and file."""
    reviews, findings = spark.read.parquet(path), spark.read.parquet(findings_path(path))
    if review_id is not None:
        reviews, findings = (d.filter(F.col("review_id") == F.lit(review_id)) for d in (reviews, findings))
    last = latest_reviews(reviews).select("review_id", "file_path", "ts", "write_id")
    return findings.join(last, ["review_id", "file_path", "ts", "write_id"]).drop("ts_date")


# ---------------------------------------------------------------------------
# Commits: several tables that become visible together
# ---------------------------------------------------------------------------

MANIFEST = "commit_name string, folder string, tables array<string>, replaces array<string>"


def _manifest(spark: SparkSession, path: str) -> list:
    """The commits of a store: one small row each, none if there is no store yet."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def commit(spark: SparkSession, path: str, name: str, tables: dict[str, DataFrame], replaces: list[str] | None = None) -> bool:
    """Write ``tables`` under the store ``path`` so that readers see all of them or none.

    The tables go to a folder that nothing refers to; the manifest row that names it is one file, written last.  A
    writer that dies before leaves the store as it was, and a retry of ``name`` writes a folder of its own.  A ``name``
    that has been committed is not written again (False).  ``replaces`` names commits that this one stands for.
    """
    if any(name == row.commit_name for row in _manifest(spark, path)):
        return False
    folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{table}")
    row = spark.createDataFrame([(name, folder, list(tables), replaces or [])], MANIFEST)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{name}")
    return True


def current_commits(spark: SparkSession, path: str) -> list:
    """The commits that readers see: all but those that a later one replaces."""
    rows = _manifest(spark, path)
    gone = {name for row in rows for name in row.replaces}
    return sorted((row for row in rows if row.commit_name not in gone), key=lambda row: row.commit_name)


def read_committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of a table of the store, in one snapshot of its commits."""
    return _read(spark, path, current_commits(spark, path), table)


def _read(spark: SparkSession, path: str, commits: list, table: str) -> DataFrame:
    folders = [f"{path}/{row.folder}/{table}" for row in commits if table in row.tables]
    if not folders:
        raise LookupError(f"no commit of {path} has a table {table}")
    return spark.read.parquet(*folders)


def _of_latest(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    key = ["review_id", "file_path", "ts", "write_id"]
    return rows.join(latest_reviews(reviews).select(*key), key, "left_semi")


def committed_reviews(spark: SparkSession, path: str, review_id=None) -> DataFrame:
    """The latest row of every review (or of one) and file."""
    rows = read_committed(spark, path, "reviews")
    return latest_reviews(rows if review_id is None else rows.filter(F.col("review_id") == F.lit(review_id)))


def committed_rows(spark: SparkSession, path: str, table: str, review_id=None) -> DataFrame:
    """Findings, rejects or errors that belong to the latest write of their review and file; one snapshot for both."""
    commits = current_commits(spark, path)
    rows, reviews = _read(spark, path, commits, table), _read(spark, path, commits, "reviews")
    if review_id is not None:
        rows, reviews = (d.filter(F.col("review_id") == F.lit(review_id)) for d in (rows, reviews))
    return _of_latest(rows, reviews)


def compact(spark: SparkSession, path: str) -> bool:
    """Replace all commits that readers see by one that holds only the latest writes; what readers get stays the same.

    The old folders stay, for readers that have begun.  False if there is nothing to join.
    """
    commits = current_commits(spark, path)
    if len(commits) < 2:
        return False
    reviews = _read(spark, path, commits, "reviews")
    tables = {"reviews": latest_reviews(reviews)}
    for table in sorted({t for row in commits for t in row.tables} - {"reviews"}):
        tables[table] = _of_latest(_read(spark, path, commits, table), reviews)
    return commit(spark, path, f"compact-{uuid.uuid4().hex[:12]}", tables, [row.commit_name for row in commits])
