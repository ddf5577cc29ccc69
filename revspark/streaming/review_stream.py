"""ST1-ST3: Structured Streaming jobs.

ST1 continuous review: arriving files -> the same batch plan per micro-batch
    (``foreachBatch``) -> review store, one commit per batch id (a reader sees all of a
    batch or nothing; a batch that has been committed is not written again).
ST2 TTL de-duplication of prompts: a request passes when it is the first for its
    key or comes the TTL or more after the last that passed (one time a key is kept
    from batch to batch, and goes when the stream is a TTL past it).
ST3 rate-limit windows: requests per client per window, flagged over a limit; sessions of requests with
    a gap, and the requests that came too late for theirs.

Checkpoints and outputs go under the shared checkpoint folder of the session
(``spark.checkpoint.dir``), never a machine-local path.
"""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.session import shared_path, write_once


def _passing(key: str, ttl: int):
    """Rows come sorted by key and time, a key's last passed request of earlier batches first."""

    def run(batches):
        now, last = None, None  # the key at hand (None: none yet) and its last passed time
        columns = [key, "us", "order", "state"]

        def held(keys, times):
            return pd.DataFrame({key: keys, "us": times, "order": None, "state": True}).astype({"us": "int64", "order": "Int64"})

        for b in batches:
            names = b[key].astype(object).where(b[key].notna(), None).to_numpy()
            us, carried = b["us"].to_numpy(), b["state"].to_numpy(dtype=bool)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(b)]
            keep, keys, times = [], [], []  # of the whole batch: a table for every key would take longer than its rows
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if now is None or now[0] != names[begin]:
                    if last is not None:
                        keys.append(now[0])
                        times.append(last)
                    now, last = (names[begin],), None
                if carried[begin]:
                    last, begin = int(us[begin]), begin + 1
                while begin < end:
                    at = begin
                    if last is not None and us[at] < last + ttl:
                        at += int(us[begin:end].searchsorted(last + ttl))
                    if at < end:
                        keep.append(at)
                        last = int(us[at])
                    begin = at + 1
            if keep:
                yield b.iloc[keep][columns]
            if keys:
                yield held(keys, times)
        if last is not None:
            yield held([now[0]], [last])

    return run


def _last_state(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """The state that the last batch (before ``batch_id``) committed."""
    from revspark.sources.store import current_commits
    earlier = [c for c in current_commits(spark, path) if batch_id is None or c.commit_name < f"batch-{batch_id:012d}"]
    return spark.read.parquet(f"{path}/{earlier[-1].folder}/state") if earlier else None


def run_ttl_dedup(stream: DataFrame, name: str, key: str = "prompt_key", ts: str = "ts", ttl_seconds: int = 3600,
                  order: str = "submission_id", delay_seconds: int = 0) -> str:
    """ST2: run a stream of requests over everything available now; returns the folder of those that pass (``order, key, ts``).

    A micro-batch's requests of a key are taken by ``(ts, order)``; one passes when the key has no passed request or its
    own time is at least ``ttl_seconds`` after the last.  Requests that arrive in time order therefore pass or not
    however the stream is cut into batches; one that arrives after a later request of its key is a repeat of that.

    Memory is bounded however many requests a key has: a batch is reduced to one row per key and time (only
    the first can pass), sorted by Spark, which spills, and read past one number, the key's last passed time.  The size of a
    batch is bounded by the stream's ``maxBytesPerTrigger`` or ``maxFilesPerTrigger``.  The last passed times are a table
    a batch, written with the batch's rows in one commit (:func:`revspark.sources.store.commit`): a batch that is
    retried gives what it gave.  A time goes once the latest request seen, less ``delay_seconds``, is a TTL past it.
    Requests without a time do not pass.
    """
    from revspark.sources.store import commit, read_committed

    spark, ttl = stream.sparkSession, ttl_seconds * 1_000_000
    kind = stream.schema[key].dataType.simpleString()
    state_schema = f"`{key}` {kind}, us bigint, latest bigint"

    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        known = _last_state(spark, f"{out}/state", batch_id)
        state = spark.createDataFrame([], state_schema) if known is None else known
        rows = (batch.where(F.col(ts).isNotNull()).select(key, F.unix_micros(ts).alias("us"), F.col(order).cast("long").alias("order"))
                .groupBy(key, "us").agg(F.min("order").alias("order")))
        both = rows.withColumn("state", F.lit(False)).unionByName(
            state.where("us is not null").select(key, "us", F.lit(None).cast("long").alias("order"), F.lit(True).alias("state")))
        told = write_once(both.repartition(key).sortWithinPartitions(key, F.desc("state"), "us")
                          .mapInPandas(_passing(key, ttl), f"`{key}` {kind}, us bigint, `order` bigint, state boolean"), f"{name}-step")
        seen = [x for x in (rows.agg(F.max("us")).first()[0], state.agg(F.max("latest")).first()[0]) if x is not None]
        latest = max(seen, default=0)
        passed = told.where("not state").select(F.col("order").alias(order), key, F.timestamp_micros("us").alias(ts))
        alive = told.where(F.col("state") & (F.col("us") + ttl > latest - 1_000_000 * delay_seconds))
        mark = spark.createDataFrame([(None, None, latest)], state_schema)  # keeps the latest time when no key is left
        commit(spark, f"{out}/state", f"batch-{batch_id:012d}",
               {"state": alive.select(key, "us", F.lit(latest).cast("long").alias("latest")).unionByName(mark), "passed": passed})

    out = run_available_now(stream, name, sink=sink)
    result = f"{out}/passed"
    read_committed(spark, f"{out}/state", "passed").write.parquet(result)
    return result


def rate_counts(stream: DataFrame, window: str = "60 seconds", key: str = "client", ts: str = "ts",
                limit: int = 100, delay: str | None = None) -> DataFrame:
    """ST3: requests per (window, client) and whether the limit is exceeded."""
    s = stream.withWatermark(ts, delay or window)
    return (s.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n",
                    (F.col("n") > limit).alias("over_limit")))


def run_sessions(stream: DataFrame, name: str, key: str = "client", ts: str = "ts", gap_seconds: int = 1800,
                 delay_seconds: int = 0, folder: str | None = None) -> str:
    """ST3 sessions: runs of a key's requests, each at most ``gap_seconds`` after the one before.  Runs over everything available
    now and returns the output folder, for :func:`read_sessions` and :func:`read_late`; with the ``folder`` of an
    earlier run it goes on where that one ended.

    The watermark is the latest time of earlier batches less ``delay_seconds``.  A request before it is late: it goes to the late
    rows, whole, and into no session.  Every other one is in a session, however requests come cut into batches and in what
    order.  A session closes once no request that is not late can join it.

    A batch's requests and the open sessions are merged by Spark's ``session_window``: an open session is a row whose gap
    spans it.  Requests of one time are combined before the shuffle, the merge of a key reads its sorted windows one by one, so
    a hot key needs time in one task but no memory.  What is kept from batch to batch is the open sessions.  Closed sessions, open
    ones and late rows of a batch become visible in one commit, so that a retried batch gives what it gave.  Requests
    without a time are late rows; a null key is a key.
    """
    from revspark.sources.store import commit

    spark, gap, delay = stream.sparkSession, gap_seconds * 1_000_000, delay_seconds * 1_000_000
    kind = stream.schema[key].dataType.simpleString()
    state_schema = f"`{key}` {kind}, first_us bigint, last_us bigint, n bigint, latest bigint"

    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        state = _last_state(spark, out, batch_id)
        latest = None if state is None else state.agg(F.max("latest")).first()[0]
        us = F.unix_micros(F.col(ts))
        late = us.isNull() if latest is None else us.isNull() | (us < latest - delay)
        points = batch.where(~late).select(key, us.alias("first_us"), us.alias("last_us"), F.lit(1).cast("long").alias("n"))
        if state is not None:
            points = points.union(state.where("n > 0").select(key, "first_us", "last_us", "n"))
        span = F.concat((F.col("last_us") - F.col("first_us") + gap).cast("string"), F.lit(" microseconds"))
        merged = write_once(
            points.withColumn("at", F.timestamp_micros("first_us")).groupBy(key, F.session_window("at", span).alias("w"))
            .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")).drop("w"), f"{name}-step")
        seen = [x for x in (latest, merged.agg(F.max("last_us")).first()[0]) if x is not None]
        now = max(seen, default=None)
        shut = F.lit(False) if now is None else F.col("last_us") + gap < now - delay
        mark = spark.createDataFrame([(None, None, None, 0, now)], state_schema)  # keeps the latest time when no session is open
        commit(spark, out, f"batch-{batch_id:012d}", {
            "state": merged.where(~shut).select(key, "first_us", "last_us", "n", F.lit(now).cast("long").alias("latest")).unionByName(mark),
            "sessions": merged.where(shut), "late": batch.where(late)})

    return run_available_now(stream, name, sink=sink, folder=folder)


def read_sessions(spark: SparkSession, out: str, key: str = "client", gap_seconds: int = 1800) -> DataFrame:
    """key, session_start, session_end (its last request and the gap), n and closed, of all batches so far."""
    from revspark.sources.store import read_committed
    closed = read_committed(spark, out, "sessions").withColumn("closed", F.lit(True))
    rows = closed.unionByName(_last_state(spark, out).where("n > 0").drop("latest").withColumn("closed", F.lit(False)))
    return rows.select(key, F.timestamp_micros("first_us").alias("session_start"),
                       F.timestamp_micros(F.col("last_us") + gap_seconds * 1_000_000).alias("session_end"), "n", "closed")


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """The requests that came too late, as they came."""
    from revspark.sources.store import read_committed
    return read_committed(spark, out, "late")


def run_available_now(df: DataFrame, name: str, sink: Callable | None = None, output_mode: str = "append",
                      fmt: str = "parquet", folder: str | None = None) -> str:
    """Run a streaming DataFrame over everything available now.

    Without ``sink`` the rows are appended to a parquet folder; with ``sink`` it
    is called per micro-batch (``foreachBatch``) with ``(batch_df, batch_id,
    out_path)``.  Returns the output folder.  With the ``folder`` of an earlier run the
    stream goes on from its checkpoint.
    """
    spark = df.sparkSession
    out = folder or shared_path(spark, f"{name}-out")
    ckpt = f"{out}-ckpt"
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if sink is None:
        q = w.format(fmt).option("path", out).start()
    else:
        q = w.foreachBatch(lambda b, i: sink(b, i, out)).start()
    q.awaitTermination()
    return out


def review_batch_sink(make_inputs: Callable, reviewers=None):
    """ST1 sink: review every file of the micro-batch and commit reviews, findings, rejects and errors together, to be read with
    ``committed_reviews`` and ``committed_rows``.  A reviewer that failed is an error row of each file; a review is
    ``failed`` only where every reviewer failed, as in :func:`review_files`."""
    from revspark.plans.review import FILE_KEY, review_files
    from revspark.sources.store import commit

    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        inputs = make_inputs(batch)
        r = review_files(inputs, reviewers)
        stamp = {"write_id": F.lit(batch_id).cast("long"), "ts": F.lit(datetime.now(timezone.utc)).cast("timestamp")}
        errors = r.file_errors
        for agent, reason in r.failures:
            errors = errors.unionByName(inputs.files.select(*FILE_KEY, F.lit(agent).alias("agent_name"), F.lit(reason).alias("reason")))
        tables = {"reviews": r.file_reviews, "findings": r.findings, "rejects": r.rejects, "errors": errors}
        commit(batch.sparkSession, out, f"batch-{batch_id:012d}", {k: v.withColumns(stamp) for k, v in tables.items()})
    return sink


def read_stream_table(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                      max_bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A file-source stream over parquet files (a folder or a glob), in micro-batches of bounded size."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.parquet(path)
