"""ST3 sessions: state over batches, late rows, a key with most of the requests."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from revspark.session import shared_path
from revspark.streaming.review_stream import read_late, read_sessions, read_stream_table, run_sessions

SCHEMA = "id long, client string, ts timestamp"
START = datetime(2024, 1, 1)


def islands(rows, gap):
    out = {}
    for _, c, t in sorted(rows, key=lambda r: (str(r[1]), r[2])):
        runs = out.setdefault(c, [])
        if runs and t - runs[-1][1] <= gap:
            runs[-1][1:] = [t, runs[-1][2] + 1]
        else:
            runs.append([t, t, 1])
    return sorted((str(c), a, b + gap, n) for c, runs in out.items() for a, b, n in runs)


def test_sessions_over_batches(spark):
    rng = random.Random(2)
    src, out, latest, kept, late, gap, delay = shared_path(spark, "src"), None, None, [], [], timedelta(minutes=10), timedelta(hours=1)
    for step in range(3):
        rows = [(step * 1000 + k, rng.choice(["hot"] * 4 + ["a", "b", None]), START + timedelta(minutes=rng.randrange(0, 240 + 240 * step)))
                for k in range(150)]
        rows.append((step * 1000 + 900, "a", None))
        rows.append((step * 1000 + 901, "edge", START + timedelta(minutes=10 * step)))  # exactly one gap apart
        for r in rows:
            (late if r[2] is None or latest is not None and r[2] < latest - delay else kept).append(r)
        latest = max(r[2] for r in kept)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        folder = run_sessions(read_stream_table(spark, src, SCHEMA), "t-sessions", gap_seconds=600, delay_seconds=3600, folder=out)
        assert out in (None, folder)
        out = folder
        got = read_sessions(spark, out, gap_seconds=600)
        have = sorted((str(r.client), r.session_start, r.session_end, r.n) for r in got.collect())
        assert have == islands(kept, gap)
        assert sorted(r.id for r in read_late(spark, out).collect()) == sorted(r[0] for r in late)
        assert got.where("closed").count() == sum(e < latest - delay for _, _, e, _ in have)
    assert len(late) > 100 and got.where("closed").count() > 20
    assert got.agg(F.sum("n")).first()[0] + len(late) == 456


def test_sessions_of_nothing(spark):
    src = shared_path(spark, "src")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, "a", None)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    out = run_sessions(read_stream_table(spark, src, SCHEMA), "t-sessions")
    assert read_sessions(spark, out).count() == 0 and [r.id for r in read_late(spark, out).collect()] == [1]
