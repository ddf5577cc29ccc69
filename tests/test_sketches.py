"""Sketches by day: merged days against exact figures, in any grouping."""

import random

from pyspark.sql import functions as F

from revspark.operators import sketches as K
from revspark.session import shared_path


def test_merged_days_against_exact_figures(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xxxy"), k % 10, f"rule{int(rng.paretovariate(0.3)) % 6000}", rng.gauss(50, 20) if k % 9 else None) for k in range(30_000)]
    rows += [("empty", 3, None, None)] * 5
    df = spark.createDataFrame(rows, "repo string, day int, rule string, score double")
    path = shared_path(spark, "sketches")
    for half in (0, 1):
        days = df.where((F.col("day") >= 5) == bool(half))
        for _ in range(2):  # the second is a retry
            K.store_sketches(spark, path, f"half-{half}", K.day_sketches(days, ["repo"], {"rules": "rule"}, {"score": "score"}))
    for days in (None, (2, 6)):
        told = K.read_sketches(spark, path, days)
        for keys in (["repo"], []):
            for got in K.estimates(K.merge_sketches(told, keys)).collect():
                own = [r for r in rows if (not keys or r[0] == got["repo"]) and (days is None or days[0] <= r[1] <= days[1])]
                distinct, scores = len({r[2] for r in own} - {None}), sorted(r[3] for r in own if r[3] is not None)
                assert got["n"] == len(own)
                assert abs(got["n_rules"] - distinct) <= 4 * K.DISTINCT_ERROR * distinct
                for q in (50, 90, 99):
                    if not scores:
                        assert got[f"score_p{q}"] is None
                        continue
                    rank = sum(x <= got[f"score_p{q}"] for x in scores) / len(scores)
                    assert abs(rank - q / 100) <= 2 * K.RANK_ERROR


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "repo string, day int, rule string, score double")
    s = K.day_sketches(none, ["repo"], {"rules": "rule"}, {"score": "score"})
    assert s.count() == 0 and K.estimates(K.merge_sketches(s, ["repo"])).count() == 0
