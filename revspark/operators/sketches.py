"""Mergeable sketches of findings: distinct counts and quantiles of any period from small rows kept by day.

A day's rows are read once, when the day is stored; a period of days is then answered from one sketch row a group and day,
merged by Spark, whatever the number of findings. Distinct counts are HyperLogLog (relative standard error 1.04 /
sqrt(2 ** LG_K), 0.8 %), quantiles are KLL (a value's rank is off by at most RANK_ERROR of the rows, with 99 % confidence).
Merging is associative, and a sketch of merged days is as good as one of all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.sources.store import commit, read_committed

LG_K = 14
KLL_K = 200
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.0165


def day_sketches(rows: DataFrame, keys, distinct: dict[str, str], values: dict[str, str], day: str = "day") -> DataFrame:
    """Per key and day: n, a sketch ``<name>_hll`` of the distinct values of each column in ``distinct`` (nulls are none) and a
    sketch ``<name>_kll`` of each numeric column in ``values``, null where no row has a value."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"{name}_hll") for name, c in distinct.items()]
    for name, c in values.items():
        v = F.col(c).cast("double")
        aggs.append(F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, KLL_K)).alias(f"{name}_kll"))
    return rows.groupBy(*keys, day).agg(*aggs)


def store_sketches(spark: SparkSession, path: str, name: str, sketches: DataFrame) -> bool:
    """Add days to the store under ``path`` in one commit; one that has been committed is not written again."""
    return commit(spark, path, name, {"sketches": sketches})


def read_sketches(spark: SparkSession, path: str, days: tuple | None = None, day: str = "day") -> DataFrame:
    rows = read_committed(spark, path, "sketches")
    return rows if days is None else rows.where(F.col(day).between(*days))


def merge_sketches(sketches: DataFrame, keys) -> DataFrame:
    """Per key (a subset of the stored ones; none: one row): n and the sketches of all rows behind it."""
    aggs = [F.sum("n").alias("n")]
    aggs += [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.endswith("_hll")]
    aggs += [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.endswith("_kll")]
    return sketches.groupBy(*keys).agg(*aggs)


def estimates(merged: DataFrame, quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """The sketches replaced by ``n_<name>`` (distinct values) and ``<name>_p<percent>`` (null without values)."""
    out = [c for c in merged.columns if not c.endswith(("_hll", "_kll"))]
    for c in merged.columns:
        if c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"n_{c[:-4]}"))
        elif c.endswith("_kll"):
            has = F.col(c).isNotNull() & (F.kll_sketch_get_n_double(c) > 0)
            out += [F.when(has, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))).alias(f"{c[:-4]}_p{q * 100:g}".replace(".", "_"))
                    for q in quantiles]
    return merged.select(*out)
