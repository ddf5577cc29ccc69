"""Keep-best de-duplication, severity ranking, top-n per review.

Every list position of the original is replaced by explicit order columns
(``agent_ord, source_ord, item_ord`` by default), so results do not depend on
row order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revspark.schemas import ORDER_COLUMNS

DEDUP_KEY = ["review_id", "file_path", "line_number"]
MESSAGE_PREFIX = 100


def dedup_findings(df: DataFrame, order_cols=ORDER_COLUMNS, keys=DEDUP_KEY,
                   prefix: int = MESSAGE_PREFIX) -> DataFrame:
    """One finding per (keys, first ``prefix`` characters of message).

    The kept row is the one with the highest confidence, the earliest (by the
    order columns) among equals; it takes the position ``pos`` of the first
    occurrence of its key.

    Planned as an aggregation, not a window: ``min(struct(-confidence, order…,
    row…))`` is computed map-side first (partial aggregation), so a key shared
    by a huge number of duplicate rows sends one candidate per map task to the
    shuffle instead of every duplicate, and no single task has to hold the key.
    """
    order_cols = list(order_cols)
    payload = [c for c in df.columns if c not in order_cols]
    key_cols = [F.col(k) for k in keys] + [F.substring("message", 1, prefix).alias("_msg_key")]
    best = F.min(F.struct(
        (-F.col("confidence")).alias("_neg_conf"),
        *[F.col(c) for c in order_cols],
        *[F.col(c) for c in payload if c not in keys]))
    first = F.min(F.struct(*[F.col(c).alias(f"pos_{c}") for c in order_cols]))
    g = (df.groupBy(*key_cols)
         .agg(best.alias("_b"), first.alias("_p"), F.count(F.lit(1)).alias("n_duplicates")))
    return g.select(*keys, "_b.*", "_p.*", "n_duplicates").drop("_neg_conf", "_msg_key")


def pos_columns(order_cols=ORDER_COLUMNS) -> list[str]:
    return [f"pos_{c}" for c in order_cols]


def rank_findings(df: DataFrame, order_cols=ORDER_COLUMNS,
                  partition=("review_id", "file_path"), method: str = "range") -> DataFrame:
    """``rank`` inside each file: severity, then line, stable on ``pos``.

    ``method='range'`` (default) is skew-safe (:func:`row_number_by_range`): a
    file holding a large share of all findings is spread over many tasks.
    ``method='window'`` is the plain per-file window (one task per file).
    """
    order = ["severity_rank", "line_number", *pos_columns(order_cols)]
    if method == "window":
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w))
    return row_number_by_range(df, list(partition), order, "rank")


def row_number_by_range(df: DataFrame, partition: list, order: list, name: str = "rn",
                        num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by … order by …)`` without sending a group
    to one task.  ``partition + order`` must identify a row.

    1. range-partition and sort the keys alone: a hot group spans several
       range partitions (boundaries come from sampling);
    2. number the rows of each range partition in order (monotonic id = task
       index in the high bits, row position in the low bits) and materialise
       with a reliable checkpoint, so the numbers are fixed for every reader
       and survive executor loss;
    3. per (task, group): first id and row count — a small table with at most
       one row per task and group;
    4. the offset of a group inside a task = rows of the same group in earlier
       tasks (a running sum over at most #tasks rows per group);
    5. join the offsets to the keys, and the numbers to the rows.
    """
    from revspark.session import checkpoint_root
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*partition, *order]
    s = (df.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_rid", F.monotonically_increasing_id())
         .withColumn("_task", F.shiftright(F.col("_rid"), 33))
         .checkpoint(eager=True))
    g = s.groupBy("_task", *partition).agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ["_task", *partition]]
    number = (F.col("_rid") - F.col("_first") + F.col("_off") + 1).cast("int")
    numbers = s.alias("s").join(g.alias("g"), reduce(and_, same)).select(
        *[F.col(f"s.{c}").alias(f"_k{i}") for i, c in enumerate(keys)], number.alias(name))
    match = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(numbers, reduce(and_, match)).drop(*[f"_k{i}" for i in range(len(keys))])


def severity_line(df: DataFrame) -> Column:
    return F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.substring("message", 1, 100))


def top_findings(findings: DataFrame, n: int = 10, by=("review_id", "file_path"),
                 order_cols=ORDER_COLUMNS) -> DataFrame:
    """The first ``n`` findings per group (W2 order) as ``- [severity] message`` lines.

    Without a ``rank`` column the order is computed here with ``row_number() <=
    n``, which Catalyst plans as a window-group limit applied before and after
    the shuffle — a huge group ships at most ``n`` rows per map task.  The
    grouped list holds at most ``n`` entries.
    """
    by = list(by)
    if "rank" in findings.columns:
        top = findings.filter(F.col("rank") <= n)
    else:
        w = Window.partitionBy(*by).orderBy("severity_rank", "line_number", *pos_columns(order_cols))
        top = findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.groupBy(*by)
            .agg(F.array_sort(F.collect_list(F.struct("rank", severity_line(top).alias("line"))))
                 .alias("_l"), F.count(F.lit(1)).alias("n_top"))
            .select(*by, "n_top", F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
                    .alias("top_lines")))
