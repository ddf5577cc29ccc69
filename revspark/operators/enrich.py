"""J1/J2 enrichment, J6 cache lookup with TTL, J7 code context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.functions.text import context_lines, splitlines
from revspark.schemas import CACHE_TTL_SECONDS

FILE_KEY = ["review_id", "file_path"]


def enrich(findings: DataFrame, responses: DataFrame, fallback: str | None,
           key: str = "prompt_key") -> DataFrame:
    """J1 (fallback None: keep own suggestion) / J2 (fallback text).

    ``findings`` carry ``prompt_key`` (the key of the prompt asked for that
    finding); ``responses(prompt_key, response, error[, ts])``: of several rows
    of a key the newest counts (without ``ts`` the greatest answer).  If any response of a (file, agent) batch is an error, the whole batch keeps its
    own suggestions.
    """
    if key not in findings.columns:
        raise ValueError("findings need a prompt_key column (see prompts.finding_prompts)")
    answer = F.struct(*([F.col("ts")] if "ts" in responses.columns else []), F.col("response").alias("_resp"),
                      F.coalesce(F.col("error"), F.lit(False)).alias("_err"))
    r = responses.groupBy(key).agg(F.max(answer).alias("_a")).select(key, "_a._resp", "_a._err")
    j = findings.join(r, key, "left")
    # batches with an error response, from the (few) errors alone
    batch = ["review_id", "file_path", "agent_name"]
    bad = (findings.select(key, *batch).join(r.where("_err").select(key), key, "left_semi")
           .select(*batch).distinct().withColumn("_bad", F.lit(True)))
    resp = F.when(F.length("_resp") > 0, F.col("_resp"))
    new = F.coalesce(resp, F.col("suggestion")) if fallback is None else F.coalesce(resp, F.lit(fallback))
    return (j.join(bad, batch, "left").withColumn("suggestion", F.when(F.col("_bad"), F.col("suggestion")).otherwise(new))
            .drop("_resp", "_err", "_bad"))


def cache_lookup(prompts: DataFrame, responses: DataFrame, now, ttl_seconds: int = CACHE_TTL_SECONDS):
    """``(hits, misses)``.

    A hit is a stored non-empty response for the same key younger than the TTL
    (the newest one wins, chosen with a partial ``max_by`` aggregation).  Misses
    are the work list: one row per distinct prompt key.
    """
    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    fresh = responses.filter((F.length("response") > 0) & (F.col("ts") <= now_c)
                             & (F.col("ts") > now_c - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")))
    latest = fresh.groupBy("prompt_key").agg(F.max_by("response", "ts").alias("response"),
                                             F.max("ts").alias("cached_ts"))
    hits = prompts.join(latest, "prompt_key", "inner")
    misses = prompts.join(latest.select("prompt_key"), "prompt_key", "left_anti").dropDuplicates(["prompt_key"])
    return hits, misses


def asof_lookup(prompts: DataFrame, responses: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """J6 at each prompt's own time: the rows of ``prompts(prompt_key, ts, …)`` with ``response`` and ``cached_ts``.

    A prompt takes the newest non-empty answer of its key that was stored at its time or before, if that is younger than
    the TTL; else both are NULL.  Of answers of one key and moment the greatest text wins.  Prompts without a key or a
    time find none.

    Prompts and answers are sorted together by (key, time) in ranges of any size, so a key with a third of all rows
    spans many tasks.  What a range needs from those before it is one answer, the last of its first key; it comes
    from a table of one row a range and is put at the head of the range.
    """
    from revspark.session import write_once
    others = [c for c in prompts.columns if c not in ("prompt_key", "ts")]
    answers = (responses.where((F.length("response") > 0) & F.col("prompt_key").isNotNull() & F.col("ts").isNotNull())
               .groupBy("prompt_key", "ts").agg(F.max("response").alias("response")))
    none = F.lit(None)
    asked = prompts.select("prompt_key", "ts", F.lit(1).alias("kind"), none.cast("string").alias("response"),
                           F.struct(*others, F.lit(True).alias("_is")).alias("row"))
    told = answers.select("prompt_key", "ts", F.lit(0).alias("kind"), "response", none.cast(asked.schema["row"].dataType).alias("row"))
    order = ["prompt_key", "ts", "kind"]
    rows = write_once(asked.unionByName(told).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "asof")

    at = F.struct("ts", "response")
    ends = rows.groupBy("part").agg(F.min("prompt_key").alias("first_key"), F.max("prompt_key").alias("last_key"))
    last = (rows.where("kind = 0").join(ends.select("part", F.col("last_key").alias("prompt_key")), ["part", "prompt_key"])
            .groupBy("part", "prompt_key").agg(F.max(at).alias("a")))  # a row a range at most
    begins = ends.select("part", F.col("first_key").alias("prompt_key"), F.lit(0).alias("step"), none.cast(last.schema["a"].dataType).alias("a"))
    earlier = Window.partitionBy("prompt_key").orderBy("part", "step").rowsBetween(Window.unboundedPreceding, -1)  # two rows a range at most
    carried = (begins.unionByName(last.withColumn("step", F.lit(1))).withColumn("a", F.max("a").over(earlier))
               .where((F.col("step") == 0) & F.col("a").isNotNull())
               .select("prompt_key", "a.ts", F.lit(0).alias("kind"), "a.response", none.cast(asked.schema["row"].dataType).alias("row"), "part"))
    before = (Window.partitionBy("part", "prompt_key").orderBy("ts", "kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    newest = F.last(F.when(F.col("kind") == 0, F.struct(F.col("ts").alias("cached_ts"), "response")), ignorenulls=True).over(before)
    found = rows.unionByName(carried).withColumn("_a", newest).where("kind = 1")
    fresh = F.col("_a.cached_ts") > F.col("ts") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    return found.select("prompt_key", "ts", *[F.col(f"row.{c}").alias(c) for c in others],
                        F.when(fresh, F.col("_a.response")).alias("response"), F.when(fresh, F.col("_a.cached_ts")).alias("cached_ts"))


def with_context(findings: DataFrame, files: DataFrame, k: int = 3, style: str = "bar") -> DataFrame:
    """Attach the +-k line block around each finding.

    The distinct (file, line) pairs are gathered per file — at most one entry
    per line of the file, so the list is bounded by the file size, not by the
    number of findings — joined once to the file text, each block cut from one
    split of the text, then joined back to the findings on (file, line).  The
    text is never copied per finding.
    """
    need = (findings.filter(F.col("line_number") >= 1).select(*FILE_KEY, "line_number").distinct()
            .groupBy(*FILE_KEY).agg(F.collect_list("line_number").alias("_lines")))
    blocks = (files.select(*FILE_KEY, "code").join(need, FILE_KEY)
              .select(*FILE_KEY, splitlines(F.col("code")).alias("_text"), "_lines")
              .select(*FILE_KEY, F.explode(F.transform("_lines", lambda ln: F.struct(
                  ln.alias("line_number"), context_lines(F.col("_text"), ln, k, style).alias("context"))))
                  .alias("b"))
              .select(*FILE_KEY, "b.line_number", "b.context"))
    return findings.join(blocks, FILE_KEY + ["line_number"], "left")
