"""Quality rules with host-level verdicts.

Rule counts are taken per document; failures are then aggregated by host (`source`), each host's failure rate is
shrunk towards the corpus by an empirical beta prior, and the host's verdict is joined back to its documents: a
document is kept if it passes the rules itself and its host's shrunk failure rate is at most `HOST_LIMIT`.

Defined cases: a null text has no words (so it fails the rules); documents with a null host get no host verdict; an
empty table gives an empty result; repeated rows and repeated ids each count and are judged as rows of their own;
columns of the input that clash with a result's names are not read (only doc_id, source and text are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import IS_BLANK, materialise, struct_array, texts

#: FIXED VALUES: the rules' limits.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5

#: Verdicts of up to so many hosts are broadcast (they are counted first); more are joined by shuffling.
BROADCAST_HOSTS = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                dtype=np.uint64)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    if not words:
        raw = np.frombuffer(text, dtype=np.uint8)
        return 0, 0, int(_IS_SYMBOL[raw].sum()), 0, 0
    raw = np.frombuffer(text, dtype=np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), points - int(IS_BLANK[raw].sum()), int(_IS_SYMBOL[raw].sum()), len(lines) - len(set(lines)),
            repeat_words(words))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    window = np.zeros(n, dtype=np.uint64)
    for k in range(REPEAT_WINDOW):
        window += ids[k:k + n] * _ODD[k]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    found = np.zeros(n, dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


@F.arrow_udf(_STRUCT)
def rules(text: pa.Array) -> pa.Array:
    got = np.array([rule_counts(t) for t in texts(text)], dtype=np.int64).reshape(-1, len(COUNTS))
    return struct_array([(c, pa.int64(), got[:, k]) for k, c in enumerate(COUNTS)])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


#: Weight of the prior where hosts do not differ visibly: their rates are pooled.
POOLED = 1e6


def prior_strength(n: int, f: int, q: float, squares: float, hosts: int) -> float:
    """Documents that the prior counts for, by moments of `hosts` hosts: n documents, f failed; q the sum of documents *
    rate ** 2 and squares that of documents ** 2 over the hosts.

    Weighted by documents, the squared deviations of the rates sum to (hosts - 1) * spread by sampling alone; each unit
    of true variance between hosts adds n - squares / n - (hosts - 1).
    """
    mean = f / n
    spread = mean * (1 - mean)
    seen = q - n * mean * mean - (hosts - 1) * spread
    room = n - squares / n - (hosts - 1)
    if seen <= 0 or room <= 0:
        return POOLED
    return min(POOLED, max(1.0, spread * room / seen - 1))


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(source, host_docs, host_rate, host_ok) from rows of (source, base_failed).

    The beta prior is fitted to the hosts' rates by the method of moments, each host weighted by its documents. With
    one host, or none that differ, the prior is the corpus rate with the weight of `POOLED` documents.
    """
    hosts = (judged.where(F.col("source").isNotNull()).groupBy("source")
             .agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    # one row of five numbers, whatever the number of hosts
    m = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"),
                  F.sum(F.col("host_docs") * rate * rate).alias("q"), F.count(F.lit(1)).alias("hosts"),
                  F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("squares")).first()
    n, mean = (m["n"] or 0), 0.0
    strength = 1.0
    if n:
        mean = m["f"] / n
        strength = prior_strength(n, m["f"], m["q"], m["squares"], m["hosts"])
    a, b = mean * strength, (1 - mean) * strength
    shrunk = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    out = hosts.select("source", "host_docs", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok"))
    return F.broadcast(out) if m["hosts"] <= BROADCAST_HOSTS else out


def quality_report(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per row of `docs`: the rule counts, base_failed, the host's shrunk failure rate, kept."""
    counted = docs.select("doc_id", "source", rules("text").alias("q")).select("doc_id", "source", "q.*")
    judged = materialise(counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))),
                         "quality")
    out = judged.join(host_verdicts(judged, limit), "source", "left")
    return out.select("doc_id", *COUNTS, "base_failed",
                      (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), "source", "host_rate")


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """`docs` without the documents that the rules or their host's verdict reject; columns unchanged."""
    judged = docs.select("*", rules("text").alias("__q"))
    failed = base_failed(F.col("__q.n_words"), F.col("__q.n_repeat_words"))
    verdicts = host_verdicts(judged.select("source", failed.alias("base_failed")), limit)
    kept = judged.where(~failed).join(verdicts.select("source", F.col("host_ok").alias("__ok")), "source", "left")
    return kept.where(F.coalesce("__ok", F.lit(True))).select(*docs.columns)
