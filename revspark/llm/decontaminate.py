"""Benchmark decontamination with an FM-index over each shard of the training documents.

A benchmark item's phrases are its windows of `WIDTH` consecutive words (a shorter item is one phrase). Each task cuts
its documents into shards of about `SHARD_WORDS` words. A shard's words are coded by the benchmark's vocabulary; words
outside it can stand in no occurrence, and neither can runs of known words shorter than the shortest phrase, so only the
other runs are indexed. All phrases are searched backward at once through wavelet-tree ranks; their places come from
sampled suffix positions and are merged into removal spans of words.

The benchmark is a query set: it is taken in blocks of about `BLOCK_BYTES` of text, however large it is, and each block
is searched in all documents. With more than one block the spans of a document are merged by (doc_id, text hash).

Defined cases: a null or empty text has no words and is clean; items without words give no phrase; items with a null id
hit words but are not listed; equal item ids count once; repeated documents give a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import WORD, texts
from revspark.llm.fm_index import FMIndex

WIDTH = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16_000_000
#: A document is contaminated when hit words are at least this part of its words.
LEAST_SHARE = 20

_WORDS = re.compile(WORD)
_BREAK = 1  # symbol between runs; words are numbered from 2


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return _BREAK


class Phrases:
    """The distinct phrases of a block of items, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.ids = _Vocabulary()
        holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = _WORDS.findall((text or "").encode().lower())
            codes = [self.ids.setdefault(w, len(self.ids) + 2) for w in words]
            n = min(width, len(codes))
            for k in range(len(codes) - n + 1) if n else ():
                holders[tuple(codes[k:k + n])].update([] if item is None else [str(item)])
        by_length = defaultdict(list)
        for phrase in holders:
            by_length[len(phrase)].append(phrase)
        self.patterns = [(np.array(p, dtype=np.int64), [holders[x] for x in p]) for p in by_length.values()]
        self.shortest = min(by_length, default=0)

    def search(self, words: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(start, end, items) of every occurrence in a shard's coded words."""
        known = np.concatenate([[False], words != _BREAK, [False]])
        starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return []
        # the runs one after another, a break behind each
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        origin = np.repeat(starts - begin[:-1], sizes + 1) + np.arange(begin[-1])
        text = np.append(words, _BREAK)[origin]
        text[begin[1:] - 1] = _BREAK
        index = FMIndex(text, len(self.ids) + 2)
        out = []
        for patterns, holders in self.patterns:
            low, high = index.search(patterns)
            count = high - low
            which = np.repeat(np.arange(len(patterns)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = origin[index.locate(rows)]
            out += [(int(a), int(a) + patterns.shape[1], holders[p]) for a, p in zip(at, which, strict=True)]
        return out


def search_texts(column: pa.Array, phrases: Phrases, shard_words: int) -> list[dict]:
    """n_words, merged spans of words and items of each text."""
    out: list[dict] = []
    shard: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        first = len(out) - len(shard)
        begin = np.cumsum([0] + [len(x) for x in shard])
        spans = defaultdict(list)
        if phrases.shortest:
            for a, b, items in sorted(phrases.search(np.concatenate([*shard, [_BREAK]])), key=lambda x: x[0]):
                k = int(np.searchsorted(begin, a, side="right")) - 1
                own, merged = out[first + k], spans[k]
                own["items"].update(items)
                if merged and a - begin[k] <= merged[-1]["e"]:
                    merged[-1]["e"] = max(merged[-1]["e"], int(b - begin[k]))
                else:
                    merged.append({"s": int(a - begin[k]), "e": int(b - begin[k])})
            for k, merged in spans.items():
                out[first + k]["spans"] = merged
        shard.clear()
        held = 0

    code = phrases.ids.__getitem__
    for text in texts(column):
        words = _WORDS.findall(text.lower())
        out.append({"n_words": len(words), "spans": [], "items": set()})
        shard.append(np.fromiter((*map(code, words), _BREAK), dtype=np.int64, count=len(words) + 1))
        held += len(words)
        if held >= shard_words:
            flush()
    if shard:
        flush()
    return [x | {"items": sorted(x["items"])} for x in out]


_SPAN = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
                       T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                          ("items", pa.list_(pa.string()))])


def _searcher(spark, items: list, width: int):
    held = spark.sparkContext.broadcast(items)  # one block: its size is bounded
    built: list[Phrases] = []

    @F.arrow_udf(_FOUND)
    def search(text: pa.Array) -> pa.Array:
        if not built:
            built.append(Phrases(held.value, width))
        return pa.array(search_texts(text, built[0], SHARD_WORDS), type=_FOUND_ARROW)

    return search


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct(
        F.greatest(a["to"], x["e"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["to"], x["s"]))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column `__found`: n_words, spans, items, n_hit, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    searchers = [_searcher(spark, [tuple(r) for r in items.where(block == k).toLocalIterator()], width) for k in range(n_blocks)]
    if n_blocks == 1:
        found = docs.withColumn("__f", searchers[0]("text"))
    else:
        rows = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))
        parts = rows.select("doc_id", "__key", searchers[0]("text").alias("f"))
        for search in searchers[1:]:
            parts = parts.unionByName(rows.select("doc_id", "__key", search("text").alias("f")))
        merged = parts.groupBy("doc_id", "__key").agg(
            F.first("f.n_words").alias("n_words"), F.flatten(F.collect_set("f.spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("f.items"))).alias("items"))
        m = merged.select(F.col("doc_id").alias("__d"), F.col("__key").alias("__h"),
                          F.struct("n_words", "spans", "items").alias("__f"))
        found = rows.join(m, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__h")))
    n_hit = _covered(F.col("__f.spans"))
    share = (F.col("__n") > 0) & (LEAST_SHARE * F.col("__n") >= F.col("__f.n_words"))
    return found.withColumn("__n", n_hit).select(
        *docs.columns, F.struct("__f.n_words", "__f.spans", "__f.items", F.col("__n").alias("n_hit"),
                                share.alias("contaminated")).alias("__found"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: the contract's columns and `spans`, the merged removal spans in words."""
    f = contamination(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", "__found.*")
    return f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    return contamination(docs, benchmark, **options).where(~F.col("__found.contaminated")).drop("__found")
