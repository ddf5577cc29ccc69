"""Phrase collocations by ordered count streams.

1. Which words and pairs occur LEAST times is counted on their hashes, for a filter of bounded size (`word_hashes.hash_filter`): a
   phrase can only be frequent if all its pairs are. The filter saves traffic and decides nothing.
2. Words, and phrases of 2 to SIZE words whose pairs pass, are counted exactly, pre-aggregated in every batch. What occurs LEAST
   times goes on; every part of such a phrase is there too.
3. The counts are laid out as two streams: in prefix order (sorted by words from the first) and in suffix order (from the
   last). In prefix order a phrase comes right after its own first words and right before its extensions, so one pass with a stack
   of SIZE entries reads off the counts of all its left parts and the largest count of a right extension; suffix order gives
   right parts and left extensions. Streams are cut into ranges of any size: the first words that a range's first
   phrase needs from earlier ranges are sent along (at most SIZE - 1 rows a range), so that no word is a key of a task.
4. Both passes meet phrase by phrase in a merge join; scores are computed in DECIMAL.

The longest phrases decide whether a candidate is dropped through its one-word extensions alone: a longer phrase around it
occurs no more often than the one-word extension inside it.

Defined cases: a null text is empty; a null lang counts as `und`; texts without words, and langs without frequent
phrases, give no row; ties go by score, count and phrase; repeated rows count each; an empty table gives an empty result; other
columns and doc_id are not read. Texts are worked on whole, in blocks; a block is at least one text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import materialise, texts
from revspark.llm.word_hashes import hash_filter, hash_grams, hash_words, passes, word_edges

LEAST = 30
SIZE = 4
TOP = 2000
#: Percentage of a candidate's count that an extension needs to displace it.
DROP = 80
SCALE = 2_000_000

_NO_LANG = "und"
_CLEAN = bytes(0x0A if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
_BLANKS = re.compile(rb" {2,}")
#: Bytes of a block; hashes, and distinct phrases, that a task holds before it passes their counts on.
_BLOCK, _HASHES, _PHRASES = 1 << 20, 1 << 21, 100_000


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Lower-cased texts of one lang, one after the other: pieces end at a line feed, blanks stand alone."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
        held.setdefault(lang, []).append(text)
        size[lang] += len(text)
        if size[lang] > _BLOCK:
            yield lang, _clean(held.pop(lang))
            size[lang] = 0
    for lang, own in held.items():
        yield lang, _clean(own)


def _clean(own: list[bytes]) -> bytes:
    return _BLANKS.sub(b" ", b"\n".join(own).lower().translate(_CLEAN))


class _Words:
    """Words of a block, their hashes, and which of them the next word follows in the same piece."""

    def __init__(self, lang: str, block: bytes):
        raw = np.frombuffer(block, dtype=np.uint8)
        self.starts, self.ends = word_edges((raw != 0x20) & (raw != 0x0A))
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        words = hash_words(raw, self.starts, self.ends)
        breaks = np.cumsum(raw == 0x0A)
        self.follows = breaks[self.starts[1:]] == breaks[self.ends[:-1] - 1] if len(words) else np.zeros(0, dtype=bool)
        self.single = words ^ seed
        self.pairs = hash_grams(words, 2) ^ seed


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and pairs with their counts in a stretch of the input."""
    held: list[np.ndarray] = []
    size = 0

    def result() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32))], names=["h", "c"])

    for batch in batches:
        for lang, block in _blocks(batch):
            words = _Words(lang, block)
            held += [words.single, words.pairs[words.follows]]
            size += len(held[-2]) + len(held[-1])
            if size > _HASHES:
                yield result()
                held, size = [], 0
    if held:
        yield result()


def _phrase_counter(known: Broadcast, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of phrases that can be frequent, in a stretch of the input; the empty phrase counts all words."""
        held: dict[str, Counter] = {}

        def result() -> pa.RecordBatch:
            langs = pa.array(np.repeat(np.arange(len(held)), [len(own) for own in held.values()]))
            phrases = pa.array((p for own in held.values() for p in own), pa.binary())
            counts = pa.array((n for own in held.values() for n in own.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()).take(langs), phrases.cast(pa.string()), counts],
                                              names=["lang", "phrase", "c"])

        for batch in batches:
            for lang, block in _blocks(batch):
                words = _Words(lang, block)
                own = held.setdefault(lang, Counter())
                own[b""] += len(words.starts)
                begin = np.flatnonzero(passes(known.value, words.single))
                pair = words.follows & passes(known.value, words.pairs)
                run = pair
                for n in range(1, size + 1):
                    if n > 1:
                        run = pair if n == 2 else run[:-1] & pair[n - 2:]
                        begin = np.flatnonzero(run)
                    own.update(block[a:b] for a, b in zip(words.starts[begin].tolist(), words.ends[begin + n - 1].tolist(), strict=True))
                if sum(map(len, held.values())) > _PHRASES:
                    yield result()
                    held = {}
        yield result()

    return count


def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = SIZE) -> DataFrame:
    """(lang, phrase, a): counts of the words and phrases that occur `least` times, and of all words as the empty phrase."""
    rows = docs.select(F.coalesce("lang", F.lit(_NO_LANG)).alias("lang"), "text")
    hashes = materialise(rows.mapInArrow(_hash_counts, "h long, c int").groupBy("h").agg(F.sum("c").alias("c"))
                         .where(F.col("c") >= least).select("h"), "frequent-hashes")
    counts = rows.mapInArrow(_phrase_counter(hash_filter(hashes, "h"), size), "lang string, phrase string, c long")
    return (counts.groupBy("lang", "phrase").agg(F.sum("c").alias("a"))
            .where((F.col("a") >= least) | (F.col("phrase") == "")))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over an ordered stream: for every phrase the counts of its first words and its most frequent extension."""
    stack: list[list] = []  # the phrase before, and its own first words: [lang, words, a, borrowed, counts, extension]
    at = None
    for batch in batches:
        out: list[list] = []
        for part, lang, words, a, borrowed in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "words", "a", "borrowed")),
                                                  strict=True):
            if (part, lang) != at:
                out += stack[::-1]
                stack, at = [], (part, lang)
            while stack and stack[-1][1] != words[:len(stack[-1][1])]:
                out.append(stack.pop())
            if stack and len(stack[-1][1]) == len(words) - 1:
                stack[-1][5] = max(stack[-1][5], a)
            stack.append([lang, words, a, borrowed, [x[2] for x in stack], 0])
        yield _walked(out)
    yield _walked(stack)


def _walked(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                      names=["lang", "words", "a", "borrowed", "parts", "extension"])


def ordered_pass(counts: DataFrame, name: str) -> DataFrame:
    """(lang, words, parts, extension) for every row of `counts` (lang, words, a): the counts of its first 1, 2, ... words, and
    the largest count of a phrase with one more word at the end (0 if there is none)."""
    order = ["lang", "words"]
    stream = materialise(counts.select(*order, "a").repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()), name)
    begins = stream.groupBy("part").agg(F.min(F.struct(*order)).alias("b"))
    needs = begins.select("part", F.col("b.lang").alias("lang"), F.explode(F.expr(
        "transform(sequence(1, size(b.words)), k -> slice(b.words, 1, k))")).alias("words")).where("words != b.words")
    borrowed = needs.join(stream.drop("part").hint("merge"), order).select(*order, "a", "part", F.lit(True).alias("borrowed"))
    walked = (stream.withColumn("borrowed", F.lit(False)).unionByName(borrowed).repartition("part")
              .sortWithinPartitions("part", *order)
              .mapInArrow(_walk, "lang string, words array<string>, a long, borrowed boolean, parts array<long>, extension long"))
    return walked.groupBy(*order).agg(F.max(F.when(~F.col("borrowed"), F.col("parts"))).alias("parts"),
                                      F.max("extension").alias("extension"))


def collocations(docs: DataFrame, least: int = LEAST, size: int = SIZE, top: int = TOP, drop: int = DROP) -> DataFrame:
    """Each lang's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    every = materialise(phrase_counts(docs, least, size), "phrase-counts")
    totals = every.where("phrase = ''").select("lang", F.col("a").alias("n"))
    counts = every.where("phrase != ''").select("lang", "phrase", F.split("phrase", " ").alias("words"), "a")
    ahead = ordered_pass(counts, "prefix-order").select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("parts").alias("lefts"), F.col("extension").alias("right"))
    behind = ordered_pass(counts.withColumn("words", F.reverse("words")), "suffix-order").select(
        "lang", F.array_join(F.reverse("words"), " ").alias("phrase"), F.col("parts").alias("rights"), F.col("extension").alias("left"))
    both = (counts.where(F.size("words") > 1).select("lang", "phrase", "a")
            .join(ahead.hint("merge"), ["lang", "phrase"]).join(behind.hint("merge"), ["lang", "phrase"]))
    # lefts and rights: counts of the first and of the last 1, 2, ... words; a cut after k words pairs lefts[k] with the other end
    cut = F.expr(f"""array_min(transform(sequence(1, size(lefts)), k -> struct(
        cast((cast({SCALE} as decimal(38, 0)) * a) div (cast(lefts[k - 1] as decimal(38, 0)) + rights[size(rights) - k]) as bigint)
          as score, k as k, lefts[k - 1] as l, rights[size(rights) - k] as r)))""")
    longest = F.greatest("left", "right").cast("decimal(38, 0)")
    scored = (both.where(longest * 100 < F.col("a").cast("decimal(38, 0)") * drop)
              .select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
