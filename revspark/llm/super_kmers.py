"""Substring deduplication by super-k-mers: a word goes if a window of WIDTH words over it also starts in a document with a
smaller doc_id.

1. Minimisers. The minimiser of a window is the smallest hash of the runs of GRAM words in it, so equal windows have equal
   minimisers. Consecutive windows that share it form a super-k-mer: one packed string of words instead of a string a window.
2. A window that stands in two texts has a minimiser that does. Minimisers of one text alone, exact copies counted as one, are
   left behind: a filter of bounded size (`word_hashes.hash_filter`) tells them, and what it lets through too much is found to
   be unrepeated later.
3. Super-k-mers travel to the bucket of their minimiser. There the windows of all its strings are sorted by their bytes:
   equal neighbours are the same window, and its smallest doc_id is known. A bucket has at most HOT_ROWS rows.
4. Minimisers of more rows (common passages) take a longer way: their windows travel one by one, equal ones merged before, each to a
   bucket of its own; the smallest doc_ids are joined back to the places, a join that may be skewed and that Spark can split.
5. Each text's covered words are cut out. The texts are shuffled once; every step that needs them reads that exchange.

Of equal texts only the one with the smallest doc_id is looked at: the others, if they have a window, lose all their words.

Defined cases: a null text has no words; texts of under WIDTH words keep all; a null doc_id is neither smaller nor larger than
any, so that its row keeps all its words and takes none from others; rows that repeat a doc_id do not shorten each other;
repeated rows give a row each; very long texts are cut into pieces of a bounded number of windows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import SLICE_BYTES, groups_of, materialise, texts
from revspark.llm.word_hashes import hash_filter, hash_grams, hash_words, passes, word_edges

WIDTH = 13
GRAM = 4
#: Windows a packed string has at most; longer runs are cut.
RUN = 64
HOT_ROWS = 20_000
#: Rows whose windows are sorted at once (whole buckets, or one bucket).
SORT_ROWS = 20_000
#: Windows of a text that are looked at together.
_CHUNK = 1 << 19


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE_BYTES, with the position of the first, words joined by one space."""
    held: list[bytes] = []
    size = begin = 0
    for k, text in enumerate(texts(column)):
        if size > SLICE_BYTES:
            yield begin, held
            held, size, begin = [], 0, k
        held.append(b" ".join(text.split()))
        size += len(held[-1])
    if held:
        yield begin, held


class _Runs:
    """The super-k-mers of a block of texts: text number, first window (a word of the block), windows, minimiser."""

    def __init__(self, block: list[bytes], width: int, gram: int):
        self.bytes = b" ".join(block)
        raw = np.frombuffer(self.bytes, dtype=np.uint8)
        self.starts, self.ends = word_edges(raw != 0x20)
        self.n_words = np.array([t.count(b" ") + 1 if t else 0 for t in block], dtype=np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        owner = np.repeat(np.arange(len(block), dtype=np.int64), self.n_words)
        words = hash_words(raw, self.starts, self.ends)
        parts = [self._runs(words, owner, k, width, gram) for k in range(0, max(0, len(words) - width + 1), _CHUNK)]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 4
        self.first, self.windows, self.owner, self.hash = joined[0], joined[1], joined[2], joined[3].astype(np.uint64)

    @staticmethod
    def _runs(words: np.ndarray, owner: np.ndarray, begin: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
        words = words[begin:begin + _CHUNK + width - 1]
        owner = owner[begin:begin + _CHUNK + width - 1]
        grams = hash_grams(words, gram)
        n = len(words) - width + 1
        span = width - gram + 1
        least, reach = grams, 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[:n], least[span - reach:span - reach + n])
        whole = owner[:n] == owner[width - 1:]  # windows within one text
        at = np.flatnonzero(whole)
        if not len(at):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(np.uint64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
        run = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        first = np.flatnonzero(within % RUN == 0)
        return at[first] + begin, np.diff(np.append(first, len(at))), owner[at[first]], least[at[first]]


def _minimiser_rows(width: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct minimisers of each text."""
        for batch in batches:
            t1 = batch.column("t1").to_numpy()
            for begin, block in _blocks(batch.column("text")):
                runs = _Runs(block, width, gram)
                order = np.lexsort((runs.hash, runs.owner))
                owner, h = runs.owner[order], runs.hash[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (np.diff(owner) != 0) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(t1[begin + owner[new]]), pa.array(h[new].view(np.int64))], names=["t1", "h"])

    return rows


_PLACES = "bucket long, packed binary, did long, t1 long, start int"


def _taker(known, hot, width: int, gram: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The super-k-mers whose minimisers pass, and where they start."""
        for batch in batches:
            for begin, block in _blocks(batch.column("text")):
                runs = _Runs(block, width, gram)
                keep = np.flatnonzero(passes(known.value, runs.hash) & ~passes(hot.value, runs.hash))
                first = runs.first[keep]
                ends = runs.ends[first + runs.windows[keep] + width - 2]
                packed = [runs.bytes[a:b] for a, b in zip(runs.starts[first].tolist(), ends.tolist(), strict=True)]
                rows = pa.array(begin + runs.owner[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.hash[keep].view(np.int64)), pa.array(packed, pa.binary()), batch.column("did").take(rows),
                     batch.column("t1").take(rows), pa.array((first - runs.first_word[runs.owner[keep]]).astype(np.int32))],
                    names=["bucket", "packed", "did", "t1", "start"])

    return take


def _hot_windows(batch: pa.RecordBatch, hot, width: int, gram: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(row, window, its id, first word) of every window of a hot minimiser."""
    for begin, block in _blocks(batch.column("text")):
        runs = _Runs(block, width, gram)
        for k in np.flatnonzero(passes(hot.value, runs.hash)).tolist():
            first, row = int(runs.first[k]), int(runs.owner[k])
            for w in range(first, first + int(runs.windows[k])):
                window = runs.bytes[runs.starts[w]:runs.ends[w + width - 1]]
                yield begin + row, window, xxhash.xxh3_128_digest(window), w - int(runs.first_word[row])


def _hot_packer(hot, width: int, gram: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct windows of each batch with the smallest doc_id that has them."""
        for batch in batches:
            ids = batch.column("did").to_pylist()
            seen: dict[bytes, int] = {}
            for row, _, wid, _ in _hot_windows(batch, hot, width, gram):
                seen[wid] = min(seen.get(wid, ids[row]), ids[row])
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["wid", "did"])

    return pack


def _hot_placer(hot, width: int, gram: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each text has each window of a hot minimiser."""
        for batch in batches:
            found = [(row, wid, start) for row, _, wid, start in _hot_windows(batch, hot, width, gram)]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[1] for f in found], pa.binary()), batch.column("did").take(rows), batch.column("t1").take(rows),
                 pa.array([f[2] for f in found], pa.int32())], names=["wid", "did", "t1", "start"])

    return place


def _windows(packed: bytes, width: int) -> list[bytes]:
    cuts = [-1]
    at = packed.find(b" ")
    while at >= 0:
        cuts.append(at)
        at = packed.find(b" ", at + 1)
    cuts.append(len(packed))
    return [packed[cuts[k] + 1:cuts[k + width]] for k in range(len(cuts) - width)]


_FOUND = "did long, t1 long, start int, least array<long>"


def _counter(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest doc_id of each window of a place; rows come sorted by bucket and string. Places none of whose windows
        stand in a smaller document are left out."""
        held: list[tuple] = []  # (bucket, packed, did, t1, start)

        def result() -> pa.RecordBatch:
            windows: list[bytes] = []
            ends: list[int] = []  # of the windows of each distinct string
            low: list[int] = []
            string: list[int] = []  # of each row
            for k, row in enumerate(held):
                if not k or row[1] != held[k - 1][1] or row[0] != held[k - 1][0]:
                    windows += _windows(row[1], width)
                    ends.append(len(windows))
                    low.append(row[2])
                elif row[2] < low[-1]:
                    low[-1] = row[2]
                string.append(len(ends) - 1)
            owner = np.repeat(np.arange(len(ends)), np.diff([0, *ends])).tolist()
            order = sorted(range(len(windows)), key=windows.__getitem__)
            least = [0] * len(windows)
            k = 0
            while k < len(order):
                window, end, lowest = windows[order[k]], k + 1, low[owner[order[k]]]
                while end < len(order) and windows[order[end]] == window:
                    lowest = min(lowest, low[owner[order[end]]])
                    end += 1
                for x in order[k:end]:
                    least[x] = lowest
                k = end
            lists = [least[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            lowest = [min(x) for x in lists]
            hit = [k for k, row in enumerate(held) if lowest[string[k]] < row[2]]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[k][2] for k in hit], pa.int64()), pa.array([held[k][3] for k in hit], pa.int64()),
                 pa.array([held[k][4] for k in hit], pa.int32()), pa.array([lists[string[k]] for k in hit], pa.list_(pa.int64()))],
                names=["did", "t1", "start", "least"])

        for table in groups_of(batches, "bucket"):
            for part in table.to_batches(max_chunksize=10_000):
                for row in zip(*(part.column(c).to_pylist() for c in ("bucket", "packed", "did", "t1", "start")), strict=True):
                    if len(held) >= SORT_ROWS and held[-1][0] != row[0]:
                        yield result()
                        held = []
                    held.append(row)
        if held:
            yield result()

    return count


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha", T.StringType()),
                     T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])


def _covered(did: np.ndarray, sizes: np.ndarray, found: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the texts, one after the other, are covered; and where each text begins."""
    begin = np.cumsum(sizes) - sizes
    lengths = np.diff(found.offsets.to_numpy())
    rows = found.flatten()
    text = np.repeat(np.arange(len(sizes)), lengths)
    least = rows.field("least")
    n = np.diff(least.offsets.to_numpy())
    values = least.flatten().to_numpy()
    first = np.repeat(begin[text] + rows.field("start").to_numpy(), n)
    place = first + np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    hit = place[values < np.repeat(did[text], n)]
    total = int(sizes.sum())
    step = np.bincount(hit, minlength=total + width + 1) - np.bincount(hit + width, minlength=total + width + 1)[:total + width + 1]
    return np.cumsum(step)[:total] > 0, begin


def _cutter(width: int, keep: bool):
    @F.arrow_udf(_CUT)
    def cut(did: pa.Array, text: pa.Array, copy: pa.Array, found: pa.Array) -> pa.Array:
        """Cut the covered words out of each text, or all words out of copies of earlier texts that have a window."""
        words = [t.split() for t in texts(text)]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        cover, begin = _covered(did.fill_null(0).to_numpy(), sizes, found, width)
        out = []
        for own, n, start, again in zip(words, sizes.tolist(), begin.tolist(), copy.to_pylist(), strict=True):
            gone = cover[start:start + n]
            if again and n >= width:
                gone = np.ones(n, dtype=bool)
            a, b = word_edges(gone)
            spans = np.stack([a, b], axis=1).tolist()
            edges = [0, *(x for s in spans for x in s), n]
            kept = b" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in own[x:y])
            out.append({"n_words": n, "n_removed": int(gone.sum()), "sha": hashlib.sha256(kept).hexdigest(), "spans": spans,
                        "kept": kept.decode() if keep else None})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()),
                                        ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())]))

    return cut


def substring_dedup(docs: DataFrame, keep: bool = False, width: int = WIDTH, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256 and `spans`, the removed words as [start, end) in words; with
    `keep` also `kept`, the words that stay, joined by one space."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("did"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"),
                       text.alias("text"))
    named = rows.where(F.col("did").isNotNull())

    # minimisers of two texts at least
    seen = (named.select("t1", "text").mapInArrow(_minimiser_rows(width, gram), "t1 long, h long")
            .groupBy("h").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.count(F.lit(1)).alias("c")))
    shared = materialise(seen.where("lo < hi").select("h", (F.col("c") > hot_rows).alias("hot")), "shared")
    hot_ones = shared.where("hot")
    known, hot = hash_filter(shared, "h"), hash_filter(hot_ones, "h")

    keys = ["did", "t1"]
    source = named.select(*keys, "text")
    firsts = named.groupBy("t1", "t2").agg(F.min("did").alias("did")).dropDuplicates(keys).select(*keys, F.lit(False).alias("copy"))
    held = source.join(firsts.hint("shuffle_merge"), keys).select(*keys, "text")
    found = (held.mapInArrow(_taker(known, hot, width, gram), _PLACES).repartition("bucket").sortWithinPartitions("bucket", "packed")
             .mapInArrow(_counter(width), _FOUND))
    if not hot_ones.isEmpty():
        least = held.mapInArrow(_hot_packer(hot, width, gram), "wid binary, did long").groupBy("wid").agg(F.min("did").alias("least"))
        places = held.mapInArrow(_hot_placer(hot, width, gram), "wid binary, did long, t1 long, start int").join(least, "wid")
        found = found.union(places.where("least < did").select("did", "t1", "start", F.array("least")))
    ranges = found.groupBy(*keys).agg(F.collect_list(F.struct("start", "least")).alias("found"))  # of one text

    nothing = F.expr("cast(array() as array<struct<start:int,least:array<bigint>>>)")
    cut = lambda copy, found: _cutter(width, keep)("did", "text", copy, found)
    joined = source.join(firsts.hint("shuffle_merge"), keys, "left").join(ranges.hint("shuffle_merge"), keys, "left")
    told = joined.select("did", cut(F.coalesce("copy", F.lit(True)), F.coalesce("found", nothing)).alias("x"))
    unnamed = rows.where(F.col("did").isNull()).select("did", cut(F.lit(False), nothing).alias("x"))
    return told.union(unnamed).select(F.col("did").alias("doc_id"), "x.n_words", "x.n_removed", F.col("x.sha").alias("kept_sha256"),
                                      "x.spans", *(["x.kept"] if keep else []))
