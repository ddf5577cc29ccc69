"""Suffix-array deduplication: every byte covered by a WIDTH-byte string that also starts elsewhere is removed.

1. Anchors. Every window of WIDTH bytes has as its anchor the gram of GRAM bytes in it whose hash is smallest (the last of
   equals), so equal windows have equal anchors at equal places. One gram in about (WIDTH - GRAM) / 2 is an anchor.
2. Texts that occur more than once are removed whole; one row stands for them from here on. Only anchors whose gram
   occurs at least twice can lie in a repeated window.
3. Contexts. Around each such anchor the bytes of all its windows are taken. Equal contexts are merged before the shuffle;
   the contexts of one gram meet in one task, where a hash-compared suffix sort (`suffix_sort`) finds the windows
   that occur elsewhere. Grams in more than HOT_TEXTS texts would make a group too large: their windows are sent as contexts
   of their own, keyed by the window's hash, so that each group is one distinct window, merged before the shuffle.
4. Results return to the documents as byte ranges, merged there into spans.

The text is shuffled once: both uses of it (taking contexts, cutting spans) read the same exchange.

Defined cases: a null text is empty; matches never cross documents; texts of under WIDTH bytes have none; equal rows are copies;
ids may be null, negative or repeat, in any share of the rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import groups_of, materialise, mix64, texts
from revspark.llm.suffix_sort import shared_windows

WIDTH = 200
GRAM = 64
HOT_TEXTS = 50_000
#: Contexts sorted at once (whole groups, or one group).
SORT_ROWS = 20_000

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POS_BITS = 20
_CHUNK = (1 << _POS_BITS) - 4096


class _Powers:
    """Powers of the hash's multiplier and of its inverse, as far as the longest text so far needs."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up = np.full(size, _STEP, dtype=np.uint64)
            cls.down = np.full(size, _BACK, dtype=np.uint64)
            cls.up[0] = cls.down[0] = 1
            np.cumprod(cls.up, out=cls.up)
            np.cumprod(cls.down, out=cls.down)
        return cls.up[:n], cls.down[:n]


def anchors(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, place, first window and last window of every anchor of a text."""
    none = np.zeros(0, dtype=np.int64)
    out = []
    for begin in range(0, len(text) - width + 1, _CHUNK):
        part = np.frombuffer(text, dtype=np.uint8)[begin:begin + _CHUNK + width - 1]
        out.append(_anchors(part, width, gram, begin))
    if not out:
        return none.astype(np.uint64), none, none, none
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(part: np.ndarray, width: int, gram: int, begin: int) -> tuple[np.ndarray, ...]:
    up, down = _Powers.upto(len(part) + 1)
    prefix = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=prefix[1:])
    n = len(part) - gram + 1
    hashes = mix64((prefix[gram:] - prefix[:n]) * down[:n])
    # hash and, for the last of equals, the place counted backwards
    mask = np.uint64((1 << _POS_BITS) - 1)
    key = (hashes & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    span = width - gram + 1
    windows = n - span + 1
    # sliding minimum: running minima of blocks from the left and from the right
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
    place = (mask - (least & mask)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [windows - 1]])
    at = place[first]
    return hashes[at], at + begin, first + begin, last + begin


_LONGS = T.ArrayType(T.LongType())


@F.arrow_udf(T.StructType([T.StructField("hashes", _LONGS), T.StructField("own", _LONGS)]))
def _gram_hashes(text: pa.Array) -> pa.Array:
    """Distinct anchor hashes of each text, and those it has more than once."""
    both, more, ends, more_ends = [], [], [0], [0]
    for t in texts(text):
        h, counts = np.unique(anchors(t)[0], return_counts=True)
        both.append(h.view(np.int64))
        more.append(h[counts > 1].view(np.int64))
        ends.append(ends[-1] + len(h))
        more_ends.append(more_ends[-1] + len(more[-1]))
    column = lambda x, e: pa.ListArray.from_arrays(
        pa.array(e, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64()))
    return pa.StructArray.from_arrays([column(both, ends), column(more, more_ends)], names=["hashes", "own"])


def _contexts_of(text: bytes, known: np.ndarray, hot: np.ndarray) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """(context id, group, context, left, windows, first window's start) of a text's anchors that can repeat."""
    h, at, first, last = anchors(text)
    for k in np.flatnonzero(np.isin(h, known)):
        a, p0, p1 = int(at[k]), int(first[k]), int(last[k])
        if len(hot) and h[k] in hot:
            for p in range(p0, p1 + 1):
                window = text[p:p + WIDTH]
                key = xxhash.xxh3_64_intdigest(window) ^ (a - p)
                yield _context_id(key, window, a - p, 1), key - (1 << 63), window, a - p, 1, p
        else:
            context = text[p0:p1 + WIDTH]
            key = int(h[k])
            yield _context_id(key, context, a - p0, p1 - p0 + 1), key - (1 << 63), context, a - p0, p1 - p0 + 1, p0


def _context_id(key: int, context: bytes, left: int, n: int) -> bytes:
    return xxhash.xxh3_128_digest(context + b"%d,%d,%d" % (key, left, n))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    known = batch.column("known").to_pylist()
    hot = batch.column("hot").to_pylist()
    for k, t in enumerate(texts(batch.column("text"))):
        yield k, t, np.array(known[k], dtype=np.int64).view(np.uint64), np.array(hot[k] or [], dtype=np.int64).view(np.uint64)


_CONTEXT = "grp long, id binary, context binary, lead int, n int, twice boolean"


def _take_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct contexts of each batch."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        held = 0
        for _, t, known, hot in _rows(batch):
            for cid, key, context, left, n, _ in _contexts_of(t, known, hot):
                if cid in seen:
                    seen[cid][4] = True
                else:
                    seen[cid] = [key, context, left, n, False]
                    held += len(context)
            if held > 32_000_000:
                yield _context_batch(seen)
                seen, held = {}, 0
        yield _context_batch(seen)


def _context_batch(seen: dict[bytes, list]) -> pa.RecordBatch:
    columns = list(zip(*((v[0], k, *v[1:]) for k, v in seen.items()), strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                      names=["grp", "id", "context", "lead", "n", "twice"])


def _take_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each text has each of its contexts."""
    for batch in batches:
        rows, ids, starts = [], [], []
        for k, t, known, hot in _rows(batch):
            own: dict[bytes, list[int]] = {}
            for cid, _, _, _, _, p in _contexts_of(t, known, hot):
                own.setdefault(cid, []).append(p)
            rows += [k] * len(own)
            ids += own.keys()
            starts += own.values()
        keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("did", "t1", "t2")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.binary()), pa.array(starts, pa.list_(pa.int32()))],
                                         names=["did", "t1", "t2", "id", "starts"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, first, last) of contexts that have repeated windows; the rows come sorted by group and id."""
    held: list[tuple] = []

    def result() -> pa.RecordBatch:
        group = np.cumsum([k > 0 and held[k][0] != held[k - 1][0] for k in range(len(held))])
        first, last = shared_windows([x[2] for x in held], np.array([x[3] for x in held], dtype=np.int64),
                                     np.array([x[4] for x in held], dtype=np.int64), np.array([x[5] for x in held], dtype=bool),
                                     np.asarray(group, dtype=np.int64), WIDTH)
        hit = np.flatnonzero(last >= 0)
        return pa.RecordBatch.from_arrays([pa.array([held[k][1] for k in hit], pa.binary()), pa.array(first[hit], pa.int32()),
                                           pa.array(last[hit], pa.int32())], names=["id", "first", "last"])

    for group in groups_of(batches, "grp"):
        for part in group.to_batches(max_chunksize=10_000):
            for row in zip(*(part.column(c).to_pylist() for c in ("grp", "id", "context", "lead", "n", "twice")), strict=True):
                if held and held[-1][1] == row[1]:
                    held[-1] = (*row[:5], True)
                    continue
                if len(held) >= SORT_ROWS and held[-1][0] != row[0]:
                    yield result()
                    held = []
                held.append(row)
    if held:
        yield result()


_CUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                     T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
                     T.StructField("spans", T.ArrayType(_LONGS))])


def _cutter(keep: bool):
    """Cut ranges out of texts; `keep` also returns the remaining bytes and the spans."""

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts(text), ranges.to_pylist(), strict=True):
            if own is None:
                out.append(None)
                continue
            spans: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in own):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            edges = [0, *(x for s in spans for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append({"n_removed": len(t) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                        "kept": kept if keep else None, "spans": spans if keep else None})
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                                        ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))]))

    return cut


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def dedup(docs: DataFrame, keep: bool = False, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `keep` also the remaining bytes `kept`
    and `spans` ([start, end) in bytes)."""
    text = F.coalesce("text", F.lit(""))
    # rows without an id are told apart by their texts; whether a row has one is carried beside
    rows = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64(text)).alias("did"), *_text_key(text), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.col("doc_id").isNotNull().alias("named"))
    keys = ["did", "t1", "t2"]
    long = rows.where(F.col("n_bytes") >= WIDTH)

    # one row for each distinct text
    grams = long.select(*keys, "named", _gram_hashes("text").alias("g"))
    firsts = materialise(grams.groupBy("t1", "t2").agg(
        F.min("did").alias("did"), F.first("named").alias("named"), F.count(F.lit(1)).alias("copies"), F.first("g.hashes").alias("hashes"),
        F.first("g.own").alias("own")), "grams")
    each = firsts.select("did", "t1", F.explode("hashes").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    known = each.join(counts, "h").groupBy("did", "t1").agg(  # of one text
        F.collect_list("h").alias("found"), F.collect_list(F.when(F.col("c") > hot_texts, F.col("h"))).alias("hot"))
    nothing = F.expr("cast(array() as array<bigint>)")
    lists = firsts.select(*keys, "own").join(known, ["did", "t1"], "left").select(
        *keys, F.array_union("own", F.coalesce("found", nothing)).alias("known"), F.coalesce("hot", nothing).alias("hot"))
    lists = materialise(lists.where(F.size("known") > 0), "repeated")

    # both joins with the texts read one exchange
    source = long.select(*keys, "text")
    held = source.join(lists.hint("shuffle_merge"), keys).select(*keys, "text", "known", "hot")
    found = (held.mapInArrow(_take_contexts, _CONTEXT).repartition("grp").sortWithinPartitions("grp", "id")
             .mapInArrow(_sort_groups, "id binary, first int, last int"))
    places = held.mapInArrow(_take_places, "did long, t1 long, t2 long, id binary, starts array<int>")
    ranges = places.join(found, "id").select(*keys, F.explode("starts").alias("p"), "first", "last").select(
        *keys, F.struct((F.col("p") + F.col("first")).cast("long").alias("a"),
                        (F.col("p") + F.col("last") + WIDTH).cast("long").alias("b")).alias("r"))
    spans = ranges.groupBy(*keys).agg(F.collect_list("r").alias("ranges"))  # those of one text

    single = firsts.where("copies = 1").select(*keys, "named")
    cut = (source.join(single.hint("shuffle_merge"), keys).join(spans.hint("shuffle_merge"), keys, "left")
           .withColumn("x", _cutter(keep)(F.when(F.col("ranges").isNotNull(), F.col("text")), "ranges")))
    own_id = F.when(F.col("named"), F.col("did"))
    size = F.octet_length("text").cast("long")
    extra = lambda kept, spans: [kept.alias("kept"), spans.alias("spans")] if keep else []
    no_spans = F.expr("cast(array() as array<array<bigint>>)")
    cut = cut.select(
        own_id.alias("doc_id"), size.alias("n_bytes"), F.coalesce("x.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("x.n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("x.kept_sha256", F.sha2("text", 256)).alias("kept_sha256"),
        *extra(F.coalesce("x.kept", F.encode("text", "UTF-8")), F.coalesce("x.spans", no_spans)))
    whole = long.select("doc_id", "t1", "t2", "n_bytes").join(firsts.where("copies > 1").select("t1", "t2"), ["t1", "t2"])
    whole = whole.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                         F.sha2(F.lit(""), 256).alias("kept_sha256"),
                         *extra(F.lit(b""), F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))))
    short = rows.where(F.col("n_bytes") < WIDTH).select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *extra(F.encode("text", "UTF-8"), no_spans))
    return cut.union(whole).union(short)
