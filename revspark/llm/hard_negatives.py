"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score lies
between two shares of the positive's.

Scores are exact integers from matrix products modulo small primes (`rns`). Anchors are the query set: they are dealt into tiles of
about TILE rows, and the rows into shares of at most about ROWS. A task gets the anchors of a tile first and then streams
its share of the rows past them, block by block; it keeps the first rows of each anchor only, and a window over what the shares of an
anchor return takes the first of all. No vector table is broadcast, gathered or held by a task.

1. Positives: tiles and shares are dealt by label, as only rows of the anchor's label count; a label with many rows has as many shares
   more.
2. Negatives: every tile meets every share; a row counts for a positive if its label differs and its score lies in the positive's
   window.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of different lengths are
filled up with zeros, an empty vector scores 0; a null vec_id is no anchor, its label stays, and it comes last among ties; rows with
the same vec_id are different rows, each an anchor of its own; ties go by vec_id; anchors without positives, and positives without
negatives, give no row; an empty table gives an empty result; other columns are not read. Scores must fit a long: an error is
raised for vectors so long that they might not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revspark.llm.common import materialise
from revspark.llm.rns import primes, products, residues

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH percent of the positive's.
LOW, HIGH = 30, 90
TILE = 16_384
ROWS = 4_000_000
#: A share has about so many rows at least: every share returns its own first rows of each anchor.
LEAST_ROWS = 1_000
SCALE = 256
LABELS = 10
#: Scores looked at together.
_BLOCK = 1_000_000
_HELD = 1_000_000
_LARGEST = 1 << 58


def _prepared(vectors: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """The rows that take part, numbered and written once; their number; the moduli that their scores need."""
    odd = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.col("label").cast("long")
    rows = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), label.alias("label"))
            .where(F.col("embedding").isNotNull() & F.col("label").isNotNull()).where(f"not {odd}")
            .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                    F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
                    "embedding"))
    table = materialise(rows, "vectors")
    norm = F.expr(f"aggregate(embedding, 0D, (s, x) -> s + pow(cast(floor({SCALE} * x) as double), 2))")
    n, most = table.agg(F.count(F.lit(1)), F.max(norm)).first()
    bound = (most or 0.0) * 1.000001 + 1
    if bound >= _LARGEST:
        raise ArithmeticError(f"scores of up to {bound:.3g} may not fit a long")
    return table, n, primes(int(bound))


def _matrix(column: pa.Array) -> np.ndarray:
    ends = column.offsets.to_numpy()
    values = np.floor(SCALE * column.values.to_numpy()[ends[0]:ends[-1]])
    lengths = np.diff(ends)
    depth = int(lengths.max(initial=0))
    if len(lengths) and lengths.min() == depth:
        return values.reshape(len(lengths), depth)
    out = np.zeros((len(lengths), depth))
    out[np.arange(depth) < lengths[:, None]] = values
    return out


class _Rows:
    """Rows in the order of their ids, nulls last."""

    def __init__(self, batch: pa.RecordBatch, moduli: list[int]):
        unknown = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").fill_null(0).to_numpy()
        order = np.lexsort((ids, unknown))
        self.unknown, self.ids = unknown[order], ids[order]
        self.row = batch.column("row").to_numpy()[order]
        self.label = batch.column("label").to_numpy()[order]
        self.residues = residues(_matrix(batch.column("embedding").take(pa.array(order))), moduli)


class _Anchors:
    def __init__(self, parts: list[pa.RecordBatch], moduli: list[int]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.row = table.column("row").to_numpy()
        self.label = table.column("label").to_numpy()
        self.windows = [x or [] for x in table.column("windows").to_pylist()]
        self.residues = residues(_matrix(table.column("embedding").chunk(0)), moduli)


def _first(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the n largest entries of each line that are not negative; no two of a line are equal."""
    if key.shape[1] > n:
        column = np.argpartition(key, key.shape[1] - n, axis=1)[:, -n:]
    else:
        column = np.broadcast_to(np.arange(key.shape[1]), key.shape)
    keep = np.take_along_axis(key, column, axis=1) >= 0
    line = np.nonzero(keep)[0]
    return line, column[keep]


def _ranked(score: np.ndarray) -> np.ndarray:
    """Numbers that order the entries of a line by score, then by column: the larger the earlier."""
    low, width = int(score.min()), score.shape[1]
    if (int(score.max()) - low + 1) * width >= 1 << 62:
        level = np.unique(score, return_inverse=True)[1].reshape(score.shape)
    else:
        level = score - low
    return level * width + np.arange(width - 1, -1, -1)


class _Best:
    """The first n candidates of each (anchor, slot)."""

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        """anchor, slot, score, unknown, id, row"""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > _HELD:
            self.parts = [self.taken()]
            self.size = len(self.parts[0][0])

    def taken(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        anchor, slot, score, unknown, ids, row = columns
        order = np.lexsort((row, ids, unknown, -score, slot, anchor))
        group = np.ones(len(order), dtype=bool)
        group[1:] = (np.diff(anchor[order]) != 0) | (np.diff(slot[order]) != 0)
        begin = np.flatnonzero(group)
        within = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        keep = order[within < self.n]
        return tuple(c[keep] for c in columns)


def _nearest(anchors: _Anchors, rows: _Rows, at: slice, score: np.ndarray, best: _Best) -> None:
    """Positives: rows other than the anchor itself."""
    key = _ranked(score)
    key[anchors.row[at, None] == rows.row] = -1
    line, column = _first(key, best.n)
    best.add(line + at.start, np.zeros(len(line), dtype=np.int64), score[line, column], rows.unknown[column], rows.ids[column],
             rows.row[column])


def _within(anchors: _Anchors, rows: _Rows, at: slice, score: np.ndarray, best: _Best) -> None:
    """Negatives: rows of another label within the windows of the anchor's positives."""
    ranked = _ranked(score)
    other = anchors.label[at, None] != rows.label
    windows = anchors.windows[at]
    for slot in range(max(map(len, windows), default=0)):
        low = np.array([w[slot]["low"] if len(w) > slot else 1 for w in windows])
        high = np.array([w[slot]["high"] if len(w) > slot else 0 for w in windows])
        key = np.where(other & (score >= low[:, None]) & (score <= high[:, None]), ranked, -1)
        line, column = _first(key, best.n)
        best.add(line + at.start, np.full(len(line), slot, dtype=np.int64), score[line, column], rows.unknown[column],
                 rows.ids[column], rows.row[column])


_FOUND = "anchor long, slot long, score long, unknown boolean, id long, row long"


def _selector(moduli: list[int], choose: Callable, n: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, the anchors of a group before its rows."""
        group, parts, anchors, best = None, [], None, _Best(n)

        def result() -> pa.RecordBatch:
            anchor, slot, score, unknown, ids, row = best.taken()
            return pa.RecordBatch.from_arrays(
                [pa.array(anchors.row[anchor]), pa.array(slot), pa.array(score), pa.array(unknown),
                 pa.array(ids, mask=unknown), pa.array(row)], names=["anchor", "slot", "score", "unknown", "id", "row"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("own", "tile", "share", "kind")])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1 if batch.num_rows else np.zeros(0, dtype=np.int64)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                run, key = batch.slice(a, b - a), tuple(keys[:3, a])
                if key != group:
                    if best.size:
                        yield result()
                    group, parts, anchors, best = key, [], None, _Best(n)
                if keys[3, a] == 0:
                    parts.append(run)
                    continue
                if not parts:
                    continue
                anchors = anchors or _Anchors(parts, moduli)
                rows = _Rows(run, moduli)
                step = max(1, _BLOCK // len(rows.row))
                for k in range(0, len(anchors.row), step):
                    at = slice(k, min(k + step, len(anchors.row)))
                    choose(anchors, rows, at, products([x[at] for x in anchors.residues], rows.residues, moduli), best)
        if best.size:
            yield result()

    return select


def _meet(anchors: DataFrame, rows: DataFrame, select) -> DataFrame:
    """Candidates from every group (own, tile, share): its anchors, then its rows."""
    group = ["own", "tile", "share"]
    columns = [*group, "kind", "row", "vec_id", "label", "embedding", "windows"]
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    both = (anchors.withColumn("kind", F.lit(0)).select(*columns)
            .union(rows.withColumn("kind", F.lit(1)).withColumn("windows", none).select(*columns)))
    return both.repartition(*group).sortWithinPartitions(*group, "kind").mapInArrow(select, _FOUND)


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, tile: int = TILE, share: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank); anchors are rows whose vec_id
    is divisible by `every`."""
    table, total, moduli = _prepared(vectors)
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_anchor = F.col("vec_id") % every == 0
    deal = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{n} - 1")))
    spread = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.expr(n))
    no_windows = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")

    sizes = (table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("m")).where("m > 0")
             .select("label", F.expr(f"cast(ceil(m / {tile}) as bigint)").alias("tiles"),
                     F.expr(f"cast(greatest(ceil(n / {share}), least(ceil({tasks} * (n / {max(total, 1)})), floor(n / {LEAST_ROWS})), 1) as bigint)").alias("shares")))
    near = table.where(is_anchor).join(sizes, "label").select(
        F.col("label").alias("own"), spread("tile", "tiles").alias("tile"), deal("shares").alias("share"), "row", "vec_id", "label",
        "embedding", no_windows.alias("windows"))
    own = table.join(sizes, "label").select(
        F.col("label").alias("own"), deal("tiles").alias("tile"), spread("share", "shares").alias("share"), "row", "vec_id", "label",
        "embedding")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "unknown", "id", "row")
    positives = materialise(
        _meet(near, own, _selector(moduli, _nearest, n_positives)).withColumn("slot", F.row_number().over(first).cast("long"))
        .where(F.col("slot") <= n_positives).select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives")

    # low * p <= 100 * s <= high * p, for whole s
    window = F.struct(F.expr(f"cast(ceil({low} * cast(positive_score as decimal(38, 0)) / 100) as bigint)").alias("low"),
                      F.expr(f"cast(floor({high} * cast(positive_score as decimal(38, 0)) / 100) as bigint)").alias("high"))
    windows = (positives.groupBy(F.col("anchor").alias("row"))
               .agg(F.array_sort(F.collect_list(F.struct("slot", window.alias("w")))).alias("w"))  # n_positives entries at most
               .select("row", F.transform("w", lambda x: x["w"]).alias("windows")))
    tiles = max(1, -(-table.where(is_anchor).count() // tile))
    shares = max(1, -(-total // share), min(-(-tasks // tiles), total // LEAST_ROWS))
    asked = table.where(is_anchor).join(windows, "row").select(
        F.lit(0).cast("long").alias("own"), spread("tile", f"{tiles}L").alias("tile"), deal(f"{shares}L").alias("share"), "row", "vec_id",
        "label", "embedding", "windows")
    others = table.select(F.lit(0).cast("long").alias("own"), deal(f"{tiles}L").alias("tile"), spread("share", f"{shares}L").alias("share"),
                          "row", "vec_id", "label", "embedding")
    hardest = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "unknown", "id", "row")
    found = (_meet(asked, others, _selector(moduli, _within, n_negatives)).withColumn("slot", F.col("slot") + 1)
             .withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= n_negatives))
    anchors = table.where(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (found.join(positives, ["anchor", "slot"]).join(anchors, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"), F.col("slot").alias("positive_rank")))
