r"""N-gram Jaccard join: links between documents whose sets of 3-word shingles are at least 90 % alike, as components.

1. Every text becomes its set of hashed shingles; equal sets are one class from here on.
2. Candidates. Linked sets of at most U shingles each differ in at most d = floor(U * 2 * (100 - P) / (100 + P)) of them. If hashes
   are dealt into d + 1 parts, one part at least is equal in both sets. So each set emits a key for each part (a hash of the
   part's whole content) for the size band it is in, and for the next band up if a larger partner may lie there; linked
   sets share a key. A part can be empty; sets with an empty part also emit keys of another dealing (up to the last of
   `DEALINGS`, where empty parts are keys too). Sets that share a key are tied to the first of them, within each
   batch of documents before the shuffle and then among what is left of the batches; the ties' components are the groups
   in which all links lie.
3. Links. Groups are joined by signature trees (`signature_tree`) on the sets themselves. A group of more than `BLOCK`
   classes is dealt into blocks that all also hold two of the group's classes as pivots; what is then not in the group's
   largest component meets every block once more. So no task holds more than two blocks' sets, and no link is lost.
4. Components of the links give each document the smallest doc_id that it reaches.

Defined cases: null texts, empty ones and those without words have no shingles and are linked with nothing; equal rows
are copies like others; a null doc_id never is the smallest; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import groups_of, materialise, mix64, texts
from revspark.llm.components import components
from revspark.llm.signature_tree import linked

SHINGLE = 3
PERCENT = 90
BLOCK = 2000
BAND_RATIO = 1.5
DEALINGS = 6
SALTS = 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                dtype=np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer words has one, its whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix64(total * _ODD[4] + h[k:k + len(total)] * _ODD[k])
    return np.unique(total)


def band_tops(largest: int) -> list[int]:
    """Upper ends of the size bands up to the one that holds `largest`."""
    tops = [9]
    while tops[-1] < largest:
        tops.append(int(tops[-1] * BAND_RATIO))
    return tops


def part_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set, of which linked sets share at least one."""
    n = len(hashes)
    tops = band_tops(100 * n // percent)
    keys = []
    for band, top in enumerate(tops):
        if top < n:
            continue  # the bands of n and of its largest partner are what is left
        parts = 2 * top * (100 - percent) // (100 + percent) + 1
        for dealing in range(DEALINGS):
            salt = mix64(np.array([band * DEALINGS + dealing + 1], dtype=np.uint64) * _ODD[0])[0]
            h = mix64(hashes ^ salt)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange(parts))
            content = np.zeros(n + 1, dtype=np.uint64)  # the last one stands for "nothing before"
            np.cumsum(mix64(h[order] + _ODD[1]), out=content[:-1])
            ends = np.append(first[1:], n)
            total = content[ends - 1] - np.where(first > 0, content[first - 1], np.uint64(0))
            empty = ends == first
            key = mix64((total + np.arange(1, parts + 1).astype(np.uint64) * _ODD[2]) ^ salt)
            last = dealing == DEALINGS - 1
            if last:
                key[empty] = mix64((np.flatnonzero(empty) + 1).astype(np.uint64) * _ODD[3] ^ salt)
                keys.append(key)
            else:
                keys.append(key[~empty])
            if not empty.any():
                break
    return np.concatenate(keys)


def _id(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sign(percent: int):
    """A row for each document: its set's size and id, the keys that no set before it in the batch has, and for the
    others the sets that have them. So a key goes to the shuffle once a batch, however many sets share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, cids, sizes, keys = [], [], [], [], [np.zeros(0, dtype=np.int64)]
            for t in texts(batch.column("text")):
                s = shingle_set(t)
                n.append(len(s))
                ids.append(_id(s))
                own = part_keys(s, percent).view(np.int64) if len(s) else keys[0]
                cids.append(int.from_bytes(ids[-1][:8], "little", signed=True) if len(s) else None)
                sizes.append(len(own))
                keys.append(own)
            every = np.concatenate(keys)
            holder = np.repeat(np.arange(len(n)), sizes)
            _, first, which = np.unique(every, return_index=True, return_inverse=True)
            fresh = np.zeros(len(every), dtype=bool)
            fresh[first] = True
            pairs = np.unique(np.stack([holder[~fresh], holder[first][which[~fresh]]]), axis=1)
            known = pa.array(cids, pa.int64())
            column = lambda at, values: pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(n)))]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), known,
                 column(holder[fresh], pa.array(every[fresh], pa.int64())), column(pairs[0], known.take(pa.array(pairs[1], pa.int64())))],
                names=["doc_id", "n", "set_id", "cid", "keys", "peers"])

    return run


@F.arrow_udf(T.BinaryType())
def set_id(text: pa.Array) -> pa.Array:
    return pa.array([_id(shingle_set(t)) for t in texts(text)], pa.binary())


def _join_groups(percent: int):
    """Links inside each task's classes: (a, b) for every class, b the label of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "task"):
            task = group.column("task").to_numpy()
            cut = np.flatnonzero(np.diff(task)) + 1
            a, b = [], []
            for lo, hi in zip([0, *cut], [*cut, len(task)], strict=True):
                part = group.slice(lo, hi - lo)
                ids = part.column("set_id").to_pylist()
                first = {}
                for k, x in enumerate(ids):
                    first.setdefault(x, k)
                rows = sorted(first.values())
                known = part.column("label").to_pylist()
                spot, labels = {}, []
                for k, r in enumerate(rows):
                    labels.append(spot.setdefault(known[r], k) if known[r] is not None else k)
                column = part.column("text")
                sets = [shingle_set(t) for t in texts(column.take(pa.array(rows)))]
                got = linked(sets, percent, np.array(labels))
                a += [ids[r] for r in rows]
                b += [ids[rows[g]] for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _links(members: DataFrame, percent: int) -> DataFrame:
    """members: (task, set_id, label, text)."""
    dealt = members.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_join_groups(percent), "a binary, b binary")


def near_classes(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, n, set_id) of every document; classes (set_id, component_id) of every set."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialise(docs.select("doc_id", "text").mapInArrow(
        _sign(percent), f"doc_id {kind}, n long, set_id binary, cid long, keys array<bigint>, peers array<bigint>"), "shingles")
    rows = signed.select("doc_id", "n", "set_id")

    # the sets with a key are tied to the first of them; one exchange of the keys
    keyed = signed.select("cid", F.explode("keys").alias("key"))
    stars = keyed.select(F.col("cid").alias("a"), F.first("cid").over(Window.partitionBy("key").orderBy("cid")).alias("b"))
    ties = stars.union(signed.select(F.col("cid").alias("a"), F.explode("peers").alias("b"))).where("a != b").distinct()
    groups = components(ties)

    firsts = signed.where("n > 0").groupBy("set_id", "cid").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialise(firsts.join(groups, firsts.cid == groups.node, "left").select("set_id", "doc_id", F.col("root").alias("grp")),
                         "classes")
    sizes = firsts.where(F.col("grp").isNotNull()).groupBy("grp").agg(
        F.count(F.lit(1)).alias("size"), F.min("set_id").alias("p0"), F.max("set_id").alias("p1")).where("size > 1")
    # a group's classes meet its size in SALTS tasks
    salt = F.pmod(F.xxhash64("set_id", F.lit(3)), F.lit(SALTS)).cast("int")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = firsts.withColumn("salt", salt).join(sizes, ["grp", "salt"]).drop("salt").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    inside = materialise(inside, "groups")
    t = docs.select("doc_id", "text")
    want = inside.select("grp", "set_id", "block", "blocks", F.col("doc_id").alias("d"),
                         F.col("set_id").isin(F.col("p0"), F.col("p1")).alias("pivot"))

    def with_text(chosen: DataFrame) -> DataFrame:
        # ids can be given twice with different texts: the text must have the set
        found = t.join(chosen.hint("shuffle_merge"), t.doc_id.eqNullSafe(chosen.d))
        return found.where(set_id("text") == F.col("set_id"))

    home = F.when(F.col("pivot") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    members = with_text(want).select("grp", "set_id", "text", F.explode(home).alias("at"))
    members = members.select(F.xxhash64("grp", "at").alias("task"), "set_id", F.lit(None).cast("binary").alias("label"), "text")
    found = materialise(_links(members, percent), "links")

    large = want.where("blocks > 1")
    if not large.isEmpty():
        found = materialise(found.union(_rest(found, large, with_text, percent, block)), "links")
    reach = components(found)
    classes = firsts.join(reach, firsts.set_id == reach.node, "left").select(
        "set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, classes.join(least, "root").select("set_id", "component_id")


def _rest(found: DataFrame, large: DataFrame, with_text, percent: int, block: int) -> DataFrame:
    """Links of what is outside its group's largest component, to every block of the group."""
    reach = components(found)
    lab = large.join(reach, large.set_id == reach.node, "left").select(
        "grp", "set_id", "d", "block", "blocks", F.coalesce("root", "set_id").alias("label"))
    lab = materialise(lab, "labels")
    main = lab.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"))
    loose = lab.join(main, "grp").where("label != main").drop("main")
    chunks = loose.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    # a block's classes go to each chunk of loose ones, a chunk's loose ones to each block
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    settled = lab.join(chunks, "grp").select("set_id", "d", "label", "grp", "block", spread(F.col("chunks")).alias("chunk"))
    moved = loose.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("chunks")).cast("int"))
    moved = moved.select("set_id", "d", "label", "grp", spread(F.col("blocks")).alias("block"), "chunk")
    both = settled.union(moved.select(*settled.columns)).withColumn("task", F.xxhash64("grp", "block", "chunk"))
    return _links(with_text(both).select("task", "set_id", "label", "text"), percent)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id."""
    rows, classes = near_classes(docs.select("doc_id", "text"), percent, block)
    out = rows.join(classes, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id; columns unchanged. Documents without
    shingles all stay."""
    rows, classes = near_classes(docs.select("doc_id", "text"), percent, block)
    stay = rows.where("n > 0").join(classes, "set_id").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("__d"), F.col("set_id").alias("__s")).distinct()
    own = docs.withColumn("__set", set_id("text"))
    kept = own.where(F.col("__set").isNotNull()).join(
        stay, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__set") == F.col("__s")))
    kept = kept.dropDuplicates(["__d", "__s"])  # rows given twice; dealt by these columns already
    return kept.select(*docs.columns).union(own.where(F.col("__set").isNull()).select(*docs.columns))
