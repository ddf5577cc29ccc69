"""Substring deduplication by super-k-mers against plain Python."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from revspark.llm import super_kmers
from revspark.llm.word_hashes import hash_filter, hash_words, passes, word_edges

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def report(docs, **kw):
    return [tuple(r) for r in super_kmers.substring_dedup(docs, **kw).select(*COLUMNS).collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_matches_brute_force(docs, doc_rows, hot):
    want = brute.shared_windows(doc_rows)
    assert ordered(report(docs, hot_rows=hot)) == ordered(want)
    assert sum(w[2] > 0 for w in want) == 3


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    """Texts of shared pieces over a tiny vocabulary, with ids that repeat, are negative or null."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "b\u00a0c", "x1", "Yy"])
    pieces = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for _ in range(40):
        words = [w for _ in range(rng.randrange(4)) for w in rng.choice(pieces)] + [word() for _ in range(rng.randrange(6))]
        rows.append((rng.choice([None, -1, *range(-3, 30)]), rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    for hot in (20_000, 2):
        assert ordered(report(frame(spark, rows), hot_rows=hot)) == ordered(brute.shared_windows(rows))


def test_a_third_of_the_rows_share_one_id_text_or_null(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(1000)) for _ in range(60))
    other = " ".join(str(rng.randrange(1000)) for _ in range(20))
    rows = [(k, text) for k in range(100)] + [(None, text)] * 50 + [(7, f"{k} {other} {k}") for k in range(100)] + [(200, other)]
    assert ordered(report(frame(spark, rows))) == ordered(brute.shared_windows(rows))


def test_a_very_long_text_of_one_word(spark):
    rows = [(1, "the " * 30_000), (2, "a " + "the " * 20 + "b"), (3, "word" * 50_000)]
    assert ordered(report(frame(spark, rows))) == ordered(brute.shared_windows(rows))


def test_kept_words_and_spans(docs, doc_rows):
    rows = super_kmers.substring_dedup(docs, keep=True).collect()
    assert ordered((r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in rows) == ordered(brute.shared_windows(doc_rows))
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in rows)


def test_nothing(no_docs):
    assert report(no_docs) == []


def test_no_window_is_longer_than_its_text(spark):
    rows = [(1, " ".join(map(str, range(12)))), (2, " ".join(map(str, range(12)))), (3, " ".join(map(str, range(13))))]
    assert {r[2] for r in report(frame(spark, rows))} == {0}


def test_filter_lets_every_entry_pass(spark):
    ids = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    table = hash_filter(ids, "h").value
    own = np.array([r["h"] for r in ids.collect()], dtype=np.int64).view(np.uint64)
    assert passes(table, own).all()
    assert passes(table, ~own).mean() < 0.2
    assert not passes(hash_filter(ids.limit(0), "h").value, own).any()


def test_equal_words_hash_alike():
    block = np.frombuffer(b"one two one " + b"x" * 100_000 + b" two", dtype=np.uint8)
    starts, ends = word_edges(block != 0x20)
    h = hash_words(block, starts, ends)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
