"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from revspark.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, score double"


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        longer = [c for (x, q), c in f.items() if x == lang and len(q) > len(p) and c >= least
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * c >= 80 * a for c in longer):
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    ranked = []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


def got(spark, rows, **kw):
    table = spark.createDataFrame([(k, t, lang, "x", 0.5) for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in co.collocations(table, **kw).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = ["the", "of", "New", "york", "city", "é", "a b", "x\x01y", "THE", "z"]
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(["new York city hall", "of the", *words]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0c"]))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return [*rows, ("en", None), ("en", ""), ("de", " \n"), ("en", "the " * 3000), *[("fr", "one two three four five")] * 40]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 25)])
def test_matches_plain_python(spark, corpus, least, top):
    want = sorted(plain(corpus, least, top))
    assert got(spark, corpus, least=least, top=top) == want and len(want) >= 10


def test_ranges_borrow_their_first_words(spark, corpus):
    """As many ranges as there are partitions: first words stand in earlier ranges."""
    rows = [("en", w.split(), 9 - len(w.split())) for w in ("a", "a b", "a b c", "a b c d", "a b d", "a c", "a c d", "b", "b a")]
    table = spark.createDataFrame(rows, "lang string, words array<string>, a long")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = {" ".join(r["words"]): (r["parts"], r["extension"]) for r in co.ordered_pass(table, "order").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == {"a": ([], 7), "a b": ([8], 6), "a b c": ([8, 7], 5), "a b c d": ([8, 7, 6], 0), "a b d": ([8, 7], 0), "a c": ([8], 6),
                   "a c d": ([8, 7], 0), "b": ([], 7), "b a": ([8], 0)}


def test_scores_beyond_64_bits(spark, corpus):
    """Counts whose products pass 64 bits."""
    big = 5_000_000_000_000
    cut = spark.range(1).select(F.expr(f"(cast({co.SCALE} as decimal(38, 0)) * {big}L) div (cast({big}L as decimal(38, 0)) + {big + 1}L)"))
    assert cut.first()[0] == 2_000_000 * big // (2 * big + 1)


def test_nothing(spark, no_docs):
    assert co.collocations(no_docs).collect() == [] and got(spark, [("en", "a b")]) == []
