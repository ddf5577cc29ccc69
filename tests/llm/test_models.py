"""Toxicity, mixing, the pipeline and the registry."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revspark.llm import ftrl, mixing
from revspark.llm.components import components
from revspark.llm.mixing import GRID, TARGETS, label_domains, mix, mixing_report, rate_history, rates, to_grid
from revspark.llm.queries import Q, SQL
from revspark.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    """Documents of common words; the toxic ones hold one or two of a few words."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(700):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = k % 6 == 0
        for _ in range(bad * rng.randrange(1, 3)):
            t.insert(rng.randrange(len(t)), rng.choice(["Vile", "rotten", "scum"]))
        rows.append((k, " ".join(t), "en", "s", 0.5))
        labels.append((k, 1, int(bad)))
    rows += [(None, "vile scum", None, None, None), (1000, None, "en", "s", 0.1), (1001, "", "en", "s", 0.1), (5, "w1 w2", "en", "s", 0.1)]
    labels += [(None, 1, 1), (3, 1, None), (6, 1, 0), (6, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(toxic):
    docs, labels = toxic
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == is_held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], r["doc_id"] % 6 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 700]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_read(toxic):
    docs, labels = toxic
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0,
                                                1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((str(r["doc_id"]), r["score"]) for r in df.collect())
    assert key(toxicity(docs, labels)) == key(toxicity(docs.withColumn("lang", F.lit("zz")), flipped))


def test_toxicity_without_labels(toxic):
    docs, labels = toxic
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in toxicity(docs, labels.limit(0)).collect())
    assert toxicity(docs.limit(0), labels).collect() == []


def test_weights_are_sparse():
    rng = random.Random(4)
    model = ftrl.Ftrl()
    for _ in range(6):
        for k in range(400):
            words = [b"%d" % rng.randrange(5000) for _ in range(30)] + [b"bad"] * (k % 3 == 0)
            model.learn(np.append(ftrl.gram_features(words), 1 << ftrl.BITS), float(k % 3 == 0))
    w = model.weights(np.arange(len(model.z)))
    assert 0 < (w != 0).sum() < 300
    assert w[ftrl.gram_features([b"bad"])[0]] == w[:-1].max() > 0


# ---- mixing

def test_rates_meet_targets(spark, toxic):
    docs, labels = toxic
    out = mix(docs, label_domains(labels), {"clean": 0.7, "toxic": 0.3}, budget=0.4, steps=80).collect()
    total = sum(r["n_tokens"] for r in out)
    assert len(out) == docs.count() and all(r["rate"] >= 0 for r in out) and {"text", "lang", "score"} <= set(out[0].asDict())
    for d, share in (("clean", 0.7), ("toxic", 0.3)):
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in out) / total - 0.4 * share) < 2e-3


def test_steps_match_gradient_descent_on_documents(spark):
    """The rates after the steps are those of scaled projected gradient descent with a rate a document, in plain numpy."""
    rng = np.random.default_rng(1)
    p = np.array([to_grid(list(x)) for x in rng.dirichlet([0.3, 0.3, 0.3], 200)]) / GRID
    tokens = rng.integers(1, 500, 200).astype(float)
    targets = [0.5, 0.3, 0.2]
    history = rate_history(_cells(spark, p, tokens), targets, steps=25, budget=0.5, tolerance=0.0)
    aim = np.array(targets) * 0.5
    mass = tokens @ p / tokens.sum()
    r = y = np.full(200, 0.5)
    t = 1.0
    for k in range(25):
        g = ((y * tokens) @ p / tokens.sum() - aim) / mass
        assert np.allclose(g, history[k], atol=1e-9)
        fresh = np.maximum(0, y - (p @ g + mixing.PULL * (y - 0.5)) / (1 + mixing.PULL))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, r, t = fresh + (t - 1) / after * (fresh - r), fresh, after
    assert np.allclose(rates(p, history, 0.5), r)


def _cells(spark, p, tokens):
    return spark.createDataFrame([([int(round(v * GRID)) for v in a], int(t)) for a, t in zip(p, tokens, strict=True)],
                                 "p array<int>, tokens long").groupBy("p").agg(F.sum("tokens").alias("tokens"))


@pytest.mark.parametrize("share", [1e-3, 1e-4])
def test_rare_domains_meet_their_targets(spark, share):
    """Production settings; the last domain has `share` of the tokens, hard posteriors and softer ones."""
    aim = np.array([0.92, 0.06, 0.02]) * mixing.BUDGET
    for soft in (0, 25):
        p = np.array([[GRID - soft, soft, 0], [2 * soft, GRID - 2 * soft, 0], [soft, 0, GRID - soft]]) / GRID
        tokens = np.array([0.9 - share, 0.1, share]) * 1e7
        history = rate_history(_cells(spark, p, tokens), [0.92, 0.06, 0.02])
        got = (rates(p, history, mixing.BUDGET) * tokens) @ p / tokens.sum()
        assert len(history) <= mixing.STEPS and np.allclose(got, aim, rtol=0.01)


def test_targets_that_cannot_be_met_are_reported(spark, toxic):
    cells = _cells(spark, np.array([[1.0, 0.0], [0.9, 0.1]]), np.array([100.0, 200.0]))
    with pytest.warns(UserWarning, match=r"\[2\]"):
        rate_history(cells.select(F.concat("p", F.array(F.lit(0))).alias("p"), "tokens"), [0.9, 0.05, 0.05], steps=30)
    docs, labels = toxic
    targets = {"clean": 0.7, "toxic": 0.3}
    out = {r["domain"]: r for r in mixing.expected_tokens(mix(docs, label_domains(labels), targets), targets).collect()}
    assert set(out) == set(targets) and all(r["met"] for r in out.values())
    # without labels all posteriors are even: both domains get half, whatever the rates
    out = mixing.expected_tokens(mix(docs, label_domains(labels.limit(0)), targets, steps=5), targets).collect()
    assert not any(r["met"] for r in out)


def test_grid_adds_up():
    rng = random.Random(1)
    for _ in range(200):
        got = to_grid([rng.random() ** 4 for _ in range(rng.randrange(1, 6))])
        assert sum(got) == GRID and min(got) >= 0
    assert sum(to_grid([0.0, 0.0, 0.0])) == GRID


def test_mixing_edge_cases(spark, toxic):
    docs, labels = toxic
    none = mix(docs, label_domains(labels.limit(0)), TARGETS, steps=3).collect()
    assert len(none) == docs.count() and all(abs(r["p_clean"] - 1 / 3) < 0.01 for r in none)
    assert mix(docs.limit(0), label_domains(labels), TARGETS, steps=3).collect() == []
    empty = mix(docs.where("text is null or text = ''"), label_domains(labels), TARGETS, steps=3).collect()
    assert len(empty) == 2 and all(r["n_tokens"] == 0 and r["rate"] >= 0 for r in empty)


# ---- components

@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# ---- pipeline

@pytest.fixture()
def few_steps(monkeypatch):
    """The rates are tested above; here a few steps are enough."""
    monkeypatch.setattr(mixing, "STEPS", 4)


def test_pipeline_stages(spark, sf, few_steps):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # quality: no host of the table fails more than half of its documents
    bad = lambda t: (lambda c: c[0] < 10 or 100 * c[4] > 20 * c[0])(brute.quality(t))
    want = {i: t for i, t in rows.items() if not bad(t)}
    order = sorted(want)
    comp, _ = brute.components([want[i] for i in order])
    want = {i: want[i] for k, i in enumerate(order) if comp[k] == k}
    want = {i: t for i, t in want.items() if not brute.contaminated(t, items)[4]}
    out = corpus_pipeline.run(spark, sf)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(want) and 0 < len(got) < len(rows)
    for i, t in want.items():
        n = brute.secrets(t)
        assert (got[i]["text"] == t) == (sum(n[:3]) == 0) and got[i]["n_chars"] == len(got[i]["text"])
        assert brute.secrets(got[i]["text"])[:3] == (0, 0, 0) and got[i]["rate"] >= 0
    assert {"lang", "source", "rate"} <= set(out.columns) and labels.count()


def test_stages_keep_columns_and_survive_no_rows(spark, sf, few_steps):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.collect() == [] and (k == 4 or out.columns == docs.columns)


# ---- registry

def test_every_operator_is_registered():
    import __spark_entry__
    assert [sum(k.startswith(f"op{n}_") for k in Q) for n in range(1, 11)] == [1] * 10
    assert set(Q) | {"pipeline"} <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_mixing_report_of_the_tables(spark, sf, few_steps):
    got = mixing_report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert got.columns == ["doc_id", "source", "n_tokens", "p_clean", "p_low", "p_toxic", "rate"] and got.count() == 200


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, sf, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = Q[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == rows
