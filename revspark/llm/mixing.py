"""Mixing sources to target weights with soft domain membership.

1. A classifier (FTRL-proximal, one against the rest) is fitted on a labelled table of (doc_id, domain), at most
   `ftrl.MAX_ROWS` rows of it, and gives every document a posterior over the domains in steps of 1 / `GRID`.
2. The rates r >= 0 of the documents are fitted so that the expected tokens of each domain, the sum of r * tokens *
   posterior, match the targets: least squares with a weak pull to the budget's share of all tokens, by accelerated
   projected gradient. A domain's residual is weighed by one over its share of all tokens, so that rare domains converge as
   fast as common ones. Scaled by tokens, a document's gradient is its posterior times the domains' residuals, so
   documents of equal posterior share their rate: tokens are pre-aggregated by posterior (at most a number set by GRID
   and the domains, whatever the corpus), each step is one distributed sum over that table, and a document's rate
   follows from its posterior and the residuals of the steps. The steps end once every domain is within `TOLERANCE` of
   its target, or after `STEPS`.

A target that cannot be met (no document has a posterior in it, or posteriors too alike to tell the domains apart) stays
unmet, with a warning; the rates of the others still fit. `expected_tokens` states what was reached.

Defined cases: null and empty texts have no tokens and keep the rate of their posterior; labels with null ids or
domains are left out, an id with several domains counts as the smallest; without labels the posteriors are even; a very
long text is one row of features, read whole; repeated rows and ties of posteriors give a row each with the same rate; an
empty table gives an empty result; clashing columns of the input are kept apart.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import IS_BLANK, IS_WORD, WORD, materialise, texts
from revspark.llm.ftrl import MAX_ROWS, Weights, fit, gram_features, labelled_sample

GRID = 500
STEPS = 100
#: Largest distance of a domain's expected tokens from its target, as a share of the target.
TOLERANCE = 1e-3
PULL = 1e-5
BUDGET = 0.5
EPOCHS = 3

#: Target shares of the tokens by domain of `label_domains`.
TARGETS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}

_IS_SYMBOL = ~(IS_WORD | IS_BLANK)
_TOKENS = re.compile(WORD + rb"|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else low by quality 0, else clean."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    return labels.where(known).select("doc_id", domain.alias("domain"))


def domain_features(text: bytes) -> np.ndarray:
    """n-grams of words and punctuation, the share of repeated lines and the length, both in a few steps."""
    low = text.lower()
    lines = [x for x in low.split(b"\n") if x and not x.isspace()]
    repeated = 10 * (len(lines) - len(set(lines))) // max(1, len(lines))
    words = _TOKENS.findall(low)
    raw = np.frombuffer(low, dtype=np.uint8)
    symbols = 20 * int(_IS_SYMBOL[raw].sum()) // max(1, len(low))
    return gram_features(words, (b"\x00 %d" % repeated, b"\x01 %d" % symbols, b"\x02 %d" % len(words).bit_length()))


def to_grid(scores: list[float]) -> list[int]:
    """Shares in whole steps of 1 / GRID that add up; what rounding leaves goes to the largest remainders."""
    total = sum(scores)
    exact = [GRID * s / total for s in scores] if total > 0 else [GRID / len(scores)] * len(scores)
    low = [int(x) for x in exact]
    for k in sorted(range(len(low)), key=lambda k: (low[k] - exact[k], k))[:GRID - sum(low)]:
        low[k] += 1
    return low


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """`docs` with a struct column __m: n_tokens and p, the posterior in steps of 1 / GRID by domain."""
    known = labelled.where(F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("label"))
    tables = fit(labelled_sample(docs, known, max_rows), domains, domain_features, EPOCHS)
    held = docs.sparkSession.sparkContext.broadcast(tables)
    built: list[Weights] = []
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def membership(text: pa.Array) -> pa.Array:
        if not built:
            built.extend(Weights(t) for t in held.value)
        fitted = any(held.value)
        out = []
        for t in texts(text):
            at = domain_features(t)
            out.append({"n_tokens": len(t.split()), "p": to_grid([w.score(at) if fitted else 1.0 for w in built])})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.int32()))]))

    return docs.withColumn("__m", membership("text"))


def on_grid(p: pa.Array, n: int) -> np.ndarray:
    """Posteriors of an array column as rows of n shares."""
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, n) / GRID


def rate_history(cells: DataFrame, targets: list[float], steps: int = STEPS, budget: float = BUDGET,
                 tolerance: float = TOLERANCE) -> np.ndarray:
    """The scaled residuals (by step and domain) of accelerated projected gradient on (p, tokens): one distributed sum a step."""
    n = len(targets)
    history = np.zeros((0, n))
    names = [f"v{k}" for k in range(n)]
    row = cells.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("p")[k] * F.col("tokens")).alias(v) for k, v in enumerate(names))).first()
    total = row["t"] or 0
    if not total:
        return history
    # expected totals as shares of all tokens; targets as shares of the budget; mass: the domains' shares of all tokens
    aim = np.array(targets) / sum(targets) * budget
    mass = np.array([row[v] for v in names]) / GRID / total
    served = mass > 0
    scale = np.divide(1.0, mass, out=np.zeros(n), where=served)
    off = np.zeros(n)
    for _ in range(steps):
        at = history

        def sums(batches, at=at):
            got = np.zeros(n)
            for b in batches:
                p = on_grid(b.column("p"), n)
                got += (rates(p, at, budget, ahead=True) * b.column("tokens").to_numpy(zero_copy_only=False)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in got], names=names)

        # a row for each partition, summed to one
        row = cells.mapInArrow(sums, ", ".join(f"{v} double" for v in names)).agg(*(F.sum(v).alias(v) for v in names)).first()
        off = np.array([row[v] or 0.0 for v in names]) / total - aim
        history = np.vstack([history, off * scale])
        if (np.abs(off) <= tolerance * aim)[served].all():
            break
    late = (np.abs(off) > tolerance * aim) | (~served & (aim > 0))
    if late.any():
        warnings.warn(f"targets not met, by their place: {np.flatnonzero(late).tolist()}, off by {off[late].tolist()} of all tokens",
                      stacklevel=2)
    return history


def rates(p: np.ndarray, history: np.ndarray, base: float, ahead: bool = False) -> np.ndarray:
    """The rates of documents with posteriors p after the steps whose scaled residuals are given. ahead: the point at which the
    next gradient is taken."""
    r = y = np.full(len(p), base)
    t = 1.0
    for g in history:
        # a domain's row of posterior products adds up to its mass, so the scaled gradient's Lipschitz constant is at most 1 + PULL
        fresh = np.maximum(0.0, y - (p @ g + PULL * (y - base)) / (1 + PULL))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = fresh + (t - 1) / after * (fresh - r)
        r, t = fresh, after
    return y if ahead else r


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = BUDGET, steps: int | None = None,
        max_rows: int = MAX_ROWS, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (less the columns in `drop`) with n_tokens, p_<domain> and rate (how many times to take a document; fractions by chance).

    labelled: (doc_id, domain). targets: the domains' shares of the drawn tokens, which are `budget` of all tokens.
    steps: STEPS unless given.
    """
    steps = STEPS if steps is None else steps
    domains = sorted(targets)
    found = materialise(posteriors(docs, labelled, domains, max_rows).drop(*drop), "members")
    cells = materialise(found.groupBy(F.col("__m.p").alias("p")).agg(F.sum("__m.n_tokens").alias("tokens")), "cells")
    history = rate_history(cells, [targets[d] for d in domains], steps, budget)

    @F.arrow_udf(T.DoubleType())
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(rates(on_grid(p, len(domains)), history, budget))

    taken = {"n_tokens", "rate", *(f"p_{d}" for d in domains)}
    return found.select(*(c for c in found.columns if c not in {*taken, "__m"}), F.col("__m.n_tokens").alias("n_tokens"),
                        *((F.col("__m.p")[k] / GRID).alias(f"p_{d}") for k, d in enumerate(domains)),
                        rate("__m.p").alias("rate"))


def expected_tokens(mixed: DataFrame, targets: dict[str, float], budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """Per domain of `mix`'s result: target and expected tokens at its rates, and whether they agree within the tolerance."""
    whole = F.coalesce(F.sum("n_tokens"), F.lit(0)) * budget / sum(targets.values())
    per = F.array(*(F.struct(F.lit(d).alias("domain"), (whole * share).alias("target_tokens"),
                             F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias("expected_tokens"))
                    for d, share in sorted(targets.items())))
    near = F.abs(F.col("expected_tokens") - F.col("target_tokens")) <= tolerance * F.col("target_tokens")
    return mixed.agg(per.alias("per")).select(F.inline("per")).withColumn("met", near)


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, source, n_tokens, the posteriors and the rate that meets TARGETS."""
    return mix(docs.select("doc_id", "source", "text"), label_domains(labels), TARGETS, drop=("text",))
