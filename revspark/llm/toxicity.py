"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; at most `ftrl.MAX_ROWS` of them are fitted on.
The L1 penalty leaves few weights, which are broadcast; every document's whole text is scored.

Defined cases: null and empty texts score the intercept; without labelled rows every score is 0; an id with several
labels counts as toxic if one of them says so; null labels are left out; a null doc_id counts as the empty text in the
split; repeated rows give a row each; other columns (lang, source) are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revspark.llm.common import WORD, texts
from revspark.llm.ftrl import MAX_ROWS, Weights, fit, gram_features, labelled_sample

_WORDS = re.compile(WORD)


def toxic_features(text: bytes) -> np.ndarray:
    return gram_features(_WORDS.findall(text.lower()))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    known = (labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").cast("string").alias("label")))
    table = fit(labelled_sample(docs, known, max_rows), ["1"], toxic_features)[0]
    held = docs.sparkSession.sparkContext.broadcast(table)
    built: list[Weights] = []

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        if not built:
            built.append(Weights(held.value))
        if not held.value:
            return pa.array([0.0] * len(text), pa.float64())
        return pa.array([built[0].score(toxic_features(t)) for t in texts(text)], pa.float64())

    out = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
