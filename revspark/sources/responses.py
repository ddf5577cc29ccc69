"""Stored model responses -> JSON items (one row per item).

Rules: a blank response gives nothing; the text is stripped; when it starts
with a code fence the lines between the first and the next fence are taken;
the result must parse as a JSON *array* (objects and bad JSON give nothing).
Items stay VARIANT so absent keys can be told apart from explicit nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.functions.text import strip

FENCE_BODY = r"(?s)^```[^\n]*\n(.*?)(?:\n```.*)?$"


def response_json(text: Column) -> Column:
    """The JSON text a response holds (fence removed), NULL when blank."""
    t = strip(text)
    body = F.when(t.startswith("```"), F.regexp_extract(t, FENCE_BODY, 1)).otherwise(t)
    return F.when(text.isNull() | (F.length(t) == 0), F.lit(None)).otherwise(body)


def response_items(text: Column) -> Column:
    """array<variant> when the response is a JSON array, else NULL."""
    v = F.try_parse_json(response_json(text))
    return F.try_variant_get(v, "$", "array<variant>")


def parse_responses(responses: DataFrame, keys=("prompt_key",), text_col: str = "response") -> DataFrame:
    """Explode the items of each response: ``keys…, item_ord, item (variant), n_items``."""
    keys = list(keys)
    return (responses.select(*keys, response_items(F.col(text_col)).alias("_items"))
            .select(*keys, F.size("_items").alias("n_items"),
                    F.posexplode("_items").alias("_pos", "item"))
            .select(*keys, (F.col("_pos") + 1).cast("long").alias("item_ord"), "item", "n_items"))
