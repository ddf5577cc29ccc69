"""Registry of named queries (``(spark, sf_dir) -> DataFrame``) and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "revspark.plans.queries_findings",
    "revspark.plans.queries_ingest",
    "revspark.plans.queries_code",
    "revspark.plans.queries_text",
    "revspark.plans.queries_pr",
    "revspark.plans.queries_ai",
    "revspark.plans.queries_misc",
    "revspark.plans.queries_analysis",
    "revspark.plans.queries_sources",
]


def load():
    queries, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        clash = (set(mod.Q) & set(queries)) | (set(mod.SQL) & set(sql))
        if clash:
            raise ValueError(f"query keys registered twice: {sorted(clash)}")
        queries.update(mod.Q)
        sql.update(mod.SQL)
    return queries, sql
