"""The registered queries of the operators and the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Each module registers its query here when imported.
MODULES = ["q_quality", "q_decontaminate", "q_shards", "q_jaccard", "q_spans", "q_rules", "q_packing", "q_urls", "q_kneser", "q_secrets", "q_repair", "q_prefix_trie", "q_simhash", "q_pipeline"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


for _module in MODULES:
    importlib.import_module(f"affinis.llm.{_module}")
