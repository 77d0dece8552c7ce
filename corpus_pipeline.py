"""Training-corpus pipeline: five operators in a row over ``documents``.

Every stage takes the documents that the one before kept, written and read again, and all
but the last return the columns of ``documents``. A stage deletes the tables of those before
it, except what its documents are read from. Rows without doc_id can't be named in a pair or a leak, and
stay in the stages that work by name; repeated rows are one document from the second
stage on. Empty tables pass through.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from affinis.llm import decontaminate, jaccard, packing, rules, secrets
from affinis.llm.text import drop_tables, materialise, read, tables_written

VOCABULARY = "word_bpe_49k.json"
# Tables of the stages so far, of the run that began last.
_written: list[str] = []


def stage(run_it):
    """A stage that first deletes what the stages before it wrote and its documents don't need."""

    @functools.wraps(run_it)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        first = run_it.__name__ == STAGES[0][0]
        _written[:] = [] if first else drop_tables(spark, _written, docs)
        with tables_written() as tables:
            out = run_it(spark, docs, sf_dir)
        _written.extend(tables)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return rules.passing(docs)


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates."""
    return jaccard.one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.masked(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document and its place in a training sequence, with its token ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Exact set similarity, fingerprints, trained models and token ids are beyond SQL; the
# tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        with tables_written() as tables:
            docs = materialise(one(spark, docs, sf_dir), name)
        _written.extend(tables)
    return STAGES[-1][1](spark, docs, sf_dir)
