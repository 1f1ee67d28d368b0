"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``:

1. language ID: documents whose text is in none of the learned languages go;
2. exact dedup: of equal texts one row stays, that of the largest id;
3. near-dedup: of texts linked by word shingles (five words, similarity 0.8) the document with the smallest id stays;
4. secret scan: credentials that look live are redacted, copied examples stay; no document goes;
5. packing: token pieces placed in sequences of 2048.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.exact_dedup import drop_copies
from orrery.llm.language_id import fit, keep_identified, learnable
from orrery.llm.near_dedup import drop_near_duplicates
from orrery.llm.packing import pack
from orrery.llm.scratch import written
from orrery.llm.secret_scan import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs, learnable()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, repository=F.col("doc_id"), owner=F.col("source"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Neither the language models nor the tokenizer can be put in SQL. The tests hold exact and near duplicates against all
#: pairs, redaction against the texts before it, and the models and the packing each against their definitions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
