"""A corpus pipeline: language, near duplicates, repeated passages, benchmark items, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.decontamination import stage_decontaminate
from foliospark.llm.language import stage_language
from foliospark.llm.near_duplicates import stage_near_duplicates
from foliospark.llm.packing import stage_packing
from foliospark.llm.substrings import stage_sentence_spans
from foliospark.storage import Scratch

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("sentence_spans", stage_sentence_spans),
    ("decontaminate", stage_decontaminate),
    ("packing", stage_packing),
]

#: Compression, sketches and least squares are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next.

    Rows with a null or empty text go in the first stage, of repeated rows one stays after the second; an empty
    table gives no pieces. Extra columns go through all stages but the last.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
