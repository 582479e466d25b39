"""The corpus pipeline: quality rules, language ID, line dedup, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet to the shared
folder and reread as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setwise.llm.common import Scratch
from setwise.llm.language_id import language_stage
from setwise.llm.line_dedup import line_stage
from setwise.llm.near_dedup import near_stage
from setwise.llm.packing import packing_stage
from setwise.llm.quality_rules import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the compression models nor the tokenizer; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
