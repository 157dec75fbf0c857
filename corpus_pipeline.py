"""Corpus pipeline: quality rules, line dedup, near dedup, secret scan and packing, table by table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vartide.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("pack", stages.pack),
]

#: SQL expresses neither the label model, the sketches, the forest nor the tokenizer; tests/llm holds
#: run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
