"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents' columns, the
last one packed pieces. Rows are dropped or rewritten here by what the operators decide.

Every stage carries the caller's columns in one struct, so that no column's name can clash with its own.

Defined cases: null texts and texts without enough words fail the quality rules; later stages keep null texts
(null) and empty ones; rows with a null doc_id take part everywhere except near dedup, which keeps them;
rows that repeat doc_id and text are one document to line and near dedup (near dedup keeps one of them), rows
that share a doc_id with different texts are documents of their own; ties are settled by doc_id, then text;
texts of any length are taken whole; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vartide.llm import common, linededup, neardup, packing, quality, secrets


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows a rewritten text, where documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as the struct `doc`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("doc"))


def _rewritten(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The rows of `doc` with another text."""
    doc = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns]
    return _recount(rows.select(*doc))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule passes and the label model, fitted on this input, takes for good."""
    measured = common.materialize(docs.select(F.struct("*").alias("doc"), quality.features("text").alias("f")).withColumn("pattern", quality.pattern(quality.votes(F.col("f")))), "quality")
    return quality.judge(measured).filter("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated line runs; one that consists of such runs alone goes."""
    done = linededup.delete_repeats(_carried(docs))
    fact = F.col("line_dedup")
    kept = done.filter((fact["n_removed"] == 0) | (fact["n_removed"] < fact["n_lines"]))
    return _rewritten(kept, docs.columns, F.col("text"))


#: Similarity of word shingles, in percent, from which the pipeline takes documents for near duplicates.
NEAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate component, once if rows repeat it.

    Rows that share a doc_id with different texts are documents of their own, so the links are found
    between ids of (doc_id, text)."""
    mine = _carried(docs.filter("doc_id is not null")).withColumn("own", F.xxhash64("doc_id", F.col("text").isNull(), "text"))
    found = neardup.near_duplicates(mine.select(F.col("own").alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias("own"), "component_id")
    kept = found.distinct().join(mine.select("own", "doc_id"), "own").groupBy("component_id").agg(F.min(F.struct("doc_id", "own"))["own"].alias("own")).select("own")
    order = Window.partitionBy("own", "doc_id", "text").orderBy("own")
    named = mine.join(kept, "own", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return named.select("doc.*").unionByName(docs.filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced; none goes."""
    rules = secrets.forest_rules(secrets.train(secrets.labelled_findings(spark)))
    done = secrets.redact(_carried(docs), rules)
    return _rewritten(done, docs.columns, F.when(F.col("text").isNotNull(), F.col("secret_scan.text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
