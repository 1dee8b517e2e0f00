"""A training corpus from documents: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. `run` writes every stage's result to
the shared folder and reads it as the next one's input, so a lost executor costs a stage at most.

Defined cases: documents with a null or empty text have too few words and go in the first stage, with a null or no label
they are judged like any other; rows of one doc_id are judged by their own text in the first and third stage, and stay or
go together in the second; rows with a null doc_id are judged, are no near-duplicates of anything and lose no passages; an
empty table gives an empty table in every stage; columns beside doc_id, source and text are carried as they are, n_chars
follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsafe.llm import _shared, minhash, mixing, packing, quality_rules, substring


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    tid = F.xxhash64("text")  # rows of a doc_id with other texts are judged apart
    judged, _ = quality_rules.decide(docs.select("doc_id", "text", tid.alias("tid")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_tid"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five-word shingles, similarity 0.8 or more."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document has are cut; n_chars follows the text."""
    out = substring.deduplicate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the curriculum reads a document, in its order."""
    return mixing.curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences, in the order of the curriculum: docs must be read from the table that its range
    sort was written to, since Spark reads files largest first and only a copy's file and row tell its place."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    by = ["_part", "_file", "_row"]
    return packing.pack(placed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned rules, signatures and ids of a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
