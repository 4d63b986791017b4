"""Counts over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_statistics(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("total_chunks"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def file_rollup(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, tokens, time of its first chunk, and name."""
    return chunks.groupBy("file_path").agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"), F.min_by("created_at", F.struct("chunk_index", "created_at")).alias("last_modified")).withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))


def distinct_files(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("file_path").alias("files"))
