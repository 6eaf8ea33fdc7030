"""Saved trees, indexes and results, as Parquet and JSON below one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, write_text

FORMAT = 1


def save_tree(nodes: DataFrame, edges: DataFrame, path: str, per_file: int = 200_000) -> None:
    """Nodes by tree and layer, edges by tree, and a manifest (one row per tree: format, height, layers, leaves, nodes, roots and the least root). Earlier
    contents are replaced; files hold at most per_file rows."""
    nodes.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("tree_id", "layer").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("tree_id").parquet(f"{path}/edges")
    manifest = nodes.groupBy("tree_id").agg(F.lit(FORMAT).alias("format"), F.max("layer").alias("height"), (F.max("layer") + 1).alias("layers"), F.count_if(F.col("layer") == 0).alias("leaves"), F.count("*").alias("nodes"), F.min(F.when(F.col("parent_id").isNull(), F.col("node_id"))).alias("root"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; trees and layers are partitions, so a filter on them prunes files."""
    if spark.read.parquet(f"{path}/manifest").where(F.col("format") != FORMAT).take(1):
        raise ValueError("unknown format")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_index(index, path: str) -> None:  # noqa: ANN001
    """A sparse index: its four tables, postings and words by scope."""
    for name in ("postings", "docs", "words", "scopes"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str):  # noqa: ANN201
    from ..operators.bm25 import Index

    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "words", "scopes")))


def save_results(answers: DataFrame, path: str, about: dict) -> None:
    """Answers as JSON lines, what they are about (settings, times) beside them."""
    answers.write.mode("overwrite").json(f"{path}/answers")
    write_text(answers.sparkSession, f"{path}/about.json", json.dumps(about, default=str, indent=1))


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved answers, or None where there are none or they lack their columns."""
    if not exists(spark, f"{path}/about.json"):
        return None
    rows = spark.read.json(f"{path}/answers")
    return rows if {"query_id", "answer"} <= set(rows.columns) else None
