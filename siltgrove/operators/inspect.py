"""Reports on trees: counts by layer, children, tokens, and single nodes, as aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_list, short_text, word_count


def layer_counts(nodes: DataFrame) -> DataFrame:
    """tree_id, layer and n: the distinct nodes of each layer."""
    return nodes.select("tree_id", "layer", "node_id").distinct().groupBy("tree_id", "layer").agg(F.count("*").alias("n"))


def child_stats(edges: DataFrame) -> DataFrame:
    """Per tree: mean, least and most children of nodes that have any, with the least id of such a node."""
    n = edges.select("tree_id", "parent_id", "child_id").distinct().groupBy("tree_id", "parent_id").agg(F.count("*").alias("n"))
    return n.groupBy("tree_id").agg(
        F.round(F.avg("n"), 6).alias("mean_children"),
        F.min(F.struct("n", "parent_id")).alias("lo"), F.max(F.struct(F.col("n"), (-F.col("parent_id")).alias("k"))).alias("hi"),
    ).select("tree_id", "mean_children", F.col("lo.n").alias("least_children"), F.col("lo.parent_id").alias("least_node"), F.col("hi.n").alias("most_children"), (-F.col("hi.k")).alias("most_node"))


def token_stats(nodes: DataFrame) -> DataFrame:
    """Per tree and layer: mean, least and most words of the texts, with the least id of such a node."""
    w = nodes.where("text is not null").groupBy("tree_id", "layer", "node_id").agg(F.first("text").alias("text")).withColumn("n", word_count(F.col("text")))
    return w.groupBy("tree_id", "layer").agg(
        F.round(F.avg("n"), 6).alias("mean_words"), F.min(F.struct("n", "node_id")).alias("lo"), F.max(F.struct(F.col("n"), (-F.col("node_id")).alias("k"))).alias("hi"),
    ).select("tree_id", "layer", "mean_words", F.col("lo.n").alias("least_words"), F.col("lo.node_id").alias("least_node"), F.col("hi.n").alias("most_words"), (-F.col("hi.k")).alias("most_node"))


def tree_layers(nodes: DataFrame) -> DataFrame:
    """Mean, least and most layers of the trees, with the least id of such a tree."""
    n = nodes.groupBy("tree_id").agg((F.max("layer") + 1).alias("layers"))
    r = n.agg(F.round(F.avg("layers"), 6).alias("mean_layers"), F.min(F.struct("layers", "tree_id")).alias("lo"), F.max(F.struct(F.col("layers"), (-F.col("tree_id")).alias("k"))).alias("hi"))
    return r.select("mean_layers", F.col("lo.layers").alias("least_layers"), F.col("lo.tree_id").alias("least_tree"), F.col("hi.layers").alias("most_layers"), (-F.col("hi.k")).alias("most_tree"))


def node_report(nodes: DataFrame, edges: DataFrame, words: int = 20) -> DataFrame:
    """tree_id, node_id, depth (0 for the top layer), short text and children ids of every node."""
    top = nodes.groupBy("tree_id").agg(F.max("layer").alias("top"))
    kids = edges.select("tree_id", "parent_id", "child_id").distinct().groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_set("child_id")).alias("kids"))
    one = nodes.groupBy("tree_id", "node_id").agg(F.first("layer").alias("layer"), F.max("text").alias("text"))
    j = one.join(top, "tree_id").join(kids, ["tree_id", "node_id"], "left")
    return j.select("tree_id", "node_id", (F.col("top") - F.col("layer")).alias("depth"), short_text(F.col("text"), words).alias("short_text"), F.coalesce(id_list(F.col("kids")), F.lit("")).alias("children"))
