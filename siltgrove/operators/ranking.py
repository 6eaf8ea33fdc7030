"""Ranking: fusion of ranked lists, context selection, thresholds, dedupe, stratified splits and sample limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60


def fuse(lists: list[DataFrame], key: str = "text", k: int = RRF_K, top: int | None = None) -> DataFrame:
    """query_id, key, score and rank: reciprocal ranks 1 / (rank + k) summed over ranked lists with query_id, key and
    rank from 1. What is equal stands for one. Ties keep the order of the lists, then of their ranks."""
    tagged = [d.select("query_id", key, "rank", F.lit(i).alias("at")) for i, d in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged)
    summed = both.groupBy("query_id", key).agg(F.sum(1 / (F.col("rank") + k)).alias("score"), F.min(F.struct("at", "rank")).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", key)
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("query_id", key, "score", "rank")


def context(hits: DataFrame, top: int) -> DataFrame:
    """The final context: leaf hits only, the best score of each node over all rounds, the top of each query; ties by
    node_id. hits has query_id, node_id, layer and score."""
    best = hits.where("layer = 0").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def at_least(hits: DataFrame, score: float) -> DataFrame:
    """Threshold selection: the hits that score at least so much (not those that are far, see README)."""
    return hits.where(F.col("score") >= score)


def distinct_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per distinct vector, the one of the least key; null vectors are left out."""
    return rows.where(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def stratified(rows: DataFrame, label: str, key: str, share: float = 0.1) -> DataFrame:
    """rows with `held_out`: of each label round(share) of its rows, at least one but never all, the first ones by the
    md5 of the key. A label with a single row holds none out; rows without label aren't held out.

    Rows are counted per label and leading digits of the md5 (at most 4096 each), so that only the few rows of the
    digits where a label's quota ends are ranked, however many rows a label has."""
    keyed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.left("_h", F.lit(3)))
    counts = keyed.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    every, upto = W.partitionBy(label), W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_c").over(every)
    quota = F.least(F.greatest(F.floor(total * share + 0.5), F.lit(1)), total - 1)
    left = counts.withColumn("_left", quota - F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    j = keyed.join(left.select(label, "_b", "_c", "_left"), [label, "_b"], "left")
    edge = j.where("_left > 0 and _left < _c").withColumn("_rn", F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)))
    whole = j.where("_left is null or _left <= 0 or _left >= _c").withColumn("_rn", F.lit(1))
    both = edge.unionByName(whole).withColumn("held_out", F.coalesce(F.col("_rn") <= F.col("_left"), F.lit(False)))
    return both.drop("_h", "_b", "_c", "_left", "_rn")


def label_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """label, n and weight = all / (classes x n)."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.sum("n").over(W.partitionBy()) / (classes * F.col("n")))


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order, as a sample limit; all of them for n <= 0."""
    return rows if n <= 0 else rows.orderBy(*order).limit(n)


def by_prefix(rows: DataFrame, text: str, at: str, length: int = 100) -> DataFrame:
    """One row per prefix of a text: the last text in order, at the first position."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.left(F.col(text), F.lit(length)).alias("prefix")).agg(F.max_by(text, at).alias(text), F.min(at).alias(at))
