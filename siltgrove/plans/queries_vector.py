"""Queries over vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import distances
from ..operators import nearest, ranking
from ..session import table


def _top(metric: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings")
        found = nearest.search(e, nearest.every_hundredth(e), 5, metric)
        return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))

    run.__name__ = f"vec_{metric}_topk"
    return run


vec_cosine_topk, vec_l1_topk, vec_l2_topk, vec_linf_topk = map(_top, ("cosine", "l1", "l2", "linf"))


def vec_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the flat search that score at least 0.6."""
    e = table(spark, d, "embeddings")
    found = nearest.search(e, nearest.every_hundredth(e), 20)
    return ranking.at_least(found.select("query_id", "vec_id", F.round(distances.score(F.col("distance"), "cosine"), 6).alias("score")), 0.6)


def vec_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every vector with its eight most similar others by dot product, each once."""
    e = table(spark, d, "embeddings")
    links = nearest.undirected(nearest.search(e, e, 8, "dot", include_self=False))
    return links.select("u", "v", F.round("similarity", 6).alias("similarity"))


def vec_top_links(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most similar pairs, ranked."""
    e = table(spark, d, "embeddings")
    links = nearest.undirected(nearest.search(e, e, 8, "dot", include_self=False)).orderBy(F.desc("similarity"), "u", "v").limit(100)
    return links.select(F.row_number().over(W.orderBy(F.desc("similarity"), "u", "v")).cast("long").alias("rank"), "u", "v", F.round("similarity", 6).alias("similarity"))


def vec_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Norms of the leaves' vectors, and of the same brought to unit length."""
    n = table(spark, d, "nodes").where("layer = 0 and size(embeddings) = 64").where(~F.exists("embeddings", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return n.select("node_id", F.round(distances.norm(F.col("embeddings")), 4).alias("norm"), F.round(distances.norm(distances.normalized(F.col("embeddings"))), 4).alias("unit")).distinct()


def vec_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct vectors of the leaves, under the least id, with the number of their leaves."""
    rows = table(spark, d, "nodes").where("layer = 0 and embeddings is not null").select("node_id", "embeddings").distinct()
    return ranking.distinct_vectors(rows, "embeddings", "node_id").select("node_id", "copies")


def vec_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors by label, rounded, one row per element."""
    p = nearest.prototypes(table(spark, d, "embeddings"), "label")
    return p.select("label", F.posexplode("embedding").alias("at", "x")).select("label", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


def vec_nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    """The label whose mean direction is nearest to each vector."""
    e = table(spark, d, "embeddings")
    found = nearest.assign(e, nearest.prototypes(e, "label").withColumnRenamed("label", "centre_id"))
    return found.select("vec_id", "centre_id", F.round("score", 6).alias("score"))


def vec_label_counts(spark: SparkSession, d: str) -> DataFrame:
    w = ranking.label_weights(table(spark, d, "embeddings"), "label", 10)
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


def vec_split(spark: SparkSession, d: str) -> DataFrame:
    """The documents that a stratified split by language holds out."""
    rows = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang")
    return ranking.stratified(rows, "lang", "doc_id").where("held_out").select("doc_id", "lang")


E = "(select vec_id, label, cast(embedding as double[]) as e from embeddings)"
_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(q.e, b.e)",
    "l1": "list_sum(list_transform(list_zip(q.e, b.e), lambda p: abs(p[1] - p[2])))",
    "l2": "list_distance(q.e, b.e)",
    "linf": "list_max(list_transform(list_zip(q.e, b.e), lambda p: abs(p[1] - p[2])))",
}


def _top_sql(metric: str) -> str:
    return f"""
select query_id, rank, vec_id, round(distance, 6) as distance from (
  select q.vec_id as query_id, b.vec_id, {_DISTANCE[metric]} as distance,
    row_number() over (partition by q.vec_id order by round({_DISTANCE[metric]}, 9), b.vec_id) as rank
  from {E} q join {E} b on q.vec_id % 100 = 0) where rank <= 5"""


_LINKS = f"""
select u, v, max(s) as s from (select greatest(a, b) as u, least(a, b) as v, s from (
  select q.vec_id as a, b.vec_id as b, list_dot_product(q.e, b.e) as s,
    row_number() over (partition by q.vec_id order by round(-list_dot_product(q.e, b.e), 9), b.vec_id) as r
  from {E} q join {E} b on q.vec_id <> b.vec_id) where r <= 8) group by 1, 2"""

SQL = {
    **{f"vec_{m}_topk": _top_sql(m) for m in _DISTANCE},
    "vec_scores": f"""
select query_id, vec_id, score from (select q.vec_id as query_id, b.vec_id, round((1 + list_cosine_similarity(q.e, b.e)) / 2, 6) as score,
  row_number() over (partition by q.vec_id order by round(1 - list_cosine_similarity(q.e, b.e), 9), b.vec_id) as r
  from {E} q join {E} b on q.vec_id % 100 = 0) where r <= 20 and score >= 0.6""",
    "vec_links": f"select u, v, round(s, 6) as similarity from ({_LINKS})",
    "vec_top_links": f"select row_number() over (order by s desc, u, v) as rank, u, v, round(s, 6) as similarity from ({_LINKS}) order by s desc, u, v limit 100",
    "vec_normalized": """
select distinct node_id, round(n, 4) as norm, cast(case when n > 0 then 1.0 else 0.0 end as double) as unit from (
  select node_id, sqrt(list_sum(list_transform(cast(embeddings as double[]), lambda x: x * x))) as n from nodes
  where layer = 0 and len(embeddings) = 64 and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
    "vec_distinct": "select min(node_id) as node_id, count(distinct node_id) as copies from nodes where layer = 0 and embeddings is not null group by embeddings",
    "vec_prototypes": f"select label, i - 1 as at, round(avg(e[i]), 6) as x from (select label, e, unnest(range(1, len(e) + 1)) as i from {E}) group by 1, 2",
    "vec_nearest_prototype": f"""
with p as (select label, list(m order by i) as c from (select label, i, avg(e[i]) as m from (select label, e, unnest(range(1, len(e) + 1)) as i from {E}) group by 1, 2) group by 1),
u as (select label, c, sqrt(list_dot_product(c, c)) as n from p),
s as (select vec_id, u.label, list_dot_product(e, c) / n as s from {E} b, u)
select vec_id, cast(arg_max(label, s) as bigint) as centre_id, round(max(s), 6) as score from s group by 1""",
    "vec_label_counts": "select label, count(*) as n, round(sum(count(*)) over () / (10 * count(*)), 6) as weight from embeddings group by 1",
    "vec_split": """
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as rn, count(*) over (partition by lang) as n
from documents where lang is not null) where rn <= least(greatest(floor(n * 0.1 + 0.5), 1), n - 1)""",
}

QUERIES = (vec_cosine_topk, vec_l1_topk, vec_l2_topk, vec_linf_topk, vec_scores, vec_links, vec_top_links, vec_normalized, vec_distinct, vec_prototypes, vec_nearest_prototype, vec_label_counts, vec_split)
