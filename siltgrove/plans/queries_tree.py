"""Queries over trees, pipelines and the plain engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from ..operators import graph, inspect, tree
from ..session import table, written
from . import pipeline


def tree_layer_counts(spark: SparkSession, d: str) -> DataFrame:
    return inspect.layer_counts(table(spark, d, "nodes"))


def tree_child_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.child_stats(table(spark, d, "edges"))


def tree_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.token_stats(table(spark, d, "nodes")).withColumns({c: F.col(c).cast("long") for c in ("least_words", "most_words")})


def tree_heights(spark: SparkSession, d: str) -> DataFrame:
    return inspect.tree_layers(table(spark, d, "nodes"))


def tree_report(spark: SparkSession, d: str) -> DataFrame:
    r = inspect.node_report(table(spark, d, "nodes"), table(spark, d, "edges"))
    return r.select("tree_id", "node_id", F.col("depth").cast("long").alias("depth"), F.md5("short_text").alias("digest"), "children")


def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return tree.ancestors(table(spark, d, "nodes"), table(spark, d, "edges"))


def tree_starts(spark: SparkSession, d: str) -> DataFrame:
    return tree.start_layers(table(spark, d, "nodes"), 5)


def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without a parent, per tree."""
    n = table(spark, d, "nodes").select("tree_id", "node_id").distinct()
    e = table(spark, d, "edges").select("tree_id", F.col("child_id").alias("node_id")).distinct()
    return n.join(e, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count("*").alias("n_roots"))


def tree_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the edges: the number of nodes by their least node."""
    c = graph.components(table(spark, d, "edges").select("parent_id", "child_id"), "parent_id", "child_id")
    return c.groupBy("component").agg(F.count("*").alias("n"))


def tree_beam(spark: SparkSession, d: str) -> DataFrame:
    """Beam search down every tree, for the leaves whose id is divisible by 100, within their own trees."""
    n = table(spark, d, "nodes").where("size(embeddings) = 64").where(~F.exists("embeddings", lambda x: x.isNull() | F.isnan(x))).withColumnRenamed("embeddings", "embedding")
    q = n.where("layer = 0 and node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "tree_id", "embedding").dropDuplicates(["query_id"])
    found = tree.beam_search(n, table(spark, d, "edges"), q, 5)
    return found.select("query_id", "tree_id", "layer", F.col("rank").cast("long").alias("rank"), "node_id", F.round("score", 6).alias("score"))


def tree_flat(spark: SparkSession, d: str) -> DataFrame:
    """The same search started at the leaves: an exhaustive one."""
    n = table(spark, d, "embeddings").select(F.col("label").alias("tree_id"), F.col("vec_id").alias("node_id"), F.lit(0).alias("layer"), "embedding")
    q = n.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "tree_id", "embedding")
    none = spark.createDataFrame([], "tree_id int, parent_id long, child_id long")
    return tree.beam_search(n, none, q, 5, 0).select("query_id", "tree_id", F.col("rank").cast("long").alias("rank"), "node_id", F.round("score", 6).alias("score"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("tree_id"), F.col("vec_id").alias("node_id"), "embedding")


def forest_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree per label over the vectors."""
    return tree.forest(_leaves(spark, d)).select("tree_id", "node_id", "layer", "parent_id")


def forest_health(spark: SparkSession, d: str) -> DataFrame:
    return tree.health(written(tree.forest(_leaves(spark, d)), "forest")).select("tree_id", "leaves", "roots", "misplaced", "childless")


def bucketed_health(spark: SparkSession, d: str) -> DataFrame:
    """A tree over all vectors from buckets of at most 128, checked."""
    return tree.health(written(tree.bucketed_tree(_leaves(spark, d), 128), "tree")).select("tree_id", "leaves", "roots", "misplaced", "childless")


def neighbours_health(spark: SparkSession, d: str) -> DataFrame:
    """A tree over all vectors from links with eight neighbours each, checked."""
    return tree.health(written(tree.neighbour_tree(_leaves(spark, d), 8), "tree")).select("tree_id", "leaves", "roots", "misplaced", "childless")


def documents_health(spark: SparkSession, d: str) -> DataFrame:
    """A tree over all vectors whose first layer are their labels, checked."""
    rows = _leaves(spark, d).withColumnRenamed("tree_id", "document_index")
    return tree.health(written(tree.document_tree(rows), "tree")).select("tree_id", "leaves", "roots", "misplaced", "childless")


def bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tree.partition(_leaves(spark, d), 128).groupBy("bucket").agg(F.count("*").alias("n"))


CONF = Config(exclude_abs=True, bucket_size=2048, max_retrieval_time=1)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole index of the documents: embedded, treed, with prototypes as inner embeddings."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return pipeline.build(docs, CONF)[0].select("tree_id", "node_id", "layer", "parent_id", "document_index", "chunk_index")


def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of all questions by the agent over the tree of the documents, with the local models."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    nodes, edges = pipeline.build(docs, CONF)
    q = table(spark, d, "queries").select("query_id", "question").distinct()
    return pipeline.answer(written(nodes, "nodes"), written(edges, "edges"), q, CONF)


FLOW = Config(force_split=True, passage_as_tree=True, abstract_type="keyword", max_abs_length=20, hybrid_search=True, rerank=True, reader="scripted", max_retrieval_time=2)


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The news events as documents, and a question about each that belongs to it."""
    rows = table(spark, d, "wcep").groupBy("sample_id").agg(F.first("document").alias("document"), F.first("summary", True).alias("summary"))
    rows = rows.select(F.col("sample_id").alias("doc_id"), F.array_join("document", "\n").alias("text"), "summary").where("text is not null and text <> ''")
    return rows.select("doc_id", "text"), rows.where("summary is not null").select(F.col("doc_id").alias("query_id"), "doc_id", F.col("summary").alias("question"))


def flow_routes(spark: SparkSession, d: str) -> DataFrame:
    """The tree that answers each question about an event."""
    docs, q = _events(spark, d)
    return pipeline.routed(q, docs, FLOW).select("query_id", F.col("tree_id").cast("long").alias("tree_id"))


def flow_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow over the news events, a tree each: chunks, trees, abstracts, fused and reranked retrieval, and
    an agent that looks up again. A row per round."""
    docs, q = _events(spark, d)
    nodes, edges = pipeline.build(docs, FLOW)
    _, rounds = pipeline.answered(written(nodes, "nodes"), written(edges, "edges"), pipeline.routed(q, docs, FLOW), FLOW)
    return rounds.select("query_id", "round_no", "action", (F.col("documents") != "").alias("found"))


def flow_turns(spark: SparkSession, d: str) -> DataFrame:
    """How many rounds each question took and how many of them found documents: the reader looks up twice."""
    r = flow_rounds(spark, d)
    return r.groupBy("query_id").agg(F.count("*").alias("rounds"), F.count_if("found").alias("found"))


def smoke_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Plain aggregation, as a smoke test of the engine."""
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def smoke_nations(spark: SparkSession, d: str) -> DataFrame:
    """Plain joins: orders by nation of the customer."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def smoke_events(spark: SparkSession, d: str) -> DataFrame:
    """Plain windows: each user's last event."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "event_type")


def _beam_sql(layers: int = 12, k: int = 5) -> str:
    """The search layer by layer from the highest that any tree may have."""
    usable = "len(embeddings) = 64 and not list_bool_or([x is null or isnan(x) for x in embeddings])"
    parts = [f"""
with held as materialized (select tree_id, node_id, any_value(layer) as layer, any_value(embeddings)::double[] as v from nodes where {usable} group by 1, 2),
starts as (select tree_id, coalesce(max(layer) filter (where n >= {k}), 0) as s from (select tree_id, layer, count(*) as n from held group by 1, 2) group by 1),
q as materialized (select node_id as query_id, tree_id, v as qv, s from held join starts using (tree_id) where layer = 0 and node_id % 100 = 0),
l as materialized (select distinct tree_id, parent_id, child_id from edges),
f{layers} as (select 0::bigint as query_id, 0 as tree_id, 0 as layer, 0::bigint as rank, 0::bigint as node_id, 0.0::double as score where false)"""]
    for n in range(layers - 1, -1, -1):
        parts.append(f"""f{n} as materialized (
select query_id, tree_id, {n} as layer, rank, node_id, (2 - d) / 2 as score from (
  select *, row_number() over (partition by query_id, tree_id order by d nulls last, node_id) as rank from (
    select query_id, tree_id, v, min(round(1 - c, 9)) as d, min(node_id) as node_id from (
      select query_id, q.tree_id, h.node_id, h.v, case when isfinite(list_cosine_similarity(qv, v)) then list_cosine_similarity(qv, v) end as c
      from (select query_id, tree_id, node_id from q join held using (tree_id) where s = {n} and layer = {n}
            union select f.query_id, f.tree_id, child_id from f{n + 1} f join l on l.tree_id = f.tree_id and l.parent_id = f.node_id) x
      join held h on h.tree_id = x.tree_id and h.node_id = x.node_id and h.layer = {n} join q using (query_id)) group by 1, 2, 3)) where rank <= {k})""")
    return ",\n".join(parts) + "\n" + " union all ".join(f"select query_id, tree_id, layer, rank, node_id, round(score, 6) as score from f{n}" for n in range(layers))


_HEALTH = "select {} as tree_id, count(*) as leaves, 1::bigint as roots, 0::bigint as misplaced, 0::bigint as childless from embeddings"
SQL = {
    "tree_layer_counts": "select tree_id, layer, count(distinct node_id) as n from nodes group by 1, 2",
    "tree_child_stats": """
with n as (select tree_id, parent_id, count(*) as n from (select distinct tree_id, parent_id, child_id from edges) group by 1, 2)
select tree_id, round(avg(n), 6) as mean_children, min(n) as least_children, min(struct_pack(a := n, b := parent_id)).b as least_node, max(n) as most_children,
  -max(struct_pack(a := n, b := -parent_id)).b as most_node from n group by 1""",
    "tree_token_stats": """
with w as (select tree_id, layer, node_id, any_value(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\f]+'))) as n from nodes where text is not null group by 1, 2, 3)
select tree_id, layer, round(avg(n), 6) as mean_words, min(n) as least_words, min(struct_pack(a := n, b := node_id)).b as least_node, max(n) as most_words,
  -max(struct_pack(a := n, b := -node_id)).b as most_node from w group by 1, 2""",
    "tree_heights": """
with n as (select tree_id, max(layer) + 1 as layers from nodes group by 1)
select round(avg(layers), 6) as mean_layers, min(layers) as least_layers, min(struct_pack(a := layers, b := tree_id)).b as least_tree, max(layers) as most_layers,
  -max(struct_pack(a := layers, b := -tree_id)).b as most_tree from n""",
    "tree_ancestors": """
with recursive f as (select tree_id, child_id, min(parent_id) as parent_id from edges where parent_id is not null and child_id is not null group by 1, 2),
h as (select max(layer) as h from nodes),
a as (select distinct tree_id, node_id, 0 as layer, node_id as ancestor_id from nodes where layer = 0
  union all select a.tree_id, a.node_id, a.layer + 1, f.parent_id from a join f on f.tree_id = a.tree_id and f.child_id = a.ancestor_id, h where a.layer < h.h)
select * from a where layer > 0""",
    "tree_beam": _beam_sql(),
    "tree_report": """
with n as (select tree_id, node_id, any_value(layer) as layer, max(text) as text from nodes group by 1, 2),
t as (select tree_id, max(layer) as top from n group by 1),
k as (select tree_id, parent_id as node_id, list(child_id::varchar order by child_id) as ids from (select distinct tree_id, parent_id, child_id from edges) group by 1, 2),
w as (select *, regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\f]+') as w from n)
select tree_id, node_id, (top - layer)::bigint as depth, md5(case when len(w) <= 20 then text else array_to_string(w[1:20], ' ') || ' ...' end) as digest,
  coalesce(array_to_string(case when ids is null then [] when len(ids) <= 100 then ids else list_concat(ids[1:95], ['...'], ids[-5:]) end, ', '), '') as children
from w join t using (tree_id) left join k using (tree_id, node_id)""",
    "flow_routes": """
with e as (select sample_id, any_value(document) as document, any_value(summary) as summary from wcep group by 1),
r as (select sample_id, summary, row_number() over (order by sample_id) - 1 as tree_id from e where coalesce(array_to_string(document, chr(10)), '') <> '')
select sample_id as query_id, tree_id from r where summary is not null""",
    "flow_turns": """
with e as (select sample_id, any_value(document) as document, any_value(summary) as summary from wcep group by 1)
select sample_id as query_id, 2::bigint as rounds, case when regexp_matches(array_to_string(document, chr(10)), '[^.!?\\s]') then 2 else 0 end::bigint as found
from e where coalesce(array_to_string(document, chr(10)), '') <> '' and summary is not null""",
    "tree_starts": "select tree_id, max(layer) as start_layer from (select tree_id, layer from nodes group by 1, 2 having count(distinct node_id) >= 5) group by 1",
    "tree_roots": "select tree_id, count(*) as n_roots from (select distinct tree_id, node_id from nodes n where not exists (select 1 from edges e where e.tree_id = n.tree_id and e.child_id = n.node_id)) group by 1",
    "tree_components": """
with recursive l as (select parent_id as a, child_id as b from edges union select child_id, parent_id from edges),
r as (select a as node, a as low from l union select l.b, r.low from r join l on l.a = r.node where r.low < l.b)
select component, count(*) as n from (select node, min(low) as component from r group by 1) group by 1""",
    "tree_flat": """
select query_id, tree_id, rank, node_id, round((1 + c) / 2, 6) as score from (
  select q.vec_id as query_id, q.label as tree_id, b.vec_id as node_id, list_cosine_similarity(cast(q.embedding as double[]), cast(b.embedding as double[])) as c,
    row_number() over (partition by q.vec_id order by round(1 - list_cosine_similarity(cast(q.embedding as double[]), cast(b.embedding as double[])), 9), b.vec_id) as rank
  from embeddings q join embeddings b on q.label = b.label and q.vec_id % 100 = 0) where rank <= 5""",
    "forest_health": _HEALTH.format("label") + " group by label",
    "bucketed_health": _HEALTH.format("0"),
    "neighbours_health": _HEALTH.format("0"),
    "documents_health": _HEALTH.format("0"),
    "smoke_pricing": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "smoke_nations": "select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "smoke_events": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
}

QUERIES = (tree_layer_counts, tree_child_stats, tree_token_stats, tree_heights, tree_report, tree_ancestors, tree_starts, tree_roots, tree_components, tree_beam, tree_flat, forest_nodes, forest_health, bucketed_health, neighbours_health, documents_health, bucket_sizes, index_build, agent_answers, flow_routes, flow_turns, smoke_pricing, smoke_nations, smoke_events)
