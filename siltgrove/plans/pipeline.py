"""From documents to answers: chunk, embed, build trees, abstract bottom-up, retrieve, answer, evaluate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from ..functions.text import annotated, node_text
from ..operators import agent, bm25, chunking, hops, ranking, tree
from ..operators.models import ABSTRACTORS, EMBEDDERS, READERS, RERANKERS, abstract_of, backend, embedding_of
from ..session import written

#: Documents whose chunks are numbered in one task.
SPAN = 65_536
#: Most lookups beyond the first where the budget is found by the hop model.
MOST_LOOKUPS = hops.CLASSES - 1


def embedded(text: Column, conf: Config) -> Column:
    """Embeddings of a text column by the configured backend."""
    make, width = backend(EMBEDDERS, conf.embedder), conf.embedding_width
    return embedding_of(text, lambda: make(width))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_no, the position (from 0) of each doc_id among all of them: however ids are spread, numbers are
    dense. Counts per span of ids come first, then positions within each span, so that no task sees all documents."""
    ids = docs.select("doc_id").distinct().withColumn("span", F.floor(F.col("doc_id") / SPAN))
    spans = ids.groupBy("span").agg(F.count("*").alias("n"))
    ahead = spans.select("span", F.coalesce(F.sum("n").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = ids.withColumn("inner", F.row_number().over(W.partitionBy("span").orderBy("doc_id")) - 1).join(ahead, "span")
    return docs.join(placed.select("doc_id", (F.col("ahead") + F.col("inner")).alias("doc_no")), "doc_id")


def leaves_of(docs: DataFrame, conf: Config) -> DataFrame:
    """tree_id, node_id, document_index, chunk_index, text and embedding of every chunk. Without passage_as_tree all
    chunks are leaves of tree 0, else a document's number (see numbered()) is its tree; ids are ordinals in document
    and chunk order within a tree."""
    docs = numbered(docs).select(F.col("doc_no").alias("doc_id"), "text")
    cut = chunking.chunks(docs, conf.max_tokens_per_chunk) if conf.force_split or conf.passage_as_tree else docs.select("doc_id", F.lit(0).alias("chunk_index"), "text")
    named = cut.withColumn("tree_id", (F.col("doc_id") if conf.passage_as_tree else F.lit(0)).cast("int"))
    # Ordinals from counts: per span of documents first, then within each span, so that no task sees them all.
    counts = named.groupBy("tree_id", "doc_id").agg((F.max("chunk_index") + 1).alias("n")).withColumn("span", F.floor(F.col("doc_id") / SPAN))
    spans = counts.groupBy("tree_id", "span").agg(F.sum("n").alias("n"))
    ahead = spans.select("tree_id", "span", F.coalesce(F.sum("n").over(W.partitionBy("tree_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("tree_id", "span").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("inner", inner).join(ahead, ["tree_id", "span"]).withColumn("before", F.col("ahead") + F.col("inner"))
    placed = named.join(before.select("tree_id", "doc_id", "before"), ["tree_id", "doc_id"])
    return placed.select("tree_id", (F.col("before") + F.col("chunk_index")).alias("node_id"), F.col("doc_id").alias("document_index"), "chunk_index", "text", embedded(F.col("text"), conf).alias("embedding"))


def routed(questions: DataFrame, docs: DataFrame, conf: Config) -> DataFrame:
    """questions (query_id, question and, where each belongs to a document, doc_id) with the tree_id that answers
    them: the document's own tree where every document has one, else tree 0. A question whose document isn't there,
    or that names none where there are several trees, is left out of retrieval by a null tree_id."""
    if not conf.passage_as_tree:
        return questions.withColumn("tree_id", F.lit(0))
    if "doc_id" not in questions.columns:
        return questions.withColumn("tree_id", F.lit(None).cast("int"))
    at = numbered(docs.select("doc_id")).distinct().select("doc_id", F.col("doc_no").cast("int").alias("tree_id"))
    return questions.join(at, "doc_id", "left")


def build(docs: DataFrame, conf: Config) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree_id, node_id, layer, parent_id, document_index, chunk_index, text, embedding) and edges."""
    leaves = written(leaves_of(docs, conf), "leaves")
    if conf.passage_as_tree:
        shape = tree.grown(leaves, conf.max_num_children, conf.bucket_size or tree.BUCKET)
    elif conf.force_split and not conf.reorganize_leaf:
        shape = tree.document_tree(leaves, conf.max_num_children, conf.bucket_size or tree.BUCKET)
    elif conf.bucket_size and conf.tree_builder == "knn":
        shape = tree.bucketed_tree(leaves.select("node_id", "embedding"), conf.bucket_size, conf.max_num_children, knn=conf.knn)
    elif conf.bucket_size:
        shape = tree.bucketed_tree(leaves.select("node_id", "embedding"), conf.bucket_size, conf.max_num_children)
    elif conf.tree_builder == "knn":
        shape = tree.neighbour_tree(leaves, conf.knn, conf.max_num_children)
    else:
        shape = tree.grown(leaves, conf.max_num_children, conf.bucket_size or tree.BUCKET)
    shape = written(shape, "shape")
    about = leaves.select("tree_id", "node_id", "document_index", "chunk_index", "text")
    nodes = shape.join(about, ["tree_id", "node_id"], "left").select("tree_id", "node_id", "layer", "parent_id", F.coalesce("document_index", F.lit(-1)).alias("document_index"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "text", "embedding")
    edges = tree.edges_of(shape)
    return (nodes if conf.exclude_abs else abstracts(nodes, conf)), edges


def abstracts(nodes: DataFrame, conf: Config) -> DataFrame:
    """The nodes with texts and embeddings of inner nodes made from their children's texts, layer by layer upwards."""
    make = backend(ABSTRACTORS, conf.abstract_type)
    done = nodes.where("layer = 0")
    height = nodes.agg(F.max("layer")).first()[0] or 0
    below = done
    for level in range(1, height + 1):
        kids = below.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(node_text(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))).alias("t"))
        here = nodes.where(F.col("layer") == level).drop("text", "embedding").join(kids, ["tree_id", "node_id"], "left")
        here = here.withColumn("text", abstract_of(F.col("t"), conf.max_abs_length, level == 1, make)["text"]).withColumn("embedding", embedded(F.col("text"), conf))
        below = written(here.select(*nodes.columns), "layer")
        done = done.unionByName(below)
    return done


def sparse_index(nodes: DataFrame, conf: Config) -> bm25.Index | None:
    """The sparse index of the leaves' texts by tree, written once for all rounds; None where none is configured."""
    if not conf.hybrid_search:
        return None
    built = bm25.build(nodes.where("layer = 0").select(F.col("node_id").alias("doc_id"), "tree_id", "text"), "tree_id")
    return bm25.Index(built.postings, written(built.docs, "sparse"), written(built.words, "sparse"), written(built.scopes, "sparse"))


def retrieve(nodes: DataFrame, edges: DataFrame, questions: DataFrame, conf: Config, sparse: bm25.Index | None = None) -> DataFrame:
    """query_id, rank, node_id and text: the best leaves of the beam search, fused with sparse search or reranked as
    configured. questions has query_id, text and, for forests, tree_id; one with a null tree_id finds nothing. sparse
    is sparse_index()'s, made here if it isn't given."""
    asked = questions.select("query_id", "text", (F.col("tree_id") if "tree_id" in questions.columns else F.lit(0)).cast(nodes.schema["tree_id"].dataType).alias("tree_id"))
    found = tree.beam_search(nodes, edges, asked.select("query_id", "tree_id", embedded(F.col("text"), conf).alias("embedding")), conf.tree_top_k, conf.start_layer)
    if conf.selection_mode == "threshold":
        found = ranking.at_least(found, conf.threshold)
    texts = nodes.where("text is not null").select("tree_id", "node_id", "layer", "text")
    kept = found.where(F.col("layer") <= conf.abstract_layer_as_context).join(texts, ["tree_id", "node_id", "layer"])
    if conf.abstract_layer_as_context > 0:
        kept = kept.withColumn("text", annotated(F.col("text"), F.col("layer"), F.col("node_id"), F.col("layer") > 0))
    dense = kept.select("query_id", "text", "rank", "node_id")
    if not (conf.hybrid_search or conf.rerank):
        return dense
    both = [dense]
    if conf.hybrid_search:
        leaves = nodes.where("layer = 0").select(F.col("node_id").alias("doc_id"), "tree_id", "text")
        hits = bm25.search(sparse or sparse_index(nodes, conf), asked, 5 * conf.sparse_top_k, "tree_id")
        named = bm25.distinct_texts(hits, leaves.withColumnRenamed("tree_id", "scope"), conf.sparse_top_k)
        both.append(named.select("query_id", "text", "rank", F.col("doc_id").alias("node_id")))
    if not conf.rerank:
        fused = ranking.fuse(both, "text", conf.rrf_k, conf.rerank_top_k)
        ids = both[0].unionByName(both[-1]).groupBy("query_id", "text").agg(F.min("node_id").alias("node_id"))
        return fused.join(ids, ["query_id", "text"]).select("query_id", "text", "rank", "node_id")
    make = backend(RERANKERS, conf.reranker)

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        model = make()
        out = pd.Series(0.0, index=q.index)
        for asked_, at in q.groupby(q).groups.items():  # a query's documents of a batch in one call
            out[at] = model.scores(asked_, list(t[at]))
        return out

    every = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    one = every.groupBy("query_id", "text").agg(F.min("node_id").alias("node_id")).join(asked.select("query_id", F.col("text").alias("q")), "query_id").withColumn("s", score("q", "text"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "node_id"))).where(F.col("rank") <= conf.rerank_top_k).select("query_id", "text", "rank", "node_id")


def documents_for(nodes: DataFrame, edges: DataFrame, conf: Config, sparse: bm25.Index | None = None) -> agent.Retrieve:
    """What an agent calls: the texts found for each question, joined."""

    sparse = sparse or sparse_index(nodes, conf)

    def run(questions: DataFrame) -> DataFrame:
        hits = retrieve(nodes, edges, questions, conf, sparse)
        return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("documents"))

    return run


def answered(nodes: DataFrame | None, edges: DataFrame | None, questions: DataFrame, conf: Config, sparse: bm25.Index | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(query_id and answer of every question, the rounds that led there or None). questions has query_id, question
    and, for forests, tree_id; see routed()."""
    make = backend(READERS, conf.reader)
    if conf.no_retrieval or nodes is None:
        return agent.single_shot(questions, None, make, conf.answer_type), None
    look = documents_for(nodes, edges, conf, sparse)
    if conf.max_retrieval_time == 0:
        return agent.single_shot(questions, look(questions.withColumnRenamed("question", "text")), make, conf.answer_type), None
    most = conf.max_retrieval_time
    if most == "auto":
        most = MOST_LOOKUPS
        planned = hops.budget(hops.load(conf.hop_model), questions.select("query_id", embedded(F.col("question"), conf).alias("embedding")))
        questions = questions.join(planned.select("query_id", "lookups"), "query_id", "left")
    return agent.run(questions, look, most, make, conf.answer_type, conf.max_response_length)


def answer(nodes: DataFrame | None, edges: DataFrame | None, questions: DataFrame, conf: Config) -> DataFrame:
    """query_id and answer of every question (query_id, question), by the configured way."""
    return answered(nodes, edges, questions, conf)[0]
