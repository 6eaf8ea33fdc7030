"""Similarity trees over vectors: spanning edges, layered merge, rebalancing, prototypes, forests and bucketed trees.

A tree depends on the pairs of vectors only through the maximum spanning tree, so nobody sorts all pairs. A tree of up
to LARGEST leaves is built in one task; larger ones are cut into buckets of similar vectors, each bucket is a tree of
its own, built in parallel, and a tree over the buckets' roots joins them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import written

MAX_CHILDREN, BUCKET, FANOUT, SAMPLE, ROUNDS = 40, 2048, 32, 8192, 5
#: Most leaves of a tree that one task builds (its work is quadratic in them); rounds of division by centres.
LARGEST, DEPTH = 16_384, 12
NODES = "tree_id int, node_id long, layer int, parent_id long, embedding array<double>"


def spanning_edges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """The maximum spanning tree of the dot products of all rows, as (similarity, u, v) with u > v, most similar
    first and ties by u, v. Each step adds the vector nearest to the tree; memory is a row, not a matrix."""
    n = len(x)
    if n < 2:
        return []
    best = x @ x[0]
    frm = np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    inside[0] = True
    out = []
    for _ in range(n - 1):
        k = int(np.where(inside, -np.inf, best).argmax())
        out.append((float(best[k]), max(k, int(frm[k])), min(k, int(frm[k]))))
        inside[k] = True
        s = x @ x[k]
        closer = (s > best) & ~inside
        best[closer], frm[closer] = s[closer], k
    return sorted(out, key=lambda e: (-e[0], e[1], e[2]))


def layered_merge(n: int, edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Parents and layers of the nodes of the tree over n leaves, given edges in rank order. Two trees of one height
    get a new parent; a lower tree becomes a child of the ancestor, of the other leaf, that is one layer above it. So
    all leaves are in layer 0 and every edge joins neighbouring layers. -1 is no parent."""
    parent, layer = [-1] * n, [0] * n

    def path(a: int) -> list[int]:
        out = [a]
        while parent[out[-1]] >= 0:
            out.append(parent[out[-1]])
        return out

    left = n - 1
    for u, v in edges:
        if left == 0:
            break
        pu, pv = path(u), path(v)
        a, b = pu[-1], pv[-1]
        if a == b:
            continue
        left -= 1
        if layer[a] == layer[b]:
            parent.append(-1)
            layer.append(layer[a] + 1)
            parent[a] = parent[b] = len(parent) - 1
        elif layer[a] < layer[b]:
            parent[a] = pv[layer[a] + 1]
        else:
            parent[b] = pu[layer[b] + 1]
    return parent, layer


def rebalance(parent: list[int], layer: list[int], most: int | None = MAX_CHILDREN, keep_first: bool = False) -> None:
    """Nodes between the leaves and the root's layer with too many children are cut, in place: m children become
    m // most + 1 pieces (so m = most is cut too); the first stays, the others are new siblings. keep_first leaves
    layer 1 alone."""
    if not most or most <= 1 or not layer:
        return
    height = max(layer)
    children: dict[int, list[int]] = {}
    for c, p in enumerate(parent):
        if p >= 0:
            children.setdefault(p, []).append(c)
    for level in range(2 if keep_first else 1, height):
        queue = [k for k in range(len(layer)) if layer[k] == level]
        for node in queue:  # grows while it is walked: new siblings are looked at again
            own = children.get(node, [])
            pieces = len(own) // most + 1
            if pieces < 2:
                continue
            cuts = [i * len(own) // pieces for i in range(pieces + 1)]
            children[node] = own[: cuts[1]]
            for i in range(1, pieces):
                new = len(parent)
                parent.append(parent[node])
                layer.append(level)
                children[new] = own[cuts[i] : cuts[i + 1]]
                for c in children[new]:
                    parent[c] = new
                children.setdefault(parent[node], []).append(new)
                queue.append(new)


def prototypes(parent: list[int], layer: list[int], x: np.ndarray) -> np.ndarray:
    """Embeddings of all nodes: an inner node's is the mean of its children's, layer by layer."""
    out = np.zeros((len(parent), x.shape[1]))
    out[: len(x)] = x
    up, lay = np.array(parent), np.array(layer)
    for level in range(1, int(lay.max(initial=0)) + 1):
        kids = np.flatnonzero((lay == level - 1) & (up >= 0))
        sums, count = np.zeros_like(out), np.zeros(len(out))
        np.add.at(sums, up[kids], out[kids])
        np.add.at(count, up[kids], 1)
        here = np.flatnonzero(lay == level)
        out[here] = sums[here] / np.maximum(count[here], 1)[:, None]
    return out


def grow(x: np.ndarray, most: int | None = MAX_CHILDREN) -> tuple[list[int], list[int], np.ndarray]:
    """Parents, layers and embeddings of the tree over the rows of x."""
    edges = [(u, v) for _, u, v in spanning_edges(x)]
    parent, layer = layered_merge(len(x), edges)
    rebalance(parent, layer, most)
    return parent, layer, prototypes(parent, layer, x)


def grow_from_links(x: np.ndarray, links: list[tuple[int, int]], most: int | None = MAX_CHILDREN) -> tuple[list[int], list[int], np.ndarray]:
    """The tree over the rows of x when only some pairs are known (those of near neighbours): what they leave apart is
    joined first, each component to the largest one by the best dot product between the two."""
    n = len(x)
    label = np.arange(n)

    def find(a: int) -> int:
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    known = {(max(a, b), min(a, b)) for a, b in links if a != b}
    for a, b in known:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)
    roots = np.array([find(k) for k in range(n)])
    names, sizes = np.unique(roots, return_counts=True)
    anchor = np.flatnonzero(roots == names[sizes.argmax()]) if n else roots
    for name in names:
        own = np.flatnonzero(roots == name)
        if own[0] != anchor[0]:
            s = x[own] @ x[anchor].T
            i, j = np.unravel_index(int(s.argmax()), s.shape)
            known.add((max(int(own[i]), int(anchor[j])), min(int(own[i]), int(anchor[j]))))
    ranked = sorted(((float(x[u] @ x[v]), u, v) for u, v in known), key=lambda e: (-e[0], e[1], e[2]))
    parent, layer = layered_merge(n, [(u, v) for _, u, v in ranked])
    rebalance(parent, layer, most)
    return parent, layer, prototypes(parent, layer, x)


def _frame(tree: int, ids: np.ndarray, parent: list[int], layer: list[int], emb: np.ndarray, base: int) -> pd.DataFrame:
    """Nodes as rows: leaves keep their ids, inner nodes are numbered from base."""
    n = len(ids)
    number = np.r_[ids, base + np.arange(len(parent) - n)].astype(np.int64)
    up = [None if p < 0 else int(number[p]) for p in parent]
    return pd.DataFrame({"tree_id": tree, "node_id": number, "layer": layer, "parent_id": pd.array(up, "Int64"), "embedding": list(emb)})


def neighbour_links(x: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Each row with its k most similar others by cosine, ties by position."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out = []
    for lo in range(0, len(u), 512):
        s = u[lo : lo + 512] @ u.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out += [(lo + a, int(b)) for a, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(u) - 1)]) for b in row]
    return out


def star(n: int) -> tuple[list[int], list[int]]:
    """Parents and layers of n leaves under one root: the shape of a tree that can't be built otherwise."""
    return [n] * n + [-1], [0] * n + [1]


def forest(leaves: DataFrame, most: int | None = MAX_CHILDREN) -> DataFrame:
    """The nodes (tree_id, node_id, layer, parent_id, embedding) of one tree per tree_id, built in parallel.

    leaves has tree_id, node_id (unique in its tree) and embedding; null vectors are left out; rows of one node_id
    count once. Inner nodes are numbered per tree from the tree's greatest leaf id on, so ids are unique in a tree.
    A tree whose vectors have several lengths becomes a star under one root without an embedding.
    One task holds a whole tree; grown() sends those of more than LARGEST leaves through bucketed_tree.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node_id").sort_values("node_id")
        ids = pdf["node_id"].to_numpy()
        try:
            parts = grow(np.array(pdf["embedding"].tolist(), np.float64), most)
        except ValueError:  # vectors of several lengths
            parent, layer = star(len(ids))
            parts = parent, layer, [*pdf["embedding"], None]
        return _frame(int(pdf["tree_id"].iloc[0]), ids, *parts, base=int(ids.max()) + 1)

    return leaves.where("embedding is not null and node_id is not null").select("tree_id", "node_id", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("tree_id").applyInPandas(build, NODES)


def grown(leaves: DataFrame, most: int | None = MAX_CHILDREN, bucket: int = BUCKET, largest: int = LARGEST) -> DataFrame:
    """As forest(), for trees of any size: those of more than `largest` leaves are built in buckets, one after the
    other; there can't be more of them than leaves / largest. Their names come to the driver."""
    rows = leaves.where("embedding is not null and node_id is not null")
    big = [r.tree_id for r in rows.groupBy("tree_id").agg(F.count_distinct("node_id").alias("n")).where(F.col("n") > largest).collect()]
    if not big:
        return forest(rows, most)
    out = forest(rows.where(~F.col("tree_id").isin(big)), most)
    for t in big:
        out = out.unionByName(bucketed_tree(rows.where(F.col("tree_id") == t), bucket, most, t))
    return out


def neighbour_tree(leaves: DataFrame, k: int = 32, most: int | None = MAX_CHILDREN, tree_id: int = 0) -> DataFrame:
    """The nodes of one tree from the links of each leaf with its k nearest others, by cosine, ranked by dot product.
    The links are found in parallel and folded in one task; for more leaves than that holds, see bucketed_tree."""
    from .nearest import search

    rows = leaves.where("embedding is not null").dropDuplicates(["node_id"]).select(F.col("node_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    near = search(rows, rows, k, include_self=False).groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_list("vec_id").alias("near"))
    joined = rows.join(near, "vec_id", "left").withColumn("tree_id", F.lit(tree_id))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids = pdf["vec_id"].to_numpy()
        at = {int(i): k for k, i in enumerate(ids)}
        links = [(at[int(a)], at[int(b)]) for a, bs in zip(ids, pdf["near"]) if bs is not None for b in bs]
        return _frame(tree_id, ids, *grow_from_links(np.array(pdf["embedding"].tolist(), np.float64), links, most), base=int(ids.max()) + 1)

    return joined.groupBy("tree_id").applyInPandas(build, NODES)


def document_tree(leaves: DataFrame, most: int | None = MAX_CHILDREN, bucket: int = BUCKET, tree_id: int = 0) -> DataFrame:
    """The nodes of one tree whose first layer are the documents: a node per document_index over its leaves, with their
    mean, and a tree over those (in buckets, if they are more than one holds). leaves has node_id, document_index and
    embedding; leaves without a document are left out. Ids are unique; rebalancing leaves the documents whole."""
    from .nearest import prototypes as means

    rows = written(leaves.where("embedding is not null and document_index is not null").dropDuplicates(["node_id"]).select("node_id", "document_index", F.col("embedding").cast("array<double>").alias("embedding")), "rows")
    base = (rows.agg(F.max("node_id")).first()[0] or 0) + 1
    docs = written(means(rows, "document_index").select((F.col("document_index") + base).cast("long").alias("node_id"), "embedding"), "documents")
    n = docs.count()
    upper = bucketed_tree(docs, bucket, most, tree_id) if n > bucket else forest(docs.withColumn("tree_id", F.lit(tree_id)), most)
    upper = upper.select("tree_id", "node_id", (F.col("layer") + 1).alias("layer"), "parent_id", "embedding")
    below = rows.select(F.lit(tree_id).alias("tree_id"), "node_id", F.lit(0).alias("layer"), (F.col("document_index") + base).cast("long").alias("parent_id"), "embedding")
    return below.unionByName(upper)


def partition(leaves: DataFrame, bucket: int = BUCKET, fanout: int = FANOUT, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """leaves with `bucket`, so that no bucket holds more than so many vectors: oversized parts are divided among
    centres (evenly spaced rows of an evenly spaced sample of bounded size, moved `rounds` times to the mean direction
    of their vectors; an empty centre restarts at a sampled row), again and again. A part that won't divide, or is still
    too large after DEPTH rounds, is cut by hashes of ids, until none is over the limit. Samples are about `sample` rows
    per oversized part, and one pass serves all parts."""
    part = written(leaves.where("embedding is not null").select("node_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit("0").alias("bucket")), "part")
    spark = leaves.sparkSession

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        k = int(pdf["k"].iloc[0])
        s = np.array(pdf["embedding"].tolist(), np.float64)
        s = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
        c = s[np.linspace(0, len(s) - 1, k).astype(int)]
        for r in range(rounds):
            a = (s @ c.T).argmax(1)
            for j in range(k):
                own = s[a == j]
                m = own.mean(0) if len(own) else s[(r + j) % len(s)]
                c[j] = m / max(np.linalg.norm(m), 1e-12)
        c = c[np.unique((s @ c.T).argmax(1))]
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "centres": [list(map(list, c))]})

    depth = 0
    while True:
        over = part.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        sizes = {r.bucket: r.n for r in over.collect()}
        if not sizes:
            break
        # All oversized parts' samples in one pass, each part's centres in a task of its own. A sample is a slice of
        # hashes, so its size is near its aim: never under k rows, which an aim of 8 k and more assures.
        models: dict[str, np.ndarray | None] = dict.fromkeys(sizes)
        if depth < DEPTH:
            k = F.least(F.greatest(F.lit(2), F.ceil(F.col("n") / bucket)), F.lit(fanout), F.col("n")).cast("int")
            aims = over.withColumn("k", k).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(8 * F.col("k"), F.lit(sample)))))
            drawn = part.join(F.broadcast(aims), "bucket").where(F.pmod(F.xxhash64("node_id"), F.col("step")) == 0)
            for r in drawn.groupBy("bucket").applyInPandas(fit, "bucket string, centres array<array<double>>").toLocalIterator():
                models[r.bucket] = np.array(r.centres) if len(r.centres) > 1 else None
        depth += 1
        held = spark.sparkContext.broadcast((models, sizes))

        def divide(it, held=held, turn=depth):  # noqa: ANN001, ANN202
            models, sizes = held.value
            for pdf in it:
                names = pdf["bucket"].to_numpy().astype(object)
                for name in set(names):
                    at = np.flatnonzero(names == name)
                    if name not in sizes:
                        continue
                    if models[name] is None:
                        runs = -(-sizes[name] // bucket) * 2
                        h = (pdf["node_id"].to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) >> np.uint64(24)
                        names[at] = [f"{name}.{int(v % runs)}" for v in h]
                    else:
                        x = np.array(pdf["embedding"].iloc[at].tolist(), np.float64)
                        names[at] = [f"{name}.{int(j)}" for j in (x @ models[name].T).argmax(1)]
                yield pdf.assign(bucket=names)

        part = written(part.mapInPandas(divide, "node_id long, embedding array<double>, bucket string"), "part")
    return part


def bucketed_tree(leaves: DataFrame, bucket: int = BUCKET, most: int | None = MAX_CHILDREN, tree_id: int = 0, knn: int | None = None) -> DataFrame:
    """The nodes of one tree over any number of leaves: a fragment per bucket, their roots raised to one layer by
    chains of single children, numbers made global by prefix sums over the buckets, and a tree over the roots.

    leaves has node_id (unique, up to 2^62) and embedding. Inner nodes are numbered from the greatest leaf id on. With
    knn, a bucket's tree comes from the links of each leaf with its knn nearest others in the bucket.
    """
    part = partition(leaves.dropDuplicates(["node_id"]), bucket)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        x = np.array(pdf["embedding"].tolist(), np.float64)
        parent, layer, emb = grow_from_links(x, neighbour_links(x, knn), most) if knn else grow(x, most)
        up = pd.array([None if p < 0 else p for p in parent], "Int64")
        ids = np.r_[pdf["node_id"].to_numpy(), np.full(len(parent) - len(pdf), -1)]
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "local": range(len(parent)), "leaf_id": ids, "layer": layer, "up": up, "embedding": list(emb)})

    local = written(part.groupBy("bucket").applyInPandas(build, "bucket string, local long, leaf_id long, layer int, up long, embedding array<double>"), "fragments")
    # One row per bucket: how many inner nodes it has, and how high it is. Both are small tables of the bucket count.
    stats = local.groupBy("bucket").agg(F.count_if(F.col("leaf_id") < 0).alias("inner"), F.max("layer").alias("height"), F.max("leaf_id").alias("greatest"))
    stats = stats.withColumn("tallest", F.max("height").over(W.partitionBy())).withColumn("base", F.max("greatest").over(W.partitionBy()) + 1)
    size = F.col("inner") + F.col("tallest") - F.col("height")
    stats = written(stats.withColumn("offset", F.coalesce(F.sum(size).over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "stats")
    joined = local.join(stats, "bucket")
    order = F.row_number().over(W.partitionBy("bucket", F.col("leaf_id") < 0).orderBy("local")) - 1
    numbered = joined.withColumn("node_id", F.when(F.col("leaf_id") >= 0, F.col("leaf_id")).otherwise(F.col("base") + F.col("offset") + order))
    numbered = written(numbered.select("bucket", "local", "node_id", "layer", "up", "embedding", "height", "tallest", "base", "offset", "inner"), "numbered")
    parents = numbered.select("bucket", F.col("local").alias("up"), F.col("node_id").alias("parent_id"))
    below = numbered.where("up is not null").join(parents, ["bucket", "up"]).select("node_id", "layer", "parent_id", "embedding")
    roots = numbered.where("up is null")
    # A root that is too low: a chain of single children up to the tallest layer.
    first = F.col("base") + F.col("offset") + F.col("inner")
    chain = roots.where("height < tallest").select("bucket", "embedding", "height", first.alias("first"), "tallest", F.explode(F.sequence(F.col("height") + 1, F.col("tallest"))).alias("layer"))
    chain = chain.withColumn("node_id", F.col("first") + F.col("layer") - F.col("height") - 1).withColumn("parent_id", F.when(F.col("layer") < F.col("tallest"), F.col("node_id") + 1))
    low = roots.select("node_id", "layer", F.when(F.col("height") < F.col("tallest"), first).alias("parent_id"), "embedding")
    fragments = below.unionByName(low).unionByName(chain.select("node_id", "layer", "parent_id", "embedding"))
    fragments = written(fragments, "tree")
    tops = fragments.where("parent_id is null")
    lift = stats.agg(F.max("tallest"), F.max("base"), F.sum(size)).first()
    height, base = int(lift[0] or 0), int(lift[1] or 0) + int(lift[2] or 0)
    if tops.count() <= max(bucket, 2):
        meta = forest(tops.select(F.lit(tree_id).alias("tree_id"), "node_id", "embedding"), most)
    else:
        meta = bucketed_tree(tops.select("node_id", "embedding"), bucket, most, tree_id)
    meta = written(meta, "meta")
    top = meta.agg(F.max(F.when(F.col("layer") == 0, F.col("node_id")))).first()[0]
    shift = base - (int(top) + 1 if top is not None else 0)  # inner nodes of the upper tree follow all others
    moved = lambda c: F.when(F.col(c) > F.lit(top), F.col(c) + shift).otherwise(F.col(c))
    upper = meta.where("layer > 0").select(moved("node_id").alias("node_id"), (F.col("layer") + height).alias("layer"), moved("parent_id").alias("parent_id"), "embedding")
    links = meta.where("layer = 0").select("node_id", moved("parent_id").alias("above"))
    lower = fragments.join(links, "node_id", "left").select("node_id", "layer", F.coalesce("parent_id", "above").alias("parent_id"), "embedding")
    return lower.unionByName(upper).select(F.lit(tree_id).alias("tree_id"), "node_id", "layer", "parent_id", "embedding")


def edges_of(nodes: DataFrame) -> DataFrame:
    """tree_id, parent_id and child_id of nodes with their parents."""
    return nodes.where("parent_id is not null").select("tree_id", "parent_id", F.col("node_id").alias("child_id"))


def health(nodes: DataFrame) -> DataFrame:
    """Per tree: leaves, inner nodes, layers, roots, children that aren't one layer below their parent, and inner
    nodes without children. A sound tree has one root and two zeros."""
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("layer").alias("above"))
    j = nodes.join(up, ["tree_id", "parent_id"], "left")
    own = j.groupBy("tree_id").agg(
        F.count_if(F.col("layer") == 0).alias("leaves"), F.count_if(F.col("layer") > 0).alias("inner"), (F.max("layer") + 1).alias("layers"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNotNull() & (F.coalesce(F.col("above"), F.lit(-1)) != F.col("layer") + 1)).alias("misplaced"),
    )
    used = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    bare = nodes.where("layer > 0").join(used, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count("*").alias("childless"))
    return own.join(bare, "tree_id", "left").withColumn("childless", F.coalesce("childless", F.lit(0)))


def ancestors(nodes: DataFrame, edges: DataFrame, height: int | None = None) -> DataFrame:
    """tree_id, node_id, layer and ancestor_id: of each leaf its first parent (the least id) in every layer upwards.
    One join per layer, for all nodes of all trees at once."""
    first = edges.where("parent_id is not null and child_id is not null").groupBy("tree_id", "child_id").agg(F.min("parent_id").alias("parent_id"))
    height = height or nodes.agg(F.max("layer")).first()[0] or 0
    now = nodes.where("layer = 0").select("tree_id", "node_id").distinct().withColumn("at", F.col("node_id"))
    out = None
    for level in range(1, height + 1):
        now = now.join(first.withColumnRenamed("child_id", "at"), ["tree_id", "at"]).select("tree_id", "node_id", F.col("parent_id").alias("at"))
        part = now.select("tree_id", "node_id", F.lit(level).alias("layer"), F.col("at").alias("ancestor_id"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else now.select("tree_id", "node_id", F.lit(0).alias("layer"), F.col("at").alias("ancestor_id")).where("false")


def start_layers(nodes: DataFrame, top_k: int) -> DataFrame:
    """tree_id and start_layer: the highest layer that has at least top_k nodes; trees without one are left out."""
    return nodes.select("tree_id", "layer", "node_id").distinct().groupBy("tree_id", "layer").agg(F.count("*").alias("n")).where(F.col("n") >= top_k).groupBy("tree_id").agg(F.max("layer").alias("start_layer"))


def beam_search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, top_k: int = 5, start_layer: int | None = None) -> DataFrame:
    """query_id, tree_id, layer, rank, node_id and score ((1 + cosine) / 2): the best top_k nodes of each layer from the
    start layer down to the leaves, each layer among the children of the last one's; all queries at once.

    nodes has tree_id, node_id, layer and embedding; edges tree_id, parent_id and child_id; queries query_id, tree_id
    and embedding. Nodes without a vector are never found; of nodes with equal vectors under one query only the least id
    stays; ties go to the lesser id. A start_layer above a tree counts as its top; without one it is start_layers()', or the
    leaves of a tree too small for that.
    """
    from ..functions.distances import cosine_distance

    held = written(nodes.where("embedding is not null").select("tree_id", "node_id", "layer", F.col("embedding").alias("nv")).dropDuplicates(["tree_id", "node_id"]), "held")
    links = edges.select("tree_id", "parent_id", "child_id").distinct()
    if start_layer is None:
        starts = held.select("tree_id").distinct().join(start_layers(held, top_k), "tree_id", "left").select("tree_id", F.coalesce("start_layer", F.lit(0)).alias("start_layer"))
    else:
        starts = held.groupBy("tree_id").agg(F.least(F.max("layer"), F.lit(start_layer)).alias("start_layer"))
    asked = queries.select("query_id", "tree_id", F.col("embedding").alias("qv")).join(starts, "tree_id")
    highest = starts.agg(F.max("start_layer")).first()[0]
    empty = nodes.sparkSession.createDataFrame([], "query_id long, tree_id int, layer int, rank int, node_id long, score double")
    if highest is None:
        return empty
    out, front = None, None
    order = W.partitionBy("query_id", "tree_id").orderBy(F.asc_nulls_last("d"), "node_id")
    for level in range(int(highest), -1, -1):
        begun = asked.where(F.col("start_layer") == level).join(held.where(F.col("layer") == level), "tree_id").select("query_id", "tree_id", "qv", "node_id", "nv")
        if front is not None:
            down = front.join(links.withColumnRenamed("parent_id", "node_id"), ["tree_id", "node_id"]).select("query_id", "tree_id", F.col("child_id").alias("node_id")).distinct()
            down = down.join(held.where(F.col("layer") == level).select("tree_id", "node_id", "nv"), ["tree_id", "node_id"]).join(asked.select("query_id", "tree_id", "qv"), ["query_id", "tree_id"])
            begun = begun.unionByName(down.select(*begun.columns))
        scored = begun.select("query_id", "tree_id", "node_id", F.xxhash64("nv").alias("h"), F.round(cosine_distance(F.col("qv"), F.col("nv")), 9).alias("d"))
        scored = scored.groupBy("query_id", "tree_id", "h").agg(F.min("d").alias("d"), F.min("node_id").alias("node_id"))
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
        best = written(best.select("query_id", "tree_id", F.lit(level).alias("layer"), "rank", "node_id", ((2 - F.col("d")) / 2).alias("score")), "beam")
        front = best.select("query_id", "tree_id", "node_id")
        out = best if out is None else out.unionByName(best)
    return out
