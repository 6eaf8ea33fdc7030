"""Exact vector search: blocks of the base against a stated set of queries, and all pairs in tiles.

The products are made by matrix multiplication in Arrow batches, never by a nested-loop join. A query side within a
stated bound is broadcast; a larger one meets the base in a grid of blocks of both sides, so nobody holds either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Most query vectors that are broadcast; vectors of a side in one block of the grid.
QUERIES, TILE = 20_000, 32_768


def _rows(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query (row) to every vector (column); NaN where a cosine is undefined."""
    if metric in ("cosine", "dot"):
        s = q @ x.T
        if metric == "dot":
            return -s
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - s / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    out = np.empty((len(q), len(x)))
    for k, row in enumerate(q):
        d = np.abs(x - row)
        out[k] = d.sum(1) if metric == "l1" else np.sqrt((d * d).sum(1)) if metric == "l2" else d.max(1)
    return out


def _kept(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, metric: str, include_self: bool):  # noqa: ANN202
    """The k best of a block of vectors for each query, as record batches; whatever ties with the k-th stays, so that
    ties go by id in the end."""
    for lo in range(0, len(ids), 1024) if len(own) else ():
        d = distances(q[lo : lo + 1024], v, metric)
        key = np.where(np.isnan(d), np.inf, d)
        if not include_self:
            key = np.where(ids[lo : lo + 1024, None] == own[None, :], np.nan, key)
        at = min(k, key.shape[1]) - 1
        kth = np.partition(key, at, axis=1)[:, at : at + 1]
        r, c = np.nonzero((key <= kth) | (np.isnan(kth) & ~np.isnan(key)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + r]), pa.array(own[c]), pa.array(d[r, c], from_pandas=True)], names=["query_id", "vec_id", "distance"])


def search(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", include_self: bool = True) -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest vectors of every query, exactly; ties by vec_id.

    base and queries have vec_id and embedding, all of one length; null vectors are left out. A query is its own
    neighbour unless include_self is false. Undefined distances (zero vectors) come last, as null. An empty side gives
    an empty result. Each batch of the base keeps its k best per query, so what is shuffled is k rows per query and
    batch at most, and the ranking is merged per query.
    """
    spark = base.sparkSession
    q = queries.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    x = base.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    n = q.count()
    schema = "query_id long, vec_id long, distance double"
    if n <= QUERIES:
        table = q.toArrow().combine_chunks()
        ids = table.column("vec_id").to_numpy() if len(table) else np.zeros(0, np.int64)
        held = spark.sparkContext.broadcast((ids, _rows(table.column("e").combine_chunks()) if len(table) else np.zeros((0, 0))))

        def run(batches):  # noqa: ANN001, ANN202
            ids, v = held.value
            for b in batches:
                yield from _kept(ids, v, b.column(0).to_numpy(), _rows(b.column(1)), k, metric, include_self)

        found = x.mapInArrow(run, schema)
    else:
        across, down = -(-x.count() // TILE) or 1, -(-n // TILE)
        place = lambda seed, most: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(most)).cast("int")
        every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
        own = x.withColumn("i", place(1, across)).withColumn("j", every(down)).withColumn("asks", F.lit(False))
        asking = q.withColumn("j", place(2, down)).withColumn("i", every(across)).withColumn("asks", F.lit(True))

        def meet(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            ids, e = table.column("vec_id").to_numpy(), table.column("e").combine_chunks()
            if not asks.any() or asks.all():
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            v = _rows(e)
            return pa.Table.from_batches(list(_kept(ids[asks], v[asks], ids[~asks], v[~asks], k, metric, include_self)))

        found = own.unionByName(asking).groupBy("i", "j").applyInArrow(meet, schema)
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last(F.round("distance", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def every_hundredth(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """The stated query set of searches: the rows whose id is divisible by 100."""
    return rows.where(F.col(key) % 100 == 0)


def undirected(neighbours: DataFrame) -> DataFrame:
    """u > v and similarity of the links between vectors and their neighbours, each once, most similar first in rank;
    ties by u, v. neighbours has query_id, vec_id and distance (of a dot product or cosine)."""
    links = neighbours.select(F.greatest("query_id", "vec_id").alias("u"), F.least("query_id", "vec_id").alias("v"), (-F.col("distance")).alias("similarity")).where("u <> v")
    return links.groupBy("u", "v").agg(F.max("similarity").alias("similarity"))


def assign(rows: DataFrame, centres: DataFrame, most: int = 10_000) -> DataFrame:
    """vec_id, centre_id and score of each vector's best centre by dot product with the unit centre; ties to the lesser
    id. centres has centre_id and embedding; over `most` of them raises, as they are broadcast."""
    table = centres.select("centre_id", F.col("embedding").cast("array<double>").alias("e")).orderBy("centre_id").limit(most + 1).toArrow().combine_chunks()
    if len(table) > most:
        raise ValueError(f"more than {most} centres")
    ids = table.column("centre_id").to_numpy() if len(table) else np.zeros(0, np.int64)
    c = _rows(table.column("e").combine_chunks()) if len(table) else np.zeros((0, 0))
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if len(c) else c
    held = rows.sparkSession.sparkContext.broadcast((ids, c))

    def run(batches):  # noqa: ANN001, ANN202
        ids, c = held.value
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            s = _rows(b.column(1)) @ c.T
            best = s.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[best].astype(np.int64)), pa.array(s[np.arange(len(s)), best])], names=["vec_id", "centre_id", "score"])

    return rows.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, centre_id long, score double")


def prototypes(rows: DataFrame, by: str) -> DataFrame:
    """by and embedding: the element-wise mean of the vectors of each group. Sums combine before they are shuffled."""
    each = rows.where(F.col("embedding").isNotNull() & F.col(by).isNotNull()).select(by, F.posexplode("embedding").alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("embedding"))
