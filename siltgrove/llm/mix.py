"""Mixing sources to target shares, by fixed-length blocks drawn without moving text.

The tokens (or words) of a source, laid end to end, are cut into blocks of fixed length; only sizes are needed for
that, so texts stay where they are. A source's quota of blocks is its share of the mix, at most its blocks times
its cap. Output shards draw how many of their slots each source fills (multinomial draws, without replacement from
the quotas, so that the totals hold); a slot is the n-th use of its source, and a keyed pseudorandom permutation of
the source's block numbers, a new one for every pass, tells the block. Slots and blocks meet in an equi-join by
block number.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .split import WORD

BLOCK = 2048
SHARD_SLOTS = 4096
#: Spans of doc ids over which sizes are summed before positions are laid out; bounds the table of span sums.
SPANS = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenising pattern that belongs to that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bytes of a vocabulary file, at most: the driver reads it and sends it out, so that executors need not have it.
MAX_VOCABULARY = 32_000_000
_encoder: dict[str, object] = {}


def _tokenizer(path: str, ranks: bytes):  # noqa: ANN202
    if path not in _encoder:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoder[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoder[path]


def spelled(source: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.trim(source))


def sizes(docs: DataFrame, unit: str = "words", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (without case and outer blanks) and size of each document with a source. A null text has size
    0. unit is ``words`` (counted on the JVM side) or ``tokens`` of the public tokenizer whose ranks are at
    vocabulary."""
    docs = docs.where("source is not null").select(F.col("doc_id").cast("long"), spelled(F.col("source")).alias("source"), "text")
    if unit == "words":
        return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))

    if os.path.getsize(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):  # noqa: ANN001, ANN202
        encode = _tokenizer(vocabulary, ranks.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(encode(t)) if t else 0 for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "source", "size"])

    return docs.mapInArrow(count, "doc_id long, source string, size long")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets, spelled as there: source, key, target_share, max_repeats, available (its size),
    total (the size of all documents with a source), wanted = target_share x total, usable = available x
    max_repeats, allotted (the units that the mix gives the source: the lesser of the two; quotas of blocks follow from
    it) and short (what is allotted falls short of what is wanted). A target spelled in several ways counts once per spelling; a source that
    has no documents has available 0; null shares or repeats count as 0."""
    have = sized.groupBy("source").agg(F.sum("size").alias("available"))
    every = W.partitionBy()  # over one row per source
    have = have.withColumn("total", F.sum("available").over(every))
    t = targets.where("source is not null").select("source", spelled(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    joined = t.join(have.withColumnRenamed("source", "key"), "key", "left").withColumn("total", F.coalesce(F.max("total").over(every), F.lit(0).cast("long")))
    joined = joined.withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    joined = joined.withColumns({"wanted": F.col("target_share") * F.col("total"), "usable": F.col("available") * F.col("max_repeats")})
    return joined.withColumn("allotted", F.least("wanted", "usable")).withColumn("short", F.col("allotted") < F.col("wanted"))


def positions(sized: DataFrame) -> DataFrame:
    """source, doc_id, size and the offset of each document in its source, laid end to end in the order of
    (span, doc_id), where a span is a range of hashes of doc_id. Sizes are summed per source and span first, and the
    window for the offsets runs within a span: no task holds a whole source, not even one with a third of all rows.
    """
    s = sized.where("size > 0").withColumn("span", F.pmod(F.xxhash64("doc_id"), F.lit(SPANS)).cast("int"))
    sums = s.groupBy("source", "span").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("span").rowsBetween(W.unboundedPreceding, -1)))
    within = s.withColumn("inner", F.sum("size").over(W.partitionBy("source", "span").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)))
    return within.join(before.select("source", "span", "before"), ["source", "span"]).select("source", "doc_id", "size", (F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("offset"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), evaluated at index: a keyed Feistel network over the next even number
    of bits, walked until it falls within range."""
    half = max(1, (max(2, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        left, right = y >> np.uint64(half), y & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                h = (right + np.uint64((key * 4 + r + 1) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def quotas(rows: list, block: int) -> dict[str, tuple[int, int]]:
    """Blocks there are and blocks to use of each source: the mix has the size of all documents, in blocks; each
    source gets its share of it as far as its cap allows."""
    out = {}
    for r in rows:
        blocks = math.ceil(r.available / block)
        out[r.key] = (blocks, int(min(round(r.allotted / block), blocks * r.max_repeats)))
    return out


def slots(planned: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """shard, slot, source, block_no, use_no: the mix, one row per slot. planned is plan()'s table; it has one row per
    source and comes to the driver, as do the counts of a source per shard; the slots are made in the executors."""
    rows = planned.collect()
    quota = quotas(rows, block)
    keys = sorted(quota)
    left = np.array([quota[k][1] for k in keys], np.int64)
    shards = max(1, math.ceil(int(left.sum()) / shard_slots))
    spark = planned.sparkSession
    blocks = {k: quota[k][0] for k in keys}

    def draw(group: int, groups: int, counts: np.ndarray) -> np.ndarray:
        """Of each source, how many of the slots go to the first group shards of groups: a multivariate
        hypergeometric draw, which is the multinomial one given the totals."""
        rng = np.random.default_rng([seed, group, groups])
        want = int(counts.sum()) * group // groups
        if want == 0:
            return np.zeros_like(counts)
        return drawn(rng, counts, want)

    def ranges(shard: int) -> tuple[np.ndarray, np.ndarray]:
        """First use and number of uses of each source in a shard, found by halving the range of shards: each shard
        works out its own share, and nobody holds the table of all of them."""
        low, high, start, counts = 0, shards, np.zeros_like(left), left.copy()
        while high - low > 1:
            mid = (low + high) // 2
            first = draw(mid - low, high - low, counts)
            if shard < mid:
                high, counts = mid, first
            else:
                low, start, counts = mid, start + first, counts - first
        return start, counts

    def make(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, n = ranges(shard)
                source = np.repeat(np.arange(len(keys)), n)
                use = np.concatenate([np.arange(a, a + k) for a, k in zip(start, n)]) if n.sum() else np.zeros(0, np.int64)
                block_no = np.empty(len(use), np.int64)
                for k, key in enumerate(keys):
                    mine = np.flatnonzero(source == k)
                    if not len(mine):
                        continue
                    size = blocks[key]
                    lap = use[mine] // size
                    for turn in np.unique(lap):
                        at = mine[lap == turn]
                        block_no[at] = permuted(use[at] % size, size, seed * 1_000_003 + k * 1009 + int(turn))
                order = np.random.default_rng([seed, shard]).permutation(len(use))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), shard)), pa.array(np.arange(len(use))), pa.array(np.array(keys, object)[source[order]], pa.string()), pa.array(block_no[order]), pa.array(use[order] // np.array([max(1, blocks[x]) for x in keys])[source[order]])], names=["shard", "slot", "source", "block_no", "use_no"])

    ids = spark.range(shards, numPartitions=min(shards, max(1, spark.sparkContext.defaultParallelism * 4)))
    return ids.mapInArrow(make, "shard long, slot long, source string, block_no long, use_no long")


def drawn(rng: np.random.Generator, counts: np.ndarray, want: int) -> np.ndarray:
    """How many of each kind are among want drawn without replacement. From 1 000 000 000 on, where numpy's draw ends,
    one kind after the other by the normal limit of its hypergeometric number."""
    if counts.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, want, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        if rest < 1_000_000_000:
            out[k:] = rng.multivariate_hypergeometric(counts[k:], want, method="marginals")
            break
        p = n / rest
        x = round(rng.normal(want * p, math.sqrt(want * p * (1 - p) * (rest - want) / (rest - 1))))
        out[k] = min(max(x, 0, want - (rest - n)), n, want)
        want, rest = want - int(out[k]), rest - n
    return out


def mixed(sized: DataFrame, planned: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mix: shard, slot, source, block_no, use_no, doc_id, from_unit and to_unit: which units of which document a
    slot holds, in order. A block over several documents has a row for each; the last block of a source may be
    short. No text is moved: a reader takes the units of a document from the corpus.

    Documents without source, or of a source without target, aren't used; null and empty texts have no units. A
    source with several rows of targets under other spellings must be given once. Empty tables give an empty mix.
    """
    at = positions(sized)
    parts = at.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
    low, high = F.col("block_no") * block, (F.col("block_no") + 1) * block
    parts = parts.select("source", "block_no", "doc_id", F.greatest(low - F.col("offset"), F.lit(0)).cast("long").alias("from_unit"), F.least(high - F.col("offset"), F.col("size")).cast("long").alias("to_unit"))
    return slots(planned, block, shard_slots, seed).join(parts, ["source", "block_no"]).select("shard", "slot", "source", "block_no", "use_no", "doc_id", "from_unit", "to_unit")


def shares(mix: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source of the targets: target_share, actual_share (of the units of the mix), units, max_use (times that its
    most used block is used) and short."""
    used = mix.groupBy("source").agg(F.sum(F.col("to_unit") - F.col("from_unit")).alias("units"), (F.max("use_no") + 1).alias("max_use"))
    joined = planned.join(used.withColumnRenamed("source", "key"), "key", "left").withColumn("mix_units", F.sum("units").over(W.partitionBy()))
    return joined.select("source", "target_share", F.coalesce(F.col("units") / F.col("mix_units"), F.lit(0.0)).alias("actual_share"), F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("max_use", F.lit(0)).alias("max_use"), "max_repeats", "short")
