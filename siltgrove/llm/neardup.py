"""Near-duplicate groups by vertical partitioning of a global n-gram order.

Distinct n-grams are ordered from rare to frequent, and the order is cut into fragments. The first is each set's own
rare end (its prefix), as far as two sets must share a gram of it to be similar: an equi-join by gram counts the
overlap of all pairs there. That count plus what is left of the set whose prefix ends first bounds a pair's whole
overlap; the few pairs that can still reach the threshold get their overlaps counted in every other fragment, each on
its own, and the counts are summed per pair. The result is exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import written

N, PERMILLE, FRAGMENTS = 3, 600, 8
_TOKEN = re.compile(r"[^\W_]+")


def gram_set(text: str, n: int = N) -> np.ndarray:
    """The distinct runs of n consecutive tokens of a text, as sorted 64-bit hashes. Tokens are longest runs of letters
    and digits of the lower-cased text."""
    known: dict[str, int] = {}
    tokens = _TOKEN.findall(text.lower())
    if len(tokens) < n:
        return np.zeros(0, np.int64)
    h = np.fromiter((known[t] if t in known else known.setdefault(t, xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in tokens), np.uint64, len(tokens))
    size = len(tokens) - n + 1
    out = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out ^= h[k : k + size]
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def gram_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """id, h1 and h2 (128 bits that stand for the text) and g, the gram set, of each row of docs (id, text) that has
    one. Whole texts, in one pass, without a shuffle."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            ids, sets, marks = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = gram_set(t, n)
                if len(g):
                    ids.append(i)
                    sets.append(g)
                    marks.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
            offsets = np.r_[0, np.cumsum([len(g) for g in sets])].astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            h = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "h1", "h2", "g"])

    return docs.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, h1 long, h2 long, g array<long>")


def classes(docs: DataFrame) -> DataFrame:
    """id, rep and n of each row of gram_sets(): rows of one and the same text form a class, named by its least id; n
    is the size of its set."""
    keyed = docs.select("id", F.size("g").alias("n"), "h1", "h2")
    least = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    return keyed.join(least, ["h1", "h2"]).select("id", "rep", "n")


def similar(sets: DataFrame, permille: int = PERMILLE, fragments: int = FRAGMENTS) -> DataFrame:
    """Pairs (a < b) of sets with a Jaccard similarity of at least permille / 1000, with common, their overlap. sets
    has rep (unique), n (the size of g) and g. Empty sets are in no pair."""
    t = permille / 1000
    rows = sets.where("n > 0").select("rep", "n", F.explode("g").alias("g"))
    df = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    key = F.col("df") + F.col("g") / F.lit(2.0**64) + 0.5  # position in the global order; ties only by equal doubles
    placed = rows.join(df, "g").withColumn("key", key)
    # Of each set, its grams that occur elsewhere, in the global order. Those that don't come before them.
    ordered = placed.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("key", "g"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    kept = F.greatest(F.lit(0), prefix - (F.col("n") - F.size("s"))).cast("int")
    ordered = written(ordered.select("rep", "n", "s", kept.alias("kept")).where("kept > 0"), "ordered")
    heads = ordered.select("rep", "n", (F.size("s") - F.col("kept")).alias("rest"), F.get("s", F.least("kept", F.size("s")) - 1)["key"].alias("end"), F.explode(F.slice("s", F.lit(1), F.col("kept"))["g"]).alias("g"))
    one, two = heads.alias("x"), heads.alias("y")
    near = (F.col("x.g") == F.col("y.g")) & (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") * 1000 >= F.greatest("x.n", "y.n") * permille)
    # Common grams that aren't in both prefixes lie behind the end of the one that ends first.
    rest = F.when(F.col("x.end") < F.col("y.end"), F.col("x.rest")).when(F.col("x.end") > F.col("y.end"), F.col("y.rest")).otherwise(F.greatest("x.rest", "y.rest"))
    met = one.join(two, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), rest.alias("rest"))
    met = met.groupBy("a", "b", "na", "nb", "rest").agg(F.count("*").alias("shared"))
    candidates = written(met.where((F.col("shared") + F.greatest("rest", F.lit(0))) * (1000 + permille) >= (F.col("na") + F.col("nb")) * permille).select("a", "b", "na", "nb"), "candidates")
    taken = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets_ = ordered.join(taken, "rep", "left_semi")
    steps = [k / fragments for k in range(1, fragments)]
    pivots = sets_.select(F.explode("s.key").alias("key")).agg(F.percentile_approx("key", steps, 10_000).alias("p")).first().p or []
    edges = [float("-inf"), *sorted(set(pivots)), float("inf")]
    within = lambda lo, hi: lambda x: (x["key"] >= lo) & (x["key"] < hi)
    cut = [F.struct(F.lit(k).alias("f"), F.transform(F.filter("s", within(lo, hi)), lambda x: x["g"]).alias("seg")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    segments = sets_.select("rep", F.explode(F.array(*cut)).alias("x")).select("rep", "x.f", "x.seg").where("size(seg) > 0")
    left = candidates.join(segments.withColumnRenamed("rep", "a"), "a")
    right = segments.select(F.col("rep").alias("b"), "f", F.col("seg").alias("other"))
    part = left.join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("seg", "other")).alias("c"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("common"))
    return total.where(F.col("common") * 1000 >= (F.col("na") + F.col("nb") - F.col("common")) * permille).select("a", "b", "common")


def near_duplicates(docs: DataFrame, n: int = N, permille: int = PERMILLE, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """Classes of exact copies (id, rep, n) and the pairs (a < b, common) of similar classes, named by rep.

    docs has id and text; other columns are left aside. Rows of one id count once (they carry the same text); null
    ids are left out. Texts under n tokens, null and empty ones have no grams and are in no class. Whole texts are
    used, however long. A group of copies is one class, whatever its size, and is never expanded into pairs here.
    """
    sets = written(gram_sets(docs.dropDuplicates(["id"]), n), "grams")
    member = written(classes(sets), "classes")
    reps = sets.join(member.where("id = rep").select("id", "n"), "id").select(F.col("id").alias("rep"), "n", "g")
    return member, similar(reps, permille, fragments)


def events(wcep: DataFrame) -> DataFrame:
    """id and text of each event: its non-null articles joined by a blank."""
    return wcep.select(F.col("sample_id").alias("id"), F.array_join("document", " ").alias("text"))


def event_pairs(wcep: DataFrame) -> DataFrame:
    """sample_a < sample_b of similar events. Every pair of different texts comes out, equal gram sets included.

    Events of exactly the same text are a class, named by its least id. A class gives pairs of that id and each copy;
    a link between two classes gives the pairs of each one's copies with the other's least id. So the rows grow with
    the copies, not with their square; event_groups has the members of all classes."""
    member, pairs = near_duplicates(events(wcep))
    pairs = written(pairs.select("a", "b"), "pairs")
    of = member.select("id", "rep")
    left = pairs.join(of.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").select("x", F.col("b").alias("y"))
    right = pairs.join(of.select(F.col("rep").alias("b"), F.col("id").alias("x")), "b").select("x", F.col("a").alias("y"))
    copies = of.where("id <> rep").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    every = left.unionByName(right).unionByName(copies)
    return every.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b")).distinct()


def event_groups(wcep: DataFrame) -> DataFrame:
    """sample_id, class_id (least id of its exact copies), group_id (least id of all that are linked with it, over any
    number of links) and n_links (similar classes), of every event with at least three tokens."""
    member, pairs = near_duplicates(events(wcep))
    pairs = written(pairs, "pairs")
    group = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = member.join(group.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias("sample_id"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
