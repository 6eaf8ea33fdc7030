"""Reading level of documents: a Rasch-style model of levels and word difficulties, fitted by alternating passes.

A document has a latent level, a word a difficulty on the same scale; the words that occur in a document say its
level: the overall mean plus the mean difficulty of its distinct words. Ratings are noisy views of levels. Difficulties
have a normal prior and are estimated by alternating between documents (levels from difficulties) and words (what the
levels miss of the ratings, gathered per word), each alternation one distributed pass over the rated documents; then
every document is scored. Words are hashed, so the model is BUCKETS numbers, whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import language
from .split import WORD

LEVELS, BUCKETS = 5, 1 << 17
LEAST_WORDS, LEAST_COUNT = 30, 3
#: Alternations between documents and words, weight of the prior on difficulties, most ratings that a document counts
#: for, bins of levels for the limits between grades.
ROUNDS, PRIOR, MOST_RATINGS, BINS = 10, 0.1, 3, 600
_ITEM = re.compile(r"[^\W\d_]+|[^\w\s]")


def items(text: str, languages: language.Languages) -> tuple[int, list[int]]:
    """The language of a text (by the words that mark one; the first where there are none) and its distinct items:
    words and marks, as bucket numbers that belong to the language."""
    distinct = {w.lower() for w in _ITEM.findall(text)}
    k = languages.of_words(distinct)
    mark = chr(97 + k)
    return k, sorted({zlib.crc32((mark + w).encode("utf-8", "surrogatepass")) % BUCKETS for w in distinct})


def features(docs: DataFrame) -> DataFrame:
    """doc_id, language and items of each document of at least LEAST_WORDS words. Null ids and texts give no row.
    Languages are learned from the column lang, wherever it is right for most; without it all are one."""
    languages = language.fit(docs.select("text", "lang")) if "lang" in docs.columns else language.Languages()
    held = docs.sparkSession.sparkContext.broadcast(language.Languages(languages.names, own=languages.own))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            got = [items(t, held.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc_id", "language", "items"])

    long = docs.where("doc_id is not null").where(F.regexp_count("text", F.lit(WORD)) >= LEAST_WORDS)
    return long.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, language int, items array<int>")


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and how often its raters gave each grade (g1 to g5). A row counts once; null or other grades don't."""
    rows = labels.where("doc_id is not null and grade between 1 and 5").select(F.col("doc_id").cast("long").alias("doc_id"), "rater", "grade").distinct()
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("grade") == g).cast("int").alias(f"g{g}") for g in range(1, LEVELS + 1)])


def levels(offsets: np.ndarray, flat: np.ndarray, difficulty: np.ndarray) -> np.ndarray:
    """The mean difficulty of the items of each document; 0 without items."""
    sums = np.r_[0.0, np.cumsum(difficulty[flat].astype(np.float64))]
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _pass(rated: DataFrame, mean: float, difficulty: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One pass from documents to words: per bucket, the sum over its documents of weight / items x what the document
    says, and how many there are. A document says its mean rating less the overall mean, or, given difficulties, its
    level by them. At most BUCKETS rows come to the driver."""
    shared = rated.sparkSession.sparkContext.broadcast(difficulty)

    def run(batches):  # noqa: ANN001, ANN202
        total, seen = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
        for b in batches:
            offsets, flat = _lists(b.column(0))
            says, weight = b.column(1).to_numpy() - mean, b.column(2).to_numpy()
            if shared.value is not None:
                says = levels(offsets, flat, shared.value)
            n = np.diff(offsets)
            total += np.bincount(flat, weights=np.repeat(weight * says / np.maximum(n, 1), n), minlength=BUCKETS)
            seen += np.bincount(flat, minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(seen[at])], names=["key", "total", "seen"])

    got = rated.select("items", "rating", "weight").mapInArrow(run, "key int, total double, seen long").groupBy("key").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).toArrow()
    total, seen = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    total[got.column("key").to_numpy()], seen[got.column("key").to_numpy()] = got.column("total").to_numpy(), got.column("seen").to_numpy()
    return total, seen


def fit(rated: DataFrame, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The overall mean and the difficulty of each bucket: the least squares of ratings against levels plus PRIOR
    times the squared difficulties. Documents and words alternate: levels follow from difficulties, what they miss of
    the ratings flows back to the words, along conjugate directions. Buckets of fewer than LEAST_COUNT rated documents
    have difficulty 0."""
    mean = rated.agg(F.sum(F.col("rating") * F.col("weight")) / F.sum("weight")).first()[0]
    difficulty = np.zeros(BUCKETS)
    if mean is None:
        return 3.0, difficulty
    rest, seen = _pass(rated, mean, None)
    use = seen >= LEAST_COUNT
    rest = rest * use
    way, size = rest.copy(), float(rest @ rest)
    for _ in range(rounds):
        if size < 1e-18:
            break
        back = _pass(rated, mean, way)[0] * use + PRIOR * way
        step = size / float(way @ back)
        difficulty += step * way
        rest -= step * back
        size, before = float(rest @ rest), size
        way = rest + size / before * way
    return mean, difficulty


def limits(rated: DataFrame, mean: float, difficulty: np.ndarray) -> np.ndarray:
    """The four limits between grades on the scale of levels: those that agree with most ratings of the rated
    documents, by coordinate search over a histogram of BINS bins per grade."""
    shared = rated.sparkSession.sparkContext.broadcast(difficulty)
    marks = [f"g{g}" for g in range(1, LEVELS + 1)]

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros((BINS, LEVELS), np.int64)
        for b in batches:
            at = np.clip(((mean + levels(*_lists(b.column(0)), shared.value)) / (LEVELS + 1) * BINS).astype(int), 0, BINS - 1)
            for g in range(LEVELS):
                total[:, g] += np.bincount(at, weights=b.column(1 + g).to_numpy(), minlength=BINS).astype(np.int64)
        at = np.flatnonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, g]) for g in range(LEVELS))], names=["key", *marks])

    got = rated.select("items", *marks).mapInArrow(run, "key int, " + ", ".join(f"{m} long" for m in marks)).groupBy("key").agg(*[F.sum(m).alias(m) for m in marks]).toArrow()
    counts = np.zeros((BINS, LEVELS))
    counts[got.column("key").to_numpy()] = np.stack([got.column(m).to_numpy() for m in marks], 1)
    below = np.vstack([np.zeros((1, LEVELS)), np.cumsum(counts, 0)])  # ratings below a bin's lower edge
    cut = np.array([round((g + 0.5) / (LEVELS + 1) * BINS) for g in range(1, LEVELS)])
    for _ in range(5):
        for k in range(LEVELS - 1):
            low, high = (cut[k - 1] if k else 0), (cut[k + 1] if k + 2 < LEVELS else BINS)
            at = np.arange(low, high + 1)
            agree = (below[at, k] - below[low, k]) + (below[high, k + 1] - below[at, k + 1])
            best = np.flatnonzero(agree >= agree.max() - 1e-9)
            cut[k] = at[best[np.abs(at[best] - cut[k]).argmin()]]
    return cut / BINS * (LEVELS + 1)


def reading_levels(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, level (the latent one) and grade (1 to 5, by the limits that agree best with the raters) of every document of at least
    LEAST_WORDS words, words being runs of other than white space.

    docs has doc_id and text, labels has doc_id, rater and grade; other columns are left aside. All labelled documents
    fit the model, whole texts are read. Null, empty and short texts give no row, repeated documents repeated rows.
    Raters who differ count by their mean; identical label rows count once, null grades not at all. Without any
    label every document comes out with grade 3 and level 3. Empty tables give an empty one.
    """
    feats = written(features(docs), "items")
    marks = [f"g{g}" for g in range(1, LEVELS + 1)]
    count = sum(F.col(m) for m in marks)
    rating = sum(F.col(f"g{g}") * g for g in range(1, LEVELS + 1)) / count
    rated = written(feats.join(ratings(labels), "doc_id").select("items", rating.alias("rating"), F.least(count, F.lit(MOST_RATINGS)).cast("double").alias("weight"), *marks), "rated")
    mean, difficulty = fit(rated, rounds)
    cut = limits(rated, mean, difficulty) if np.any(difficulty) else np.array([1.5, 2.5, 3.5, 4.5])
    shared = docs.sparkSession.sparkContext.broadcast(difficulty.astype(np.float32))  # BUCKETS numbers

    def score(batches):  # noqa: ANN001, ANN202
        for b in batches:
            level = mean + levels(*_lists(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((np.searchsorted(cut, level, side="right") + 1).astype(np.int32)), pa.array(level)], names=["doc_id", "grade", "level"])

    return feats.select("doc_id", "items").mapInArrow(score, "doc_id long, grade int, level double")
