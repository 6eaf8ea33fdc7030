"""Evaluation of answers and retrieval: exact match, F1, ROUGE, answer rates and recall, as joins and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, normalize_answer

# Cuts of recall.
CUTS = (1, 2, 5, 10, 20, 50, 100, 200)
# End of fixed values.


def pairs(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, prediction and answer for every gold answer of a query. predictions has query_id and prediction,
    gold query_id and answer; null answers are left out, a null prediction counts as empty text."""
    p = predictions.select("query_id", F.coalesce("prediction", F.lit("")).alias("prediction"))
    return p.join(gold.where("answer is not null").select("query_id", "answer").distinct(), "query_id")


def exact_match(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and em: 1 if the normalised prediction equals a normalised gold answer, else 0."""
    hit = (normalize_answer(F.col("prediction")) == normalize_answer(F.col("answer"))).cast("int")
    return pairs(predictions, gold).groupBy("query_id").agg(F.max(hit).alias("em"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def f_measure(hits: Column, given: Column, wanted: Column) -> Column:
    p, r = hits / given, hits / wanted
    return F.when(hits > 0, 2 * p * r / (p + r)).otherwise(0.0)


def f1(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and f1: the best token F1 over the gold answers; 0 without a shared token."""
    t = pairs(predictions, gold).select("query_id", answer_tokens(F.col("prediction")).alias("p"), answer_tokens(F.col("answer")).alias("g"))
    return t.groupBy("query_id").agg(F.max(f_measure(overlap(F.col("p"), F.col("g")), F.size("p"), F.size("g"))).alias("f1"))


def plain_words(text: Column) -> Column:
    """Runs of letters and digits (ASCII) of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n of an array's words. words should be a column that has been worked out before, as it is read once
    per run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def rouge_n(predictions: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """query_id, precision, recall and f of n-grams, each its best over the gold answers."""
    w = pairs(predictions, gold).select("query_id", plain_words(F.col("prediction")).alias("p"), plain_words(F.col("answer")).alias("g"))
    t = w if n == 1 else w.select("query_id", ngrams(F.col("p"), n).alias("p"), ngrams(F.col("g"), n).alias("g"))
    h = t.select("query_id", overlap(F.col("p"), F.col("g")).alias("h"), F.size("p").alias("np"), F.size("g").alias("ng"))
    return h.groupBy("query_id").agg(
        F.max(F.when(F.col("np") > 0, F.col("h") / F.col("np")).otherwise(0.0)).alias("precision"),
        F.max(F.when(F.col("ng") > 0, F.col("h") / F.col("ng")).otherwise(0.0)).alias("recall"),
        F.max(f_measure(F.col("h"), F.col("np"), F.col("ng"))).alias("f"),
    )


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: rows of the table as bit vectors over the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for k, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        here = at.get(t, 0)
        row = ((row + (row & here)) | (row & ~here)) & full
    return len(a) - row.bit_count()


def rouge_l(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, precision, recall and f of longest common subsequences, each its best over the gold answers."""

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")

    t = pairs(predictions, gold).select("query_id", plain_words(F.col("prediction")).alias("p"), plain_words(F.col("answer")).alias("g"))
    h = t.select("query_id", common("p", "g").alias("h"), F.size("p").alias("np"), F.size("g").alias("ng"))
    return h.groupBy("query_id").agg(
        F.max(F.when(F.col("np") > 0, F.col("h") / F.col("np")).otherwise(0.0)).alias("precision"),
        F.max(F.when(F.col("ng") > 0, F.col("h") / F.col("ng")).otherwise(0.0)).alias("recall"),
        F.max(f_measure(F.col("h"), F.col("np"), F.col("ng"))).alias("f"),
    )


def answer_kinds(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id and kind: `error` (the answer Error), `not_mentioned` (says that it isn't mentioned, specified or
    stated), `false` (no token of any gold answer) or `other`, the first that holds."""
    g = gold.where("answer is not null").select("query_id", F.explode(answer_tokens(F.col("answer"))).alias("t")).groupBy("query_id").agg(F.collect_set("t").alias("g"))
    words_ = answer_tokens(F.col("prediction"))
    says = F.array_contains(words_, "not") & F.arrays_overlap(words_, F.array(*map(F.lit, ("mentioned", "specified", "stated"))))
    p = predictions.select("query_id", F.coalesce("prediction", F.lit("")).alias("prediction"))
    kind = F.when(F.col("prediction") == "Error", "error").when(says, "not_mentioned").when(~F.coalesce(F.arrays_overlap(words_, F.col("g")), F.lit(False)), "false").otherwise("other")
    return p.join(g, "query_id", "left").select("query_id", kind.alias("kind"))


def recall_at(retrieved: DataFrame, gold_docs: DataFrame, top: int) -> DataFrame:
    """k and recall: over the queries of retrieved, the mean share of gold documents among the first k distinct texts,
    for the usual cuts up to top; a query without gold documents counts 0. retrieved has query_id, rank and text,
    gold_docs query_id and text. Rounded to four places."""
    cuts = sorted({k for k in CUTS if k < top} | {top})
    g = gold_docs.where("text is not null").select("query_id", "text").distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("n"))
    first = retrieved.groupBy("query_id", "text").agg(F.min("rank").alias("rank"))
    hit = first.join(g, ["query_id", "text"]).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in cuts])
    every = retrieved.select("query_id").distinct().join(size, "query_id", "left").join(hit, "query_id", "left")
    each = every.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"k{k}") / F.col("n"), F.lit(0.0)).alias("r")) for k in cuts])).alias("x"))
    return each.groupBy("x.k").agg(F.round(F.avg("x.r"), 4).alias("recall"))


def evaluate(predictions: DataFrame, gold: DataFrame, retrieved: DataFrame | None = None, gold_docs: DataFrame | None = None, top: int = 5, metrics: str | list[str] = "all") -> dict[str, float]:
    """The chosen metrics as numbers, rounded to four places. Unknown names raise."""
    known = ("em", "f1", "rouge", "rates", "recall")
    chosen = list(known) if metrics == "all" else list(metrics)
    if bad := set(chosen) - set(known):
        raise ValueError(f"unknown metrics: {sorted(bad)}")
    out: dict[str, float] = {}
    mean = lambda d, c: round(d.agg(F.avg(c)).first()[0] or 0.0, 4)
    if "em" in chosen:
        out["em"] = mean(exact_match(predictions, gold), "em")
    if "f1" in chosen:
        out["f1"] = mean(f1(predictions, gold), "f1")
    if "rouge" in chosen:
        for name, d in (("rouge1", rouge_n(predictions, gold, 1)), ("rouge2", rouge_n(predictions, gold, 2)), ("rougeL", rouge_l(predictions, gold))):
            r = d.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f")]).first()
            out |= {f"{name}_{c}": r[c] or 0.0 for c in ("precision", "recall", "f")}
    if "rates" in chosen:
        r = answer_kinds(predictions, gold).agg(*[F.round(F.avg((F.col("kind") == k).cast("double")), 4).alias(k) for k in ("error", "not_mentioned", "false")]).first()
        out |= {k: r[k] or 0.0 for k in ("error", "not_mentioned", "false")}
    if "recall" in chosen and retrieved is not None and gold_docs is not None:
        out |= {f"recall@{r.k}": r.recall for r in recall_at(retrieved, gold_docs, top).collect()}
    return out
